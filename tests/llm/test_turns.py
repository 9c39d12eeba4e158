"""Repair of conversations: against all sequences of edits, against SQL, whole and in segments."""

import heapq
import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pyarrow as pa
import pytest

from tallyforge.llm import queries, turns


def shortest(codes: str) -> tuple[int, str]:
    """The cheapest edits by trying them in the order of cost and letters, on roles so far as a text."""
    todo, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, at, last = heapq.heappop(todo)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(codes) and last in ("", "a"):
            return cost, audit
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        heapq.heappush(todo, (cost + 3, audit + "I", at, follow))
        if at < len(codes):
            code = codes[at]
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, last))
            if code != "d":
                extra = 3 if code.isupper() else 0
                heapq.heappush(todo, (cost + 3 + extra, audit + "R", at + 1, follow))
                if code.lower() == follow or (code.lower() == "s" and not last):
                    heapq.heappush(todo, (cost + extra, audit + "K", at + 1, code.lower()))


def test_plans_are_the_least_of_the_cheapest():
    rng = random.Random(3)
    for k in range(4000):
        codes = "".join(rng.choice("uaUAsSxXd" if k % 2 else "uaua") for _ in range(rng.randint(0, 9)))
        assert turns.plan(codes) == shortest(codes), codes
    assert turns.plan("") == (0, "") and turns.plan("u") == (3, "KI") and turns.plan("d" * 40) == (160, "D" * 40)


def test_segments_compose():
    rng = random.Random(4)
    for _ in range(500):
        codes = "".join(rng.choice("uaUAsxd") for _ in range(rng.randint(2, 30)))
        cut = rng.randint(1, len(codes) - 1)
        right = turns.distances(codes[cut:])
        left = turns.distances(codes[:cut], tuple(right[:4]))
        edits, state = turns.walk(codes[:cut], left)
        more, state = turns.walk(codes[cut:], right, state)
        assert (left[turns.START], "".join(edits + more) + "I" * (turns.END[state] // 3)) == turns.plan(codes)


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "assistant ", "ünder"]
TEXTS = ["One.", "Two!", "Three?", "Four", "Five. \n", "", " \t\x0b", None, "Six…", "é", "1.5", "a ", "日本。", "?", "x\ny."]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 12)):
            n = rng.choice([turn, turn, turn, turn, None, turn + 3, 2])
            out.append((conv, n, rng.choice(ROLES[: rng.choice([2, 2, 11])]), rng.choice(TEXTS[: rng.choice([3, 15])])))
    out += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}." + "x" * 50_000 * (t == 7)) for t in range(60)]
    return [(*r, "conv", True, "h", 1) for r in out + out[:20]]


COLUMNS = "conv_id long, turn long, role string, text string, hash string, long_id boolean, part string, place int"


def plain(rows):
    """The summaries by loops."""
    found = defaultdict(list)
    for conv, turn, role, text in (r[:4] for r in rows):
        own = found[conv]
        role, text = (" " if v is None else v for v in (role, text))
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.replace(".", "").replace("!", "").replace("?", "") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).hexdigest()))
        counts, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", set()
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = shortest(codes)
        made, left = [], list(own)
        for letter in audit:
            row = None if letter == "I" else left.pop(0)
            if letter != "D":
                other = "user" if not made or made[-1][0][:1] != "u" else "assistant"
                made.append((row[1] if letter == "K" else other, row[2] if row else ""))
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, sha256("\n".join(map(":".join, made)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_summaries_are_the_plain_ones_and_sql(spark, rows):
    got = turns.summaries(turns.damaged(spark.createDataFrame(rows, COLUMNS).repartition(3)))
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == plain(rows)
    c = duckdb.connect()
    c.register("conversations", pa.table({n: [r[k] for r in rows] for k, n in enumerate(("conv_id", "turn", "role", "text"))}))
    assert sorted(c.sql(turns.SQL).fetchall(), key=str) == found
    assert turns.summaries(turns.damaged(spark.createDataFrame([], COLUMNS))).count() == 0


def test_long_conversations_are_the_same_in_segments(spark, rows, monkeypatch):
    damaged = turns.damaged(spark.createDataFrame(rows, COLUMNS).repartition(4))
    want = sorted(map(tuple, turns.summaries(damaged).collect()), key=str)
    assert sorted(map(tuple, turns.summaries(damaged, long_turns=5).collect()), key=str) == want
    whole, cut = (turns.repaired(damaged, long_turns=n).orderBy("conv_id", "place").collect() for n in (4096, 5))
    assert [(r.conv_id, r.role, r.text) for r in whole] == [(r.conv_id, r.role, r.text) for r in cut]


def test_one_conversation_of_very_many_turns(spark):
    """Some 20,000 turns, thousands of them equal, in segments of a task each, against one plan."""
    n = 20_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id % 9000 AS turn", "CASE WHEN id % 5 = 0 THEN 'assistant' WHEN id % 3 = 0 THEN 'x' ELSE 'user' END AS role", "CASE WHEN id % 2 = 0 THEN 'same.' WHEN id % 7 = 0 THEN '' ELSE concat('turn ', id, '.') END AS text")
    long_, short = (turns.summaries(df, long_turns=m).collect() for m in (4096, 10**6))
    assert long_ == short and len(long_[0].audit) >= n


def test_a_view_of_present_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", False), (2, 5, "user", "Hi.", True), (2, 6, "assistant", "Yes.", True)], "c long, t long, r string, x string, present boolean")
    got = {r[0]: tuple(r[1:]) for r in turns.summaries(df, "c", "t", "r", "x").collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()), 2: (0, 0, 0, 0, 0, 0, "KK", sha256(b"user:Hi.\nassistant:Yes.").hexdigest())}


def test_query_is_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(map(tuple, queries.op12_turns(spark, sf).collect())) == sorted(c.sql(turns.SQL).fetchall())
