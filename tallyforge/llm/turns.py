"""Repair of conversations: the cheapest edits after which roles alternate, by Dial's bucket queue.

After an optional system turn, user and assistant turns must alternate and end with the assistant; nothing
at all is right too. Edits and costs: Keep 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty
user or assistant turn, anywhere) 3; a truncated turn that isn't deleted costs 3 more, blank and repeated
turns must go. Edits are arcs of a graph whose nodes are (turns done, what the last kept turn is). Its
costs are small whole numbers, so distances to the end come from a queue of buckets, one for each
distance; from the start, the first letter in ASCII order among the tight arcs (those that lie on a
shortest path) is taken again and again, which gives the least of the cheapest sequences.

Turns of a conversation are ordered by turn (nulls first), then role, then SHA-256 of the text. A
conversation of up to LONG_TURNS turns and LONG_BYTES bytes is one row of a task. A longer one is cut in
segments, which tasks work on independently: each gives the distances between its entry and exit states;
composed from the end they give the distances at every cut, and with these each segment walks its own
tight arcs. What the segments hold is dealt by range of the whole order, never gathered; a digest over
the whole conversation passes through one task as a stream, since SHA-256 takes its bytes in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import scratch, written

#: Turns and bytes of text of a conversation from which on it is cut in segments, and turns of a segment.
LONG_TURNS, LONG_BYTES = 4096, 32 << 20
SEGMENT = 2048

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

# What the last kept turn is. The turn after it that Rerole and Insert make is NEXT, the states before it BEFORE.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
#: Where a turn of this initial may be kept: the states before it, by the state it leads to.
KEPT = {"s": {SYSTEM: (START,)}, "u": {USER: BEFORE[USER]}, "a": {ASSISTANT: BEFORE[ASSISTANT]}}
ROLES = ("", "system", "user", "assistant")
#: Distances to a right end when all turns are done: by inserts alone.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 62

# A turn's code: its initial if that is s, u or a, else x; a capital if truncated; d if it must go.


def distances(codes: str, end: tuple[int, ...] = END, copies: list[int] | None = None) -> list[int]:
    """Distances of the nodes (turns done, state), state varying fastest, where those after the last
    turn are `end`. A code d with copies stands for as many turns."""
    n = len(codes)
    far = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = [[]]
    least = min(end)

    def reach(node: int, d: int) -> None:
        if d < far[node]:
            far[node] = d
            while d - least >= len(buckets):
                buckets.append([])
            buckets[d - least].append(node)

    for state in range(4):
        if end[state] < FAR:
            reach(4 * n + state, end[state])
    at = 0
    while at < len(buckets):
        for node in buckets[at]:  # grows while it is read: keeping costs nothing
            d = at + least
            if far[node] < d:
                continue
            done, state = divmod(node, 4)
            if done < n:
                for p in BEFORE[state]:
                    reach(4 * done + p, d + INSERT)
            if done:
                code, before = codes[done - 1], 4 * done - 4
                reach(before + state, d + DELETE * (copies[done - 1] if copies else 1))
                if code != "d":
                    extra = TRUNCATED if code.isupper() else 0
                    for p in BEFORE[state]:
                        reach(before + p, d + REROLE + extra)
                    for p in KEPT.get(code.lower(), {}).get(state, ()):
                        reach(before + p, d + extra)
        buckets[at] = []
        at += 1
    return far


def walk(codes: str, far: list[int], state: int = START, copies: list[int] | None = None) -> tuple[list[str], int]:
    """The edits before and of each turn (its inserts, then one letter), least in ASCII order among the
    shortest from `state` on, and the state they end in."""
    out = []
    for k, code in enumerate(codes):
        inserted = ""
        while True:
            d, after = far[4 * k + state], 4 * k + 4
            if d == far[after + state] + DELETE * (copies[k] if copies else 1):
                letter = "D" * (copies[k] if copies else 1)
                break
            if d == far[4 * k + NEXT[state]] + INSERT:
                inserted += "I"
                state = NEXT[state]
                continue
            extra = TRUNCATED if code.isupper() else 0
            to = next((q for q, ways in KEPT.get(code.lower(), {}).items() if state in ways), None)
            if to is not None and d == far[after + to] + extra:
                letter, state = "K", to
            else:
                letter, state = "R", NEXT[state]
            break
        out.append(inserted + letter)
    return out, state


@lru_cache(maxsize=50_000)
def plan(codes: str) -> tuple[int, str]:
    """Cost and audit of the turns of a conversation."""
    far = distances(codes)
    edits, state = walk(codes, far)
    return far[START], "".join(edits) + "I" * (END[state] // INSERT)


def code_of(role: str, forced: bool, truncated: bool) -> str:
    """A turn's code by its role's initial and its fault."""
    if forced:
        return "d"
    code = role[:1] if role[:1] in KEPT else "x"
    return code.upper() if truncated else code


def edited(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of the turns after the edits of `audit`."""
    out, state, rest = [], START, iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[state]
        out.append((role if letter == "K" else ROLES[state], text))
    return out


def _whole(turns: list[dict]) -> dict:
    """The summary of a conversation that is one row, and its turns after repair."""
    keyed = sorted(((t["turn"] is not None, t["turn"] or 0, t["role"], sha256(t["text"].encode()).hexdigest(), t["text"]) for t in turns), key=lambda r: (r[0], r[1], r[2].encode(), r[3]))
    rows = [(r[2], r[4]) for r in keyed]
    seen: set[tuple[str, str]] = set()
    codes, faults = "", [0, 0, 0]
    for role, text in rows:
        body = text.rstrip(BLANKS)
        blank, repeated = not body, (role, text) in seen
        truncated = not blank and not repeated and body[-1] not in ".!?"
        for k, fault in enumerate((blank, repeated and not blank, truncated)):
            faults[k] += fault
        seen.add((role, text))
        codes += code_of(role, blank or repeated, truncated)
    initials = [role[:1] for role, _ in rows]
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    cost, audit = plan(codes)
    made = edited(rows, audit)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        "blank": faults[0],
        "duplicate": faults[1],
        "truncated": faults[2],
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        "turns": [{"role": r, "text": t} for r, t in made],
    }


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by a hash of conversation and turn (nulls are
    one space in what is hashed, in roles and in texts): of twenty, one isn't present, one has an empty
    text, one loses its sentence ends, one is there twice, one gets the role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col))) % 20
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), times.alias("time"))
    return rows.drop("time")


def _named(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    own = F.col("present") if "present" in df.columns else F.lit(True)
    return df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), own.alias("present"))


def _long_ones(rows: DataFrame, turns: int) -> DataFrame:
    present = F.col("present")
    sizes = rows.groupBy("conv_id").agg(F.count(F.when(present, 1)).alias("n"), F.sum(F.when(present, F.octet_length("text"))).alias("size"))
    return written(sizes.where((F.col("n") > turns) | (F.col("size") > LONG_BYTES)).select(F.col("conv_id").alias("long_id")), "long")


def _whole_ones(rows: DataFrame) -> DataFrame:
    """(conv_id, the summary's columns, turns) of conversations of bounded size."""
    grouped = rows.groupBy("conv_id").agg(F.collect_list(F.when(F.col("present"), F.struct("turn", "role", "text"))).alias("turns"))
    schema = T.StructType([grouped.schema["conv_id"], *T.StructType.fromDDL(SUMMARY + ", turns array<struct<role: string, text: string>>")])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                made = [_whole(turns) for turns in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *[pa.array([m[f.name] for m in made], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return grouped.mapInArrow(work, schema)


KEY = ["conv_id", "turn", "role", "hash"]


def _beside(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """a with b's other columns, where they agree in `names`, nulls included."""
    b = b.withColumnsRenamed({n: f"_{n}" for n in names})
    return a.join(b, [a[n].eqNullSafe(b[f"_{n}"]) for n in names], how).drop(*[f"_{n}" for n in names])


def _placed(rows: DataFrame) -> DataFrame:
    """One row for equal turns of a conversation (with their number), in the order of turns: part, segment
    and place, all ascending; their codes and faults."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    facts = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("hash"), (F.length(body) == 0).alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    facts = written(facts.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "facts")
    number = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = facts.groupBy("conv_id", "role", "hash").agg(F.min(number).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    facts = _beside(facts, again.drop("turns"), ["conv_id", "role", "hash"], "left")
    facts = facts.select(*KEY, "n", "blank", "cut", F.coalesce(number > F.col("first"), F.lit(False)).alias("later"))
    ordered = facts.repartitionByRange(*KEY).sortWithinPartitions(*KEY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, segment, place = TaskContext.get().partitionId(), object(), -1, 0
        for batch in batches:
            segments, places = [], []
            for conv in batch.column(0).to_pylist():
                if conv != last or place >= SEGMENT:
                    last, segment, place = conv, segment + 1, 0
                segments.append(segment)
                places.append(place)
                place += 1
            n = len(segments)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(segments, pa.int32()), pa.array(places, pa.int32())], names=[*batch.schema.names, "part", "segment", "place"])

    schema = T.StructType([*ordered.schema, *T.StructType.fromDDL("part int, segment int, place int")])
    return written(ordered.mapInArrow(work, schema), "placed")


def _coded(turns: list[dict]) -> tuple[str, list[int], list[int]]:
    """Codes, copies and, for each code, the turn it is of: turns that must go are one code."""
    codes, copies, of = "", [], []
    for k, t in enumerate(turns):
        goes = t["n"] if t["blank"] or t["later"] else t["n"] - 1
        if goes < t["n"]:
            codes += code_of(t["role"], False, t["cut"])
            copies.append(1)
            of.append(k)
        if goes:
            codes += "d"
            copies.append(goes)
            of.append(k)
    return codes, copies, of


SEGMENT_KEY = ["conv_id", "part", "segment"]


def _long_turns(rows: DataFrame, conv: T.StructField) -> tuple[DataFrame, DataFrame]:
    """Of long conversations: (conv_id, part, segment, place, KEY, edits, state) of each different turn,
    where state is what was last kept before it, and (conv_id, the summary without audit and hash, tail)."""
    placed = _placed(rows)
    fields = F.struct("place", "turn", "role", "hash", "n", "blank", "cut", "later")
    segments = written(placed.groupBy(*SEGMENT_KEY).agg(F.array_sort(F.collect_list(fields)).alias("turns")), "segments")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                turns = batch.column(3)[k].as_py()
                codes, copies, _ = _coded(turns)
                ways = [distances(codes, tuple(0 if s == q else FAR for s in range(4)), copies) for q in range(4)]
                fresh = [not (t["blank"] or t["later"]) for t in turns]
                initials = [t["role"][:1] for t in turns]
                row = {
                    "ways": [ways[q][p] for p in range(4) for q in range(4)],
                    "blank": sum(t["n"] for t in turns if t["blank"]),
                    "duplicate": sum(t["n"] - f for t, f in zip(turns, fresh) if not t["blank"]),
                    "truncated": sum(t["cut"] for t, f in zip(turns, fresh) if f),
                    "illegal": sum(t["n"] - 1 for t in turns) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    "first": initials[0],
                    "last": initials[-1],
                }
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(3)], *[pa.array([row[f.name]], f.type) for f in list(arrow)[3:]]], schema=arrow)

    schema = T.StructType([conv, *T.StructType.fromDDL("part int, segment int, ways array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string")])
    arrow = to_arrow_schema(schema)
    found = segments.mapInArrow(matrices, schema)
    parts = written(found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*schema.names[1:]))).alias("segments")), "parts")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = batch.column(1)[k].as_py()
                ends = [list(END)]
                for s in reversed(own[1:]):
                    ends.append([min(s["ways"][4 * p + q] + ends[-1][q] for q in range(4)) for p in range(4)])
                cost = min(own[0]["ways"][q] + ends[-1][q] for q in range(4))
                sums = {c: sum(s[c] for s in own) for c in ("blank", "duplicate", "truncated", "illegal")}
                sums["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(own, own[1:]))
                n = len(own)
                made = {"part": [s["part"] for s in own], "segment": [s["segment"] for s in own], "ends": ends[::-1]} | {c: [v] + [None] * (n - 1) for c, v in {**sums, "cost": cost}.items()}
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).slice(k, 1).to_pylist() * n, cut_arrow.field(0).type), *[pa.array(made[f.name], f.type) for f in list(cut_arrow)[1:]]], schema=cut_arrow)

    cut_schema = T.StructType([conv, *T.StructType.fromDDL("part int, segment int, ends array<long>, blank long, duplicate long, truncated long, illegal long, cost long")])
    cut_arrow = to_arrow_schema(cut_schema)
    cut = written(parts.mapInArrow(cuts, cut_schema), "cuts")
    sums = cut.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    ended = _beside(segments, cut.select(*SEGMENT_KEY, "ends"), SEGMENT_KEY)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                codes, copies, _ = _coded(batch.column(3)[k].as_py())
                far = distances(codes, tuple(batch.column(4)[k].as_py()), copies)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(3)], pa.array([[walk(codes, far, q, copies)[1] for q in range(4)]], pa.list_(pa.int64()))], schema=exit_arrow)

    exit_schema = T.StructType([conv, *T.StructType.fromDDL("part int, segment int, exits array<long>")])
    exit_arrow = to_arrow_schema(exit_schema)
    maps = ended.mapInArrow(exits, exit_schema).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "segment", "exits"))).alias("maps"))
    # The states of entry follow one another: each is what the segment before makes of its own.
    step = lambda s, m: F.array_append(s, F.element_at(m["exits"], (F.element_at(s, -1) + 1).cast("int")))
    states = F.aggregate("maps", F.array(F.lit(START).cast("long")), step)
    entered = maps.select("conv_id", F.explode(F.arrays_zip("maps", F.slice(states, 1, F.size("maps")).alias("entries"))).alias("x"))
    entered = entered.select("conv_id", "x.maps.part", "x.maps.segment", F.col("x.entries").alias("entry"))
    entered = _beside(ended, written(entered, "entries"), SEGMENT_KEY)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                turns, state = batch.column(3)[k].as_py(), batch.column(5)[k].as_py()
                codes, copies, of = _coded(turns)
                far = distances(codes, tuple(batch.column(4)[k].as_py()), copies)
                letters = [""] * len(turns)
                before = [START] * len(turns)
                made = walk(codes, far, state, copies)[0]
                for j, edit, code in zip(of, made, codes):
                    if not letters[j]:
                        before[j] = state
                    letters[j] += edit
                    for letter in edit:
                        if letter != "D":
                            state = SYSTEM if letter == "K" and code.lower() == "s" else NEXT[state]
                n = len(turns)
                own = {"part": [batch.column(1)[k].as_py()] * n, "segment": [batch.column(2)[k].as_py()] * n, "edits": letters, "state": before} | {c: [t[c] for t in turns] for c in ("place", "turn", "role", "hash")}
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * n, edit_arrow.field(0).type), *[pa.array(own[f.name], f.type) for f in list(edit_arrow)[1:]]], schema=edit_arrow)

    edit_schema = T.StructType([conv, *T.StructType.fromDDL("part int, segment int, place int, turn long, role string, hash string, edits string, state int")])
    edit_arrow = to_arrow_schema(edit_schema)
    return written(entered.select(*SEGMENT_KEY, "turns", "ends", "entry").mapInArrow(edits, edit_schema), "edits"), sums


def _long_ones_repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of long conversations: (conv_id, part, segment, place, edits, state, role, text), where text is
    null if the turn goes, and the summary without audit and hash."""
    rows = rows.where("present").drop("present")
    edits, sums = _long_turns(rows, rows.schema["conv_id"])
    texts = rows.withColumn("hash", F.sha2("text", 256))
    kept = edits.where(F.col("edits").rlike("[KR]")).select(*KEY)
    # Equal turns are one text: any of them will do.
    kept = _beside(texts, kept.withColumn("is_kept", F.lit(True)), KEY).groupBy(*KEY).agg(F.first("text").alias("text"))
    numbers = rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    sums = _beside(sums, numbers, ["conv_id"], "left").fillna(0, ["gaps"])
    return _beside(edits, kept, KEY, "left"), sums


def _turns_made(letters: str, state: int, role: str, text: str | None) -> Iterator[tuple[str, str, int]]:
    for letter in letters:
        if letter != "D":
            state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[state]
            yield role if letter == "K" else ROLES[state], "" if letter == "I" else text, state


def _streamed(turns: DataFrame, conv: T.StructField) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of long conversations, a row at a time."""
    schema = T.StructType([conv, *T.StructType.fromDDL("audit string, repaired_sha256 string")])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, audit, digest, state, some = None, [], sha256(), START, False

        def add(role: str, text: str) -> None:
            nonlocal some
            digest.update(("\n" if some else "").encode() + role.encode() + b":" + text.encode())
            some = True

        def done() -> pa.RecordBatch:
            if END[state]:
                audit.append("I" * (END[state] // INSERT))
                for role, text, _ in _turns_made(audit[-1], state, "", None):
                    add(role, text)
            return pa.RecordBatch.from_arrays([pa.array([last[0]], arrow.field(0).type), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], schema=arrow)

        for batch in batches:
            for k in range(len(batch)):
                conv_id, letters, before, role, text = (batch.column(c)[k].as_py() for c in (0, 4, 5, 6, 7))
                if last is None or last[0] != conv_id:
                    if last is not None:
                        yield done()
                    last, audit, digest, state, some = (conv_id,), [], sha256(), START, False
                audit.append(letters)
                for r, t, state in _turns_made(letters, before, role, text):
                    add(r, t)
        if last is not None:
            yield done()

    order = ["conv_id", "part", "segment", "place"]
    return turns.select(*order, "edits", "state", "role", "text").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, schema)


def summaries(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_turns: int = LONG_TURNS) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    gaps: numbers missing between the least and the largest turn. blank, duplicate, truncated: turns by
    their first fault (no other than blanks; role and text of an earlier turn; no sentence end at the
    end). illegal: neighbours whose roles' initials aren't su, ua or au. A boolean column `present`, if
    there is one, takes rows out; a conversation without rows has zeros and nothing to repair. Null
    roles and texts are empty, null turns come first, rows of a null id are one conversation, equal
    turns go by role and text. Of an empty table nothing comes. Further columns are not read. The tables
    on the way are deleted; the result is a written table.
    """
    rows = _named(df, id_col, turn_col, role_col, text_col)
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    with scratch(df.sparkSession, "turns"):
        long_ = _long_ones(rows, long_turns)
        if long_.isEmpty():
            found = _whole_ones(rows).drop("turns")
        else:
            is_long = rows["conv_id"].eqNullSafe(long_["long_id"])
            turns, sums = _long_ones_repaired(rows.join(long_, is_long, "left_semi"))
            found = _whole_ones(rows.join(long_, is_long, "left_anti")).drop("turns")
            found = found.unionByName(_beside(_streamed(turns, rows.schema["conv_id"]), sums, ["conv_id"]).select("conv_id", *names))
        return written(found.select(F.col("conv_id").alias(id_col), *names), "repaired", keep=True)


def repaired(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_turns: int = LONG_TURNS) -> DataFrame:
    """(id, place, role, text): the turns of every conversation after its repair, place ascending (from 0
    on without gaps, but in conversations that were cut in segments). Awkward rows: see `summaries`; a
    conversation of which nothing is left has no rows."""
    rows = _named(df, id_col, turn_col, role_col, text_col)
    with scratch(df.sparkSession, "turns"):
        long_ = _long_ones(rows, long_turns)
        is_long = rows["conv_id"].eqNullSafe(long_["long_id"])
        found = _whole_ones(rows.join(long_, is_long, "left_anti")).select("conv_id", F.posexplode("turns").alias("place", "x")).select("conv_id", F.col("place").cast("long").alias("place"), "x.role", "x.text")
        if not long_.isEmpty():
            turns, _ = _long_ones_repaired(rows.join(long_, is_long, "left_semi"))
            # What follows the last turn is inserted after it.
            last = turns.groupBy("conv_id").agg(F.max_by(F.struct("part", "segment", "place"), F.struct("part", "segment", "place")).alias("at"))
            turns = _beside(turns, last, ["conv_id"])
            turns = turns.withColumn("ends", F.col("at") == F.struct("part", "segment", "place")).drop("at")
            found = found.unionByName(_exploded(turns, rows.schema["conv_id"]))
        return written(found.withColumnRenamed("conv_id", id_col), "repaired-turns", keep=True)


def _exploded(turns: DataFrame, conv: T.StructField) -> DataFrame:
    schema = T.StructType([conv, *T.StructType.fromDDL("place long, role string, text string")])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                conv_id, part, segment, place, letters, state, role, text, ends = (batch.column(c)[k].as_py() for c in range(9))
                made = []
                for r, t, state in _turns_made(letters, state, role, text):
                    made.append((r, t))
                if ends:
                    made += [(r, t) for r, t, _ in _turns_made("I" * (END[state] // INSERT), state, "", None)]
                if made:
                    at = (part << 40) + (segment * SEGMENT + place) * 8
                    yield pa.RecordBatch.from_arrays([pa.array([conv_id] * len(made), arrow.field(0).type), pa.array([at + j for j in range(len(made))], pa.int64()), pa.array([r for r, _ in made]), pa.array([t for _, t in made])], schema=arrow)

    return turns.select("conv_id", "part", "segment", "place", "edits", "state", "role", "text", "ends").mapInArrow(work, schema)


def _least(*keys: str) -> str:
    return f"least({', '.join(keys)})"


def _step(key: str, cost: str, letter: str) -> str:
    """The key (nine digits of cost, then the audit) one edit on; null if there is none."""
    return f"(lpad((left({key}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({key}, 10) || '{letter}')"


def _sql_states(t: tuple[str, ...]) -> str:
    """Columns s0 to s3 after a turn, from the keys t before it."""
    out = []
    for state in range(4):
        ways = [_step(t[state], "4", "D")]
        for p in BEFORE[state]:
            ways.append(f"CASE WHEN NOT forced THEN {_step(t[p], '3 + extra', 'R')} END")
        for initial, kept in KEPT.items():
            for p in kept.get(state, ()):
                ways.append(f"CASE WHEN NOT forced AND initial = '{initial}' THEN {_step(t[p], 'extra', 'K')} END")
        out.append(f"{_least(*ways) if len(ways) > 1 else ways[0]} AS s{state}")
    return ", ".join(out)


_USER = _least("s2", _step("s0", "3", "I"), _step("s1", "3", "I"), _step("s3", "3", "I"))
_INSERTED = f"s0 AS t0, s1 AS t1, {_USER} AS t2, {_least('s3', _step(_USER, '3', 'I'))} AS t3"

SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc FROM range(256) AS r(i)),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c // 256, crc[(xor(c % 256, b) + 1)::BIGINT]))) % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial
  FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM ordered),
judged AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM seen),
arcs AS (SELECT conv_id, i, initial, blank OR duplicate AS forced, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM judged),
states AS (
  SELECT conv_id, 0::BIGINT AS done, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_sql_states(("t0", "t1", "t2", "t3"))}
  FROM (SELECT a.conv_id, a.i, initial, forced, extra, {_INSERTED} FROM states s JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.i = s.done + 1)),
ends AS (
  SELECT conv_id, least(t0, t3) AS best FROM (SELECT conv_id, {_INSERTED} FROM states QUALIFY done = max(done) OVER (PARTITION BY conv_id))),
letters AS (
  SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS letter, generate_subscripts(string_split(substr(best, 10), ''), 1) AS place FROM ends WHERE length(best) > 9),
edited AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
kept AS (
  SELECT e.conv_id, e.place, e.letter, o, j.role, j.text, max(CASE WHEN o = 1 AND e.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS s
  FROM edited e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i AND e.letter <> 'I' WHERE e.letter <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS body FROM kept GROUP BY conv_id),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
