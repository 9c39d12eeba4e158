"""Divergence of sources: against SQL, against a plain version, and exact at any size."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import divergence, queries

COLUMNS = "text string, lang string, source string, n int, vector string, copies int, term string"


def plain(rows, least=30, top=50):
    """(lang, source, part, item, value, rank) by loops over everything."""
    rows = [tuple(v or "" for v in r[:3]) for r in rows]
    found = [[t.translate(str.maketrans(divergence.UPPER, divergence.UPPER.lower())) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for text, _, _ in rows]
    out = []
    for lang in sorted({r[1] for r in rows}):
        within = Counter(t for r, f in zip(rows, found) if r[1] == lang for t in set(f))
        kept = sorted(t for t, n in within.items() if n >= least)
        counts = {s: Counter() for _, g, s in rows if g == lang}
        for r, f in zip(rows, found):
            if r[1] == lang:
                counts[r[2]].update(t for t in f if t in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, s, part, item, v, k + 1) for part, items in (("pair", pairs), ("term", terms)) for k, (item, v) in enumerate(items)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["The", "the", "ÉTÉ", "été", "日本", "a", "x1y", "don't", "𝔘", "naïve", "of", "z" * 3000]
    made = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "EN", None, ""]), rng.choice(["s1", "s2", "é", None, "S"]), 1, "v", 2, "t") for _ in range(400)]
    made += made[:50]
    made += [(None, "xx", "only", 1, "v", 2, "t"), ("", "yy", "b", 1, "v", 2, "t"), ("1 2", "yy", "a", 1, "v", 2, "t"), ("the " * 50_000, "en", "s1", 1, "v", 2, "t"), ("q" * 60_000, "en", "s2", 1, "v", 2, "t"), ("a\x00b", "en", "s1", 1, "v", 2, "t")]
    return made


def test_audit_is_the_plain_version(spark, rows):
    got = divergence.audit(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = sorted(map(tuple, got.collect()))
    assert found == plain(rows)
    assert {r[4] for r in found if r[0] == "yy"} == {0} and not [r for r in found if r[0] == "xx"]
    c = duckdb.connect()
    c.register("documents", pa.table({n: [r[k] for r in rows] for k, n in enumerate(("text", "lang", "source"))}))
    assert sorted(c.sql(divergence.SQL).fetchall()) == found


def test_small_pieces_give_the_same(spark, rows):
    few = [r for r in rows if len(r[0] or "") < 1000][:150]
    got = divergence.audit(spark.createDataFrame(few, COLUMNS).repartition(5), least=3, top=2)
    assert sorted(map(tuple, got.collect())) == plain(few, 3, 2)
    assert divergence.audit(spark.createDataFrame([], COLUMNS)).count() == 0


def test_query_is_its_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, queries.op11_divergence(spark, sf).collect())) == sorted(c.sql(divergence.SQL).fetchall())


def test_cut_texts_and_full_memories_lose_nothing(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é1") for _ in range(200)).encode() for _ in range(30)] + [b"", b"x" * 500, b" " * 300, b" " + b"y" * 300]
    want = [t.translate(divergence._LETTERS).split() for t in texts]
    monkeypatch.setattr(divergence, "CUT", 7)
    assert [sum(divergence._terms(t), []) for t in texts] == want
    monkeypatch.setattr(divergence, "HELD", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([("p", "q")[k % 2] for k in range(len(texts))]), pa.array(["s"] * len(texts))], names=["text", "lang", "source"])
    sums, docs, groups = Counter(), Counter(), set()
    sent = list(divergence._added_up(iter([batch, batch.slice(3, 4)])))
    assert len(sent) > 10
    for b in sent:
        for r in b.to_pylist():
            groups.add((r["lang"], r["source"]))
            if r["term"] is not None:
                sums[r["lang"], r["term"].encode()] += r["n"]
                docs[r["lang"], r["term"].encode()] += r["docs"]
    used = [*range(len(texts)), 3, 4, 5, 6]
    assert sums == Counter((("p", "q")[k % 2], t) for k in used for t in want[k])
    assert docs == Counter((("p", "q")[k % 2], t) for k in used for t in set(want[k])) and groups == {("p", "s"), ("q", "s")}


def test_pairs_of_many_sources_are_those_of_all_terms(monkeypatch):
    monkeypatch.setattr(divergence, "ROWS", 7)
    monkeypatch.setattr(divergence, "SOURCES", 3)
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 4, (40, 8)) * rng.integers(0, 2, (40, 8))
    copies = rng.integers(1, 9, 40)
    wholes = (dense * copies[:, None]).sum(0) + 5 * copies.sum()
    row, at = np.nonzero(dense)
    offsets = np.searchsorted(row, np.arange(41))
    got = {(i, j): v for block in divergence.pair_sums(offsets, at, dense[row, at], copies, wholes) for i, j, v in zip(*(x.tolist() for x in block))}
    p = [[1 + 10**9 * (int(c) + 5) // int(w) for c, w in zip(r, wholes)] for r in dense]
    assert got == {(i, j): sum(int(m) * abs(r[i] - r[j]) for m, r in zip(copies, p)) for i in range(8) for j in range(i + 1, 8)}


def test_shares_are_exact_at_any_size():
    rng = random.Random(5)
    for top in (100, 10**9, 10**15, 9 * 10**18):
        wholes = [rng.randint(top // 2, top) for _ in range(200)]
        counts = [rng.randint(0, w - 5) for w in wholes]
        assert [int(v) for v in divergence.shares(np.array(counts), np.array(wholes))] == [1 + 10**9 * (c + 5) // w for c, w in zip(counts, wholes)]
