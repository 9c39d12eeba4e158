"""Folds in linear work, against plain loops; strategies refitted for every shuffle and fold."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluate, keyed, sampler, shuffles, strategies
from tallyforge.plans import registry
from tallyforge.sources import draws


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(5)
    rows = [(k, sorted(rng.sample(range(1, 34), 6)), rng.randint(1, 16)) for k in range(9000)]
    return rows, spark.createDataFrame(rows, "idx long, reds array<int>, blue int").repartition(4).cache()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("least", "val", "step", "train"), [(500, 200, 300, None), (0, 200, 300, 500), (30, 10, 7, None), (0, 40, 7, 90), (9000, 1, 1, None), (5, 2000, 3000, None)])
def test_ranges_are_the_lists(spark, least, val, step, train):
    n = 9000
    want = evaluate.expanding(n, least, val, step) if train is None else evaluate.rolling(n, train, val, step)
    assert [tuple(r) for r in evaluate.fold_range(spark, n, least, val, step, train).orderBy("fold").collect()] == want


@pytest.mark.parametrize(("half_life", "few"), [(0, 64), (700, 0)])
def test_picks_and_rates_are_those_of_loops(spark, history, half_life, few, monkeypatch):
    monkeypatch.setattr(evaluate, "FEW", few)
    rows, d = history
    folds = [(0, 0, 300, 300, 9000), (1, 4090, 4100, 4096, 4097), (2, 4095, 4097, 0, 8999), (3, 100, 5000, 5000, 8192), (4, 8990, 9000, 20, 20), (5, 8191, 8193, 8192, 8200), (6, 7, 8, 3, 11000)]
    table = evaluate.fold_table(spark, folds)
    picks = {r["fold"]: (r["reds"], r["blue"]) for r in evaluate.frequency_picks(d, table, half_life).collect()}
    want = {}
    for fold, _, _, lo, hi in folds:
        red, blue = {}, {}
        for idx, reds, b in rows[lo:hi]:
            w = 2 ** (-idx / half_life) if half_life else 1.0
            for r in reds:
                red[r] = red.get(r, 0) + w
            blue[b] = blue.get(b, 0) + w
        if red:
            first = lambda own: sorted(own, key=lambda k: (-round(own[k], 9), k))
            want[fold] = (sorted(first(red)[:6]), first(blue)[0])
    assert picks == want and 4 not in picks
    got = {r["fold"]: r for r in evaluate.evaluated(d, table, evaluate.frequency_picks(d, table, half_life)).collect()}
    for fold, lo, hi, _, _ in folds:
        if fold in want:
            own = rows[lo:hi]
            hits = [len(set(r) & set(want[fold][0])) for _, r, _ in own]
            assert (got[fold]["n"], got[fold]["red_hits"], got[fold]["blue_hits"]) == (len(own), sum(hits), sum(b == want[fold][1] for _, _, b in own))


def test_ten_thousand_folds_meet_few_draws(spark):
    """Work in proportion to draws and folds: no join without equal keys, and few rows met for each kept."""
    n = 40_000
    d = spark.range(n).select(F.col("id").alias("idx"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5)) + 1 + 5 * k).cast("int") for k in range(6)]).alias("reds"), (F.pmod(F.xxhash64("id"), F.lit(16)) + 1).cast("int").alias("blue"))
    folds = evaluate.fold_range(spark, n, 30, 10, 4).where("fold < 10000")  # training parts of up to all draws
    assert folds.count() > 9900
    picks = evaluate.frequency_picks(d, folds)
    met = evaluate.validated(d, folds)
    for made in (picks, met):
        assert "NestedLoop" not in plan_of(made) and "CartesianProduct" not in plan_of(made)
    assert met.count() == folds.count() * 10 and picks.count() == folds.count()
    rolling = evaluate.fold_range(spark, n, 0, 100, 4, 500).where("fold < 20")
    got = {r["fold"]: r["reds"] for r in evaluate.frequency_picks(d, rolling).collect()}
    for r in rolling.where("fold IN (0, 7, 19)").collect():
        counts = d.where((F.col("idx") >= r["train_lo"]) & (F.col("idx") < r["train_hi"])).select(F.explode("reds").alias("b")).groupBy("b").count().collect()
        assert got[r["fold"]] == sorted(c["b"] for c in sorted(counts, key=lambda c: (-c["count"], c["b"]))[:6])


@pytest.mark.parametrize("few", [0, 64])
def test_bounds_cut_draws_in_blocks(spark, few, monkeypatch):
    monkeypatch.setattr(evaluate, "FEW", few)
    d = spark.range(0, 10_000, 3).select(F.col("id").alias("idx"))
    bounds = [0, 1, 4095, 4096, 4097, 9999, 20_000]
    rows, at = evaluate.cut(d, spark.createDataFrame([(b,) for b in bounds * 2], "bound long"))
    assert {r["bound"]: r["segment"] for r in at.collect()} == {b: k + 1 for k, b in enumerate(bounds)}
    assert all(r["segment"] == sum(b <= r["idx"] for b in bounds) for r in rows.collect()) and rows.count() == d.count()


@pytest.mark.parametrize("name", sorted(keyed.KEYED))
def test_refitted_picks_are_the_strategys_own(spark, sf, name):
    """For the history itself and for a shuffle, each fold's pick is what the strategy makes of its draws."""
    d = draws.draws(spark, sf).where("idx < 330")
    d = d.join(d.agg(F.min("idx").alias("least")), F.lit(True)).withColumn("idx", F.col("idx") - F.col("least")).select("idx", "reds", "blue").cache()
    val, n_folds = 60, 3
    got = {(r["perm"], r["fold"]): r for r in keyed.refitted(d, keyed.KEYED[name], val, n_folds, 2).collect()}
    assert len(got) == 3 * n_folds
    placed = strategies.shuffled(d, 2, d.count()).join(d, "idx").select("perm", F.col("place").alias("idx"), "reds", "blue").cache()
    for perm, fold in ((0, 0), (1, 2)):
        own = placed.where(f"perm = {perm}").select("idx", "reds", "blue")
        start = (fold + 1) * val
        train = own.where(F.col("idx") >= start).withColumn("idx", F.col("idx") - start)
        want = strategies.STRATEGIES[name]()(train).first()
        r = got[perm, fold]
        assert (r["reds"], r["blue"]) == (want["reds"], want["blue"])
        part = own.where((F.col("idx") >= fold * val) & (F.col("idx") < start)).collect()
        assert r["hits"] == sum(len(set(x["reds"]) & set(want["reds"])) for x in part) and r["blue_hits"] == sum(x["blue"] == want["blue"] for x in part)


def test_ones_own_strategy_is_tested(spark, sf):
    """A strategy that knows the answers is never beaten by shuffles; one that always says the same ties."""
    d = draws.draws(spark, sf)
    fixed = keyed.Keyed(lambda rows: rows.withColumns({"reds": F.array(*map(F.lit, range(1, 7))), "pick": F.lit(1)}))
    got = keyed.permutation_test(d, fixed, n_perm=20).first()
    newest = d.orderBy("idx").limit(14 * 4).collect()
    assert got["observed"] == pytest.approx(sum(len(set(r["reds"]) & set(range(1, 7))) for r in newest) / 56) and 0 <= got["p"] <= 1
    assert keyed.permutation_test(d.where("idx < 5"), "greedy").first()["p"] == 1.0


def test_members_are_one_query_and_failures_are_told(spark, sf, monkeypatch):
    d = draws.draws(spark, sf).where("idx < 200").cache()
    e = strategies.Ensemble(spark)
    fixed = lambda b: lambda own: own.limit(1).select(F.array(*map(F.lit, range(b, b + 6))).alias("reds"), F.lit(b).alias("blue"))
    for name, b in {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}.items():
        e.add(name, fixed(b))
    asked, plain = [], strategies.Ensemble._collected
    monkeypatch.setattr(strategies.Ensemble, "_collected", lambda self, plans: (asked.append(len(plans)), plain(self, plans))[1])
    assert {r["member"]: r["blue"] for r in e.picks(d).collect()} == {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5} and not e.failed
    assert asked == [5]
    e.add("raises", lambda own: 1 / 0)
    e.add("no column", lambda own: own.select("nothing"))
    e.add("fails in a task", lambda own: own.limit(1).select(F.raise_error(F.lit("lost")).cast("string").alias("r"), "reds", "blue").select(F.when(F.col("r") == "", F.col("reds")).alias("reds"), "blue"))
    e.add("empty", lambda own: own.where("idx < 0").select("reds", "blue"))
    assert {r["member"] for r in e.picks(d).collect()} == {"one", "two", "three", "four", "five"}
    assert set(e.failed) == {"raises", "no column", "fails in a task"} and "lost" in str(e.failed["fails in a task"])
    assert asked == [5, 7, *[1] * 7]


def test_numbers_of_the_chain_come_from_counters():
    assert sampler.uniform(7, 0, 1) == sampler.uniform("7", "0", "1") != sampler.uniform(7, 1, 0)
    drawn = [sampler.uniform(1, k) for k in range(4000)]
    assert 0 <= min(drawn) and max(drawn) < 1 and abs(sum(drawn) / 4000 - 0.5) < 0.02
    kinds = {0: 0, 1: 0, 2: 0}
    for k in range(3000):
        reds, blue = sorted({1 + (k * j) % 33 for j in (1, 5, 8, 11, 17, 23)} | set(range(20, 33)))[:6], k % 16 + 1
        new, b = sampler.moved(reds, blue, lambda j, k=k: sampler.uniform("m", k, j))
        apart = len(set(reds) - set(new))
        kinds[apart] += 1
        assert len(set(new)) == 6 and new == sorted(new) and 1 <= b <= 16 and (apart == 0) == (b != blue) and set(new) <= set(range(1, 34))
    assert all(abs(kinds[a] / 3000 - share) < 0.04 for a, share in ((1, 0.5), (2, 0.3), (0, 0.2)))


def test_keys_in_vectors_are_md5():
    for prefix, idx in ((b"1:7:", [0, 5, 9]), (b"1:500:", [1234567, 7654321]), (b"9223372036854775807:1000000:", [10**18, 10**18 + 7])):
        digits = np.array([[ord(x) for x in str(i)] for i in idx], np.uint32).T
        got = ["".join(f"{w:08x}" for w in row) for row in zip(*shuffles.md5(prefix, digits))]
        assert got == [hashlib.md5(prefix + str(i).encode()).hexdigest() for i in idx]


def test_certain_folds_and_bands_are_the_order(spark):
    """A history long enough that most folds are certain from the key, against the sorted shuffles."""
    n, val, folds = 60_000, 2000, 3
    d = spark.range(n).select(F.col("id").alias("idx"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (k * 5 + 1 + F.col("id") % 5).cast("int")).alias("reds"), (F.col("id") % 16 + 1).cast("int").alias("blue"))
    cut = shuffles.bands(n, [2000, 4000, 6000], 0)
    assert len(cut) == 3 and sum(hi - lo for lo, hi, _ in cut) < 2**64 * 0.06
    got = {(r["perm"], r["fold"]): r["c"] for r in shuffles.fold_counts(d, n, val, folds, 2, 1, False, 0, 0.0).collect()}
    placed = strategies.shuffled(d, 2, val * folds).join(d, "idx").select("perm", F.floor(F.col("place") / val).alias("fold"), F.explode(F.concat(F.transform("reds", lambda b: b - 1), F.array(F.col("blue") + 32))).alias("slot"))
    want = {k: [0] * 49 for k in got}
    for r in placed.groupBy("perm", "fold", "slot").count().collect():
        want[r["perm"], r["fold"]][r["slot"]] = r["count"]
    assert len(got) == 9 and got == want


@pytest.mark.parametrize("name", ["G5_association_strategy", "V5_run_cv", "V6_walk_forward"])
def test_draws_are_made_once(spark, sf, name):
    """Queries that read the draws several times read them from the shared folder, lineitem not again."""
    read = registry.QUERIES[name](spark, sf).inputFiles()
    assert read and not any("lineitem" in f for f in read)
