"""Fixed examples, invariants and edge cases of the draw operators."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import rows
from tallyforge.operators import energy, evaluate, sequence, stats
from tallyforge.plans import sequence_queries
from tallyforge.sources import draws, history

DRAW = "idx long, draw_no long, draw_date date, weekday string, reds array<int>, draw_order array<int>, blue int, sales long, jackpot long, first_prize_count int"


def make(spark, reds, blue=11):
    return spark.createDataFrame([(k, 100 - k, None, None, r, r, blue, 0, 0, 0) for k, r in enumerate(reds)], DRAW)


@pytest.mark.parametrize(
    ("reds", "total", "span", "std", "median", "ac", "pairs", "primes", "tails", "distance"),
    [
        ([1, 3, 11, 22, 26, 31], 94, 30, 11.396881, 16.5, 10, 0, 3, 4, 5),
        ([1, 2, 5, 6, 7, 30], 51, 29, 9.844626, 5.5, 6, 3, 3, 6, 3),
        ([1, 2, 3, 11, 12, 21], 50, 20, 7.110243, 7.0, 4, 3, 3, 3, 4),
        ([3, 10, 17, 24, 28, 31], 113, 28, 9.923317, 20.5, 4, 0, 3, 6, 3),
    ],
)
def test_row_features(spark, reds, total, span, std, median, ac, pairs, primes, tails, distance):
    d = make(spark, [reds]).select(*[c.alias(n) for n, c in {**rows.basic(), **rows.advanced()}.items()]).first()
    assert (d["red_sum"], d["red_span"], d["red_median"], d["red_ac"]) == (total, span, median, ac)
    assert d["red_std"] == pytest.approx(std, abs=1e-6)
    assert (d["consecutive_pairs"], d["prime_count"], d["unique_tails"], d["prime_distance_sum"]) == (pairs, primes, tails, distance)
    assert len(rows.basic()) == 31 and len(rows.advanced()) == 49


def test_halo_equals_global_window(spark, sf, monkeypatch):
    d = draws.draws(spark, sf)
    wide = {tuple(r) for r in sequence.followed(d, "vol", (13, 52)).collect()}
    monkeypatch.setattr(sequence, "BLOCK", 53)
    narrow = {tuple(r) for r in sequence.followed(d, "vol", (13, 52)).collect()}
    assert {tuple(x if x is None else round(x, 9) for x in r) for r in wide} == {tuple(x if x is None else round(x, 9) for x in r) for r in narrow}


def test_streak_means_gap_of_one(spark, sf):
    d = draws.draws(spark, sf)
    both = sequence.ball_streaks(d).join(sequence.ball_gaps(d), ["idx", "ball"]).where(F.col("idx") < 300)
    assert both.where((F.col("streak") > 0) != (F.col("gap") == 1)).count() == 0


def test_draws_keep_their_invariants(spark, sf):
    d = draws.draws(spark, sf)
    n = d.count()
    assert d.where((F.size("reds") != 6) | (F.size(F.array_distinct("reds")) != 6) | ~F.col("blue").between(1, 16)).count() == 0
    assert d.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first() == (0, n - 1, n)


def test_rows_of_the_undecayed_conditional_sum_to_five(spark, sf):
    sums = stats.conditional(draws.draws(spark, sf)).groupBy("a").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 33 and all(r["s"] == pytest.approx(5) for r in sums)


def test_empty_and_single_histories(spark):
    none = make(spark, [])
    assert stats.frequencies(none).agg(F.sum("weight")).first()[0] == 0
    assert sequence.missing(none).count() == 0
    one = make(spark, [[1, 2, 3, 4, 5, 6]])
    m = sequence.missing(one).first()
    assert m["red_max_missing"] == 1 and m["blue_missing"] == 1
    assert sequence.streaks(one).first()["red_max_positive_streak"] == 0
    assert sequence.repeats(one).first()["repeat_red_count"] == 0
    assert sequence.followed(one, "ema", (5,)).first()["ema_5_sum"] is None


def test_constant_column_has_no_correlation(spark, sf):
    r = {(x["x"], x["y"]): x["r"] for x in stats.correlation(draws.draws(spark, sf), {"one": F.lit(1), "blue": F.col("blue")}).collect()}
    assert r["one", "blue"] == 0 and r["one", "one"] == 1


def test_enumeration_and_marginals(spark, sf):
    assert energy.combinations(spark).count() == 1_107_568
    m = energy.fit(draws.draws(spark, sf))
    p = energy.marginal_exact(spark, m).collect()
    assert sum(r["p"] for r in p) == pytest.approx(6)


def test_folds():
    assert len(evaluate.expanding(100, 30, 10, 10)) == 7
    assert evaluate.anchored(100, (0.7, 0.85)) == [(0, 0, 70, 70, 100), (1, 0, 85, 85, 100)]
    assert evaluate.walk_forward(300, 3, 0.8)[0][2] == 19  # as floats have it
    assert pytest.approx(0.0577193, abs=1e-7) == evaluate.P_THREE


def test_binomial_tail(spark):
    t = {r["k"]: r["tail"] for r in evaluate.binomial_tail(spark, 100, 0.18).collect()}
    assert t[25] == pytest.approx(0.0495607, abs=1e-6) and t[0] == pytest.approx(1)
    assert math.isfinite(evaluate.binomial_tail(spark, 3000, 0.5).agg(F.max("tail")).first()[0])


def test_calibration_edges(spark):
    t = {r["bin"]: r for r in evaluate.calibration(spark.createDataFrame([(1.0, 1.0), (0.05, 0.0)], "p double, y double")).collect()}
    assert t[9]["n"] == 1 and t[5]["predicted"] == pytest.approx(0.55) and t[5]["n"] == 0
    empty = evaluate.calibration(spark.createDataFrame([], "p double, y double"))
    assert evaluate.calibration_error(empty).first()["ece"] == 1


def test_disagreement_of_one_pick(spark):
    assert tuple(evaluate.disagreement(make(spark, [[1, 2, 3, 4, 5, 6]])).first()) == (0.0, 0.0)


def test_history_files(spark, tmp_path):
    assert history.load_history(spark, str(tmp_path / "none.json")).count() == 0
    f = tmp_path / "h.json"
    f.write_text('[{"期号": "2024001", "开奖日期": "2024-01-02", "红球": "03 01  2 10 20 33", "蓝球": "07"}, {"期号": "2024002", "红球": "1 2 3 4 5 6", "蓝球": "1", "销售额": "", "开奖日期": "bad"}]')
    got = {r["draw_no"]: r for r in history.parse(history.load_history(spark, str(f))).collect()}
    assert got[2024001]["reds"] == [1, 2, 3, 10, 20, 33] and got[2024001]["draw_order"] == [3, 1, 2, 10, 20, 33]
    assert got[2024002]["sales"] == 0 and got[2024002]["draw_date"] is None


def test_saved_versions(spark, sf, tmp_path):
    raw = history.raw(draws.draws(spark, sf))
    path = history.save(raw, f"file://{tmp_path}", "1")
    assert spark.read.json(path).count() == raw.count()
    assert history.append(raw, raw.select("issue", "reds")).count() == 2 * raw.count()


def test_windows_over_given_features(spark):
    """Values with a large common part, nulls, and blocks' ends, against loops."""
    rng = random.Random(3)
    values = [None if k % 97 == 5 else 1e9 + rng.random() for k in range(2100)]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "idx long, v double").repartition(3)
    plain = [0.0 if v is None else v for v in values]
    for kind in ("ema", "trend", "vol", "delta"):
        got = {r["idx"]: r[1] for r in sequence.followed(d, kind, (20,), {"v": F.col("v")}).collect()}
        for k in (0, 1, 500, 1010, 1023, 1024, 1025, 2047, 2078, 2096, 2097, 2098, 2099):
            own = plain[k + 1 : k + 21]
            want = None
            if kind == "delta":
                want = plain[k] - plain[k + 20] if k + 20 < len(plain) else None
            elif kind == "ema" and own:
                want = own[0]
                for v in own[1:]:
                    want = 2 / 21 * v + 19 / 21 * want
            elif kind == "vol" and len(own) >= 2:
                want = float(np.std(own))
            elif kind == "trend" and len(own) >= 3:
                want = float(np.polyfit(range(len(own)), own, 1)[0])
            assert got[k] == (want if want is None else pytest.approx(want, rel=1e-6, abs=1e-4)), (kind, k)


def test_given_slopes_that_end_in_half_a_place(spark, monkeypatch):
    """Slopes of sf0.1: regr_slope brings the first to the other side of the half, F.round the second."""
    series = {
        5470: [1076779, 1275172, 587650, 1066396, 558713, 616057, 524857, 693438, 835229, 785271, 615387, 1254159, 826902],
        7736: [1005168, 708310, 976807, 734182, 856438, 628836, 1068336, 1242584, 1104074, 1019122, 919464, 735947, 869675],
    }
    d = [(k + i, v, 0) for k, values in series.items() for i, v in enumerate([0, *values])]
    monkeypatch.setattr(sequence_queries, "draws", lambda spark, sf_dir: spark.createDataFrame(d, "idx long, sales long, jackpot long"))
    got = {r["idx"]: r["trend_13_sales"] for r in sequence_queries.QUERIES["T4_trend_given"](spark, "").collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE given_money (idx BIGINT, sales DOUBLE, jackpot DOUBLE)")
    duck.executemany("INSERT INTO given_money VALUES (?, ?, ?)", [(i, v / 1e6, j / 1e6) for i, v, j in d])
    sql = sequence_queries.SQL["T4_trend_given"].removeprefix(sequence_queries._GIVEN)
    want = dict(duck.sql(f"SELECT idx, trend_13_sales FROM ({sql})").fetchall())
    assert {k: got[k] for k in series} == {k: want[k] for k in series} == {5470: -0.009375, 7736: 0.005823}


def test_upper_tail_of_rows(spark):
    rows_ = spark.createDataFrame([(25, 100), (0, 7), (8, 7), (60, 200), (1500, 3000)], "h long, n long")
    got = [r[0] for r in rows_.select(evaluate.upper_tail(F.col("h"), F.col("n"), 0.18)).collect()]
    want = [sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(0.18) + (n - k) * math.log(0.82)) for k in range(h, n + 1)) for h, n in ((25, 100), (0, 7), (8, 7), (60, 200), (1500, 3000))]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300) and got[2] == 0
