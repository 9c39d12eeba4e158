"""Queries of the windows over the sequence, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows
from ..operators import sequence as sq
from ..sources.draws import SQL_DRAWS, draws

WINDOWS = (13, 52)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places, without a negative zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_product(df: DataFrame, places: int = 6) -> DataFrame:
    """As `rounded`, by the product with the power of ten, which is how the SQL's engine rounds. F.round
    goes by the decimal digits of a double: 5.8224999999999996e-3, whose product is 5822.5, goes down."""
    scale = 10.0**places
    return df.select(*[(F.round(F.col(c) * scale) / scale + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.followed(draws(spark, sf_dir), "ema", WINDOWS))


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.followed(draws(spark, sf_dir), "trend", WINDOWS))


def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.followed(draws(spark, sf_dir), "vol", WINDOWS))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sq.followed(draws(spark, sf_dir), "delta", (1, 2, 3))
    return out.select("idx", *[F.col(c).cast("double").alias(c) for c in out.columns[1:]])


#: Features that a user gives: money in millions.
MONEY = ("sales", "jackpot")


def _given(kind: str, windows: tuple[int, ...] = WINDOWS):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded_product(sq.followed(draws(spark, sf_dir), kind, windows, {n: F.col(n) / 1e6 for n in MONEY}))

    query.__doc__ = f"T3-T6 over given features: {kind} of sales and jackpot, in millions."
    return query


def simple_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(spark, sf_dir).select("idx", *[c.alias(n) for n, c in rows.simple().items()])


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.missing(draws(spark, sf_dir)))


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sq.overlap(draws(spark, sf_dir), (10, 30))
    return rounded(out.select("idx", *[F.col(c).cast("double").alias(c) for c in out.columns[1:]]))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.repeats(draws(spark, sf_dir)))


def hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.hotness_of_all(draws(spark, sf_dir)))


def hot_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the newest draw, whose window is the 150 draws before it."""
    return rounded(sq.hot_cold(sq.hotness(draws(spark, sf_dir).where("idx <= 150"), F.col("idx") == 0)))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.intervals(draws(spark, sf_dir), 0))


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.streaks(draws(spark, sf_dir))


def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.money(draws(spark, sf_dir)).select("idx", "sales_mean", "sales_std", "jackpot_mean", "jackpot_std"), 2)


def financial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.money(draws(spark, sf_dir)).select("idx", *[c.alias(n) for n, c in rows.financial().items()]))


def first_prizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sq.first_prizes(draws(spark, sf_dir)))


_AC = "(len(list_distinct([" + ", ".join(f"reds[{j}]-reds[{i}]" for i in range(1, 7) for j in range(i + 1, 7)) + "])) - 5)::INT"
_SIMPLE = SQL_DRAWS + f", simple AS (SELECT idx, list_sum(reds)::INT AS sum, reds[6] - reds[1] AS span, len(list_filter(reds, lambda x: x % 2 = 1))::INT AS odd_count, {_AC} AS ac, blue FROM draws)\n"
_NAMES = ("sum", "span", "odd_count", "ac", "blue")


def _each(make) -> str:
    return ", ".join(f"{make(n, w)}" for w in WINDOWS for n in _NAMES)


_GRID = """, grid AS (SELECT idx, ball, list_contains(reds, ball) AS hit FROM draws, dim_red)
"""
_Z = """, picked AS ({picked}), pair AS (SELECT p.idx, d.idx - p.idx - 1 AS age, d.reds, d.blue FROM picked p JOIN draws d ON d.idx > p.idx AND d.idx <= p.idx + 150),
eff AS (SELECT idx, sum(exp(-ln(2.0::DOUBLE) * age / 50)) AS e, count(*) AS n FROM pair GROUP BY idx),
hits AS (SELECT idx, 'red' AS colour, unnest(reds) AS ball, exp(-ln(2.0::DOUBLE) * age / 50) AS w FROM pair UNION ALL SELECT idx, 'blue', blue, exp(-ln(2.0::DOUBLE) * age / 50) FROM pair),
sums AS (SELECT idx, colour, ball, sum(w) AS w FROM hits GROUP BY ALL),
pool AS (SELECT 'red' AS colour, ball, 6.0::DOUBLE / 33 AS p FROM dim_red UNION ALL SELECT 'blue', ball, 1.0::DOUBLE / 16 FROM dim_blue),
z AS (SELECT e.idx, colour, ball, (coalesce(w, 0) / e - p) / sqrt(p * (1 - p) / e) AS z FROM eff e CROSS JOIN pool LEFT JOIN sums USING (idx, colour, ball) WHERE n >= 10 AND e >= 10)
"""

#: Classes of all balls at the newest draw.
CLASSES = _Z.format(picked="SELECT 0::BIGINT AS idx") + ", cl AS (SELECT colour, ball, CASE WHEN round(z, 9) >= 2 THEN 'hot' WHEN round(z, 9) >= 0.5 THEN 'warm' WHEN round(z, 9) >= -0.5 THEN 'neutral' WHEN round(z, 9) >= -1.5 THEN 'cool' ELSE 'cold' END AS class FROM z)"

QUERIES = {
    "T3_ema_given": _given("ema"), "T4_trend_given": _given("trend"), "T5_volatility_given": _given("vol"), "T6_changes_given": _given("delta", (1, 5)),
    "T3_ema": ema, "T4_trend": trend, "T5_volatility": volatility, "T6_recent_changes": changes, "T7_missing_values": missing, "T8_overlap": overlap, "T9_repeats": repeats, "T10_simple_features": simple_features,
    "T12_hotness": hotness, "P4_hot_cold": hot_cold, "T13_intervals": intervals, "T14_streaks": streaks, "T15_financial_stats": money, "F21_financial": financial, "T16_first_prizes": first_prizes,
}
_MONEY = ", ".join(f"CASE WHEN count(*) OVER w >= 2 THEN CASE WHEN count(nullif({x}, 0)) OVER w >= 2 THEN {f}(CASE WHEN {x} > 0 THEN {x} END) OVER w ELSE {e} END END AS {x}_{n}" for x in ("sales", "jackpot") for f, n, e in (("avg", "mean", "0.0::DOUBLE"), ("stddev_pop", "std", "1.0::DOUBLE")))
_MONEY = f", money2 AS (SELECT idx, sales, jackpot, {_MONEY} FROM draws WINDOW w AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING))\n"
_GIVEN = SQL_DRAWS + ", given_money AS (SELECT idx, " + ", ".join(f"{n} / 1000000.0::DOUBLE AS {n}" for n in MONEY) + " FROM draws)\n"
_FRAMES = " FROM given_money WINDOW " + ", ".join(f"w{w} AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING)" for w in WINDOWS)
SQL = {
    "T3_ema_given": _GIVEN + "SELECT idx, " + ", ".join(f"round(CASE WHEN len(l{w}_{n}) > 0 THEN list_reduce(l{w}_{n}, lambda a, v: (2.0::DOUBLE / {w + 1}) * v + (1 - 2.0::DOUBLE / {w + 1}) * a) END, 6) + 0.0 AS ema_{w}_{n}" for w in WINDOWS for n in MONEY) + " FROM (SELECT idx, " + ", ".join(f"coalesce(list({n}) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING), []) AS l{w}_{n}" for w in WINDOWS for n in MONEY) + " FROM given_money)",
    "T4_trend_given": _GIVEN + "SELECT idx, " + ", ".join(f"round(CASE WHEN count(*) OVER w{w} >= 3 THEN regr_slope({n}, idx) OVER w{w} END, 6) + 0.0 AS trend_{w}_{n}" for w in WINDOWS for n in MONEY) + _FRAMES,
    "T5_volatility_given": _GIVEN + "SELECT idx, " + ", ".join(f"round(CASE WHEN count(*) OVER w{w} >= 2 THEN stddev_pop({n}) OVER w{w} END, 6) + 0.0 AS vol_{w}_{n}" for w in WINDOWS for n in MONEY) + _FRAMES,
    "T6_changes_given": _GIVEN + "SELECT idx, " + ", ".join(f"round({n} - lead({n}, {k}) OVER (ORDER BY idx), 6) + 0.0 AS delta_{k}_{n}" for k in (1, 5) for n in MONEY) + " FROM given_money",
    "T3_ema": _SIMPLE + "SELECT idx, " + _each(lambda n, w: f"round(CASE WHEN len(l{w}_{n}) > 0 THEN list_reduce(l{w}_{n}, lambda a, v: (2.0::DOUBLE / {w + 1}) * v + (1 - 2.0::DOUBLE / {w + 1}) * a) END, 6) + 0.0 AS ema_{w}_{n}") + " FROM (SELECT idx, " + _each(lambda n, w: f"coalesce(list({n}::DOUBLE) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING), []) AS l{w}_{n}") + " FROM simple)",
    "T4_trend": _SIMPLE + "SELECT idx, " + _each(lambda n, w: f"round(CASE WHEN count(*) OVER w{w} >= 3 THEN regr_slope({n}, idx) OVER w{w} END, 6) + 0.0 AS trend_{w}_{n}") + " FROM simple WINDOW " + ", ".join(f"w{w} AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING)" for w in WINDOWS),
    "T5_volatility": _SIMPLE + "SELECT idx, " + _each(lambda n, w: f"round(CASE WHEN count(*) OVER w{w} >= 2 THEN stddev_pop({n}) OVER w{w} END, 6) + 0.0 AS vol_{w}_{n}") + " FROM simple WINDOW " + ", ".join(f"w{w} AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING)" for w in WINDOWS),
    "T6_recent_changes": _SIMPLE + "SELECT idx, " + ", ".join(f"({n} - lead({n}, {k}) OVER (ORDER BY idx))::DOUBLE AS delta_{k}_{n}" for k in (1, 2, 3) for n in _NAMES) + " FROM simple",
    "T7_missing_values": SQL_DRAWS + _GRID + """, sight AS (SELECT idx, ball, hit, min(CASE WHEN hit THEN idx END) OVER w AS last, count(*) OVER w AS n FROM grid WINDOW w AS (PARTITION BY ball ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 200 FOLLOWING)),
gaps AS (SELECT idx, hit, coalesce(last - idx, n + 1) AS g FROM sight),
m AS (SELECT idx, avg(g) AS m, stddev_pop(g) AS sd FROM gaps GROUP BY idx),
s AS (SELECT idx, avg(g) FILTER (hit) AS a, max(g) FILTER (hit) AS mx, min(g) FILTER (hit) AS mn, any_value(m) AS m, any_value(sd) AS sd, avg((g - m) ** 3) / greatest(any_value(sd) ** 3, 0.001) AS sk, count(*) FILTER (hit AND g <= 3) AS hot, count(*) FILTER (hit AND g >= 20) AS cold FROM gaps JOIN m USING (idx) GROUP BY idx),
b AS (SELECT d.idx, coalesce(min(e.idx) - d.idx, least(200, any_value(n) - d.idx - 1) + 1) AS bm FROM draws d CROSS JOIN n_draws LEFT JOIN draws e ON e.blue = d.blue AND e.idx > d.idx AND e.idx <= d.idx + 200 GROUP BY d.idx)
SELECT idx, round(a, 6) + 0.0 AS red_avg_missing, mx AS red_max_missing, mn AS red_min_missing, bm AS blue_missing, round(m, 6) + 0.0 AS global_avg_missing, round(sd, 6) + 0.0 AS global_missing_std, round(sk, 6) + 0.0 AS missing_skew, hot AS hot_red_count, cold AS cold_red_count FROM s JOIN b USING (idx)""",
    "T8_overlap": SQL_DRAWS + ", p AS (SELECT d.idx, e.idx - d.idx AS k, len(list_intersect(d.reds, e.reds)) AS o, list_sum(d.reds) - list_sum(e.reds) AS df FROM draws d LEFT JOIN draws e ON e.idx > d.idx AND e.idx <= d.idx + 30) SELECT idx, " + ", ".join(f"round(avg(o) FILTER (k <= {w}), 6) + 0.0 AS sim_{w}_avg_overlap, (max(o) FILTER (k <= {w}))::DOUBLE AS sim_{w}_max_overlap, round(avg(df) FILTER (k <= {w}), 6) + 0.0 AS sim_{w}_avg_sum_diff, (max(o) FILTER (k <= {w}) >= 5)::INT::DOUBLE AS sim_{w}_has_identical" for w in (10, 30)) + " FROM p GROUP BY idx",
    "T9_repeats": SQL_DRAWS + "SELECT d.idx, coalesce(len(list_intersect(d.reds, e.reds)), 0)::INT AS repeat_red_count, round(coalesce(len(list_intersect(d.reds, e.reds)), 0) / 6.0::DOUBLE, 6) + 0.0 AS repeat_ratio, coalesce((d.blue = e.blue)::INT, 0) AS repeat_blue FROM draws d LEFT JOIN draws e ON e.idx = d.idx + 1",
    "T10_simple_features": _SIMPLE + "SELECT * FROM simple",
    "T12_hotness": SQL_DRAWS + _Z.format(picked="SELECT idx FROM draws") + "SELECT idx, colour, ball, round(z, 6) + 0.0 AS z FROM z",
    "P4_hot_cold": SQL_DRAWS + _Z.format(picked="SELECT 0::BIGINT AS idx") + "SELECT idx, colour, ball, round(z, 6) + 0.0 AS z, CASE WHEN round(z, 9) >= 2 THEN 'hot' WHEN round(z, 9) >= 0.5 THEN 'warm' WHEN round(z, 9) >= -0.5 THEN 'neutral' WHEN round(z, 9) >= -1.5 THEN 'cool' ELSE 'cold' END AS class FROM z",
    "T13_intervals": SQL_DRAWS + ", part AS (SELECT idx - 1 AS gap, reds FROM draws WHERE idx BETWEEN 1 AND 200), n AS (SELECT count(*) AS n FROM part), hits AS (SELECT gap, unnest(reds) AS ball FROM part), lagged AS (SELECT ball, gap, gap - lag(gap) OVER (PARTITION BY ball ORDER BY gap) AS step FROM hits), s AS (SELECT ball, max(gap) AS oldest, avg(step) AS mean FROM lagged GROUP BY ball), r AS (SELECT ball, coalesce(n - oldest, n + 1) AS age, coalesce(mean, 5.5::DOUBLE) AS mean FROM dim_red CROSS JOIN n LEFT JOIN s USING (ball) WHERE n >= 10) SELECT ball, age AS age_of_oldest, round(mean, 6) + 0.0 AS avg_interval, round(age / mean, 6) + 0.0 AS overdue FROM r",
    "T14_streaks": SQL_DRAWS + _GRID + """, marks AS (SELECT idx, ball, hit, count(*) OVER w AS n, min(CASE WHEN hit THEN idx END) OVER w AS h, min(CASE WHEN NOT hit THEN idx END) OVER w AS m FROM grid WINDOW w AS (PARTITION BY ball ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING)),
st AS (SELECT idx, CASE WHEN n = 0 THEN 0 WHEN h = idx + 1 THEN coalesce(m - idx - 1, n) ELSE -coalesce(h - idx - 1, n) END AS s FROM marks),
bl AS (SELECT d.idx, count(e.idx) AS n, min(e.idx) FILTER (e.blue = d.blue) AS h, min(e.idx) FILTER (e.blue <> d.blue) AS m FROM draws d LEFT JOIN draws e ON e.idx > d.idx AND e.idx <= d.idx + 50 GROUP BY d.idx)
SELECT idx, coalesce(max(s) FILTER (s > 0), 0)::INT AS red_max_positive_streak, coalesce(max(-s) FILTER (s < 0), 0)::INT AS red_max_negative_streak, count(*) FILTER (s > 2) AS current_hot_streak_sum, count(*) FILTER (s < -10) AS current_cold_streak_sum, any_value(CASE WHEN n = 0 THEN 0 WHEN h = idx + 1 THEN coalesce(m - idx - 1, n) ELSE -coalesce(h - idx - 1, n) END)::INT AS blue_streak FROM st JOIN bl USING (idx) GROUP BY idx""",
    "T15_financial_stats": SQL_DRAWS + _MONEY + "SELECT idx, " + ", ".join(f"round({c}, 2) + 0.0 AS {c}" for c in ("sales_mean", "sales_std", "jackpot_mean", "jackpot_std")) + " FROM money2",
    "F21_financial": SQL_DRAWS + _MONEY + "SELECT idx, sales AS sales_raw, jackpot AS jackpot_raw, " + ", ".join(f"round(coalesce(CASE WHEN {x}_std > 0 THEN ({x} - {x}_mean) / {x}_std ELSE 0.0::DOUBLE END, 0), 6) + 0.0 AS {x}_zscore" for x in ("sales", "jackpot")) + ", round(CASE WHEN sales > 0 THEN jackpot::DOUBLE / sales ELSE 0.0::DOUBLE END, 6) + 0.0 AS jackpot_sales_ratio FROM money2",
    "T16_first_prizes": SQL_DRAWS + "SELECT idx, coalesce(min(CASE WHEN first_prize_count > 0 THEN idx END) OVER w - idx - 1, count(*) OVER w) AS no_first_prize_streak, coalesce(sum(first_prize_count) OVER w, 0)::BIGINT AS recent_first_prize_sum, round(coalesce(sum(first_prize_count) OVER w, 0)::DOUBLE / greatest(count(*) OVER w, 1), 6) + 0.0 AS recent_first_prize_mean FROM draws WINDOW w AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)",
}
