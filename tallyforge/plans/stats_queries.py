"""Queries of counts, matrices, distributions and associations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows
from ..operators import association as assoc
from ..operators import stats
from ..sources.draws import SQL_DRAWS, draws
from .sequence_queries import rounded

HALF_LIFE = 200


def global_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequencies(draws(spark, sf_dir)).select("colour", "ball", F.col("weight").cast("long").alias("n"))


def weighted_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.frequencies(draws(spark, sf_dir), HALF_LIFE))


def decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of every draw by its age, decayed and not."""
    from ..sources.draws import weight

    return rounded(draws(spark, sf_dir).select("idx", weight(HALF_LIFE).alias("weight"), weight(0).alias("flat")))


def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.conditional(draws(spark, sf_dir), HALF_LIFE))


def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.co_occurrence(draws(spark, sf_dir), HALF_LIFE))


def sum_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.sum_distribution(draws(spark, sf_dir)))


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.distributions(draws(spark, sf_dir)).withColumns({"k2": F.coalesce("k2", F.lit(-1)), "k3": F.coalesce("k3", F.lit(-1))}))


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows.basic()
    names = ("red_sum", "red_span", "red_std", "red_odd_count", "red_zone_small", "red_ac", "blue")
    return rounded(stats.correlation(draws(spark, sf_dir), {n: f[n] for n in names} | {"constant": F.lit(1)}))


def markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.markov(draws(spark, sf_dir), 2, HALF_LIFE))


def blue_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.blue_transition(draws(spark, sf_dir), HALF_LIFE))


def top_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.top(stats.frequencies(draws(spark, sf_dir), HALF_LIFE).where("colour = 'red'"), 10))


def itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rounded(assoc.itemsets(draws(spark, sf_dir), 0.01, 3, HALF_LIFE).select("a", none("b"), none("c"), "size", "support"))


def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = assoc.rules(assoc.itemsets(draws(spark, sf_dir), 0.006, 3, HALF_LIFE))
    return rounded(r.withColumn("ant2", F.coalesce("ant2", F.lit(0))))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.pair_scores(assoc.rules(assoc.itemsets(draws(spark, sf_dir), 0.01, 2, HALF_LIFE))))


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.stability(draws(spark, sf_dir), 3, 1.05))


def combination_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draws(spark, sf_dir)
    pairs = assoc.pair_scores(assoc.rules(assoc.itemsets(d, 0.01, 2, HALF_LIFE)))
    return rounded(assoc.combination_scores(d, pairs))


_W = f"exp(-ln(2.0::DOUBLE) * idx / {HALF_LIFE})"
_AC = "(len(list_distinct([" + ", ".join(f"reds[{j}]-reds[{i}]" for i in range(1, 7) for j in range(i + 1, 7)) + "])) - 5)::INT"
_SETS = f""", wt AS (SELECT idx, {_W} AS w FROM draws), tot AS (SELECT sum(w) AS t FROM wt),
s1 AS (SELECT ball AS a, 0 AS b, 0 AS c, 1 AS size, sum(w) AS w FROM balls JOIN wt USING (idx) GROUP BY ball),
s2 AS (SELECT x.ball AS a, y.ball AS b, 0 AS c, 2 AS size, sum(w) AS w FROM balls x JOIN balls y ON x.idx = y.idx AND x.ball < y.ball JOIN wt ON wt.idx = x.idx GROUP BY ALL),
s3 AS (SELECT x.ball AS a, y.ball AS b, z.ball AS c, 3 AS size, sum(w) AS w FROM balls x JOIN balls y ON x.idx = y.idx AND x.ball < y.ball JOIN balls z ON z.idx = y.idx AND y.ball < z.ball JOIN wt ON wt.idx = x.idx GROUP BY ALL),
sets AS (SELECT a, b, c, size, w / t AS support FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), tot WHERE round(w / t, 9) >= {{support}})
"""
_RULES = """, ways AS (SELECT size, support, a AS ant1, 0 AS ant2, b AS con FROM sets WHERE size = 2 UNION ALL SELECT size, support, b, 0, a FROM sets WHERE size = 2
  UNION ALL SELECT size, support, a, b, c FROM sets WHERE size = 3 UNION ALL SELECT size, support, a, c, b FROM sets WHERE size = 3 UNION ALL SELECT size, support, b, c, a FROM sets WHERE size = 3),
rules AS (SELECT r.ant1, r.ant2, r.con, r.size, r.support, r.support / greatest(coalesce(q.support, 0.001) * coalesce(o.support, 0.001), 1e-4) AS lift, r.support / greatest(coalesce(q.support, 0.001), 0.001) AS confidence
  FROM ways r LEFT JOIN sets o ON o.size = 1 AND o.a = r.con LEFT JOIN sets q ON q.size = r.size - 1 AND q.a = r.ant1 AND q.b = r.ant2)
"""
_TOP = """, best AS (SELECT least(ant1, con) AS x, greatest(ant1, con) AS y, lift FROM rules WHERE size = 2 AND round(lift, 9) >= 1.02 ORDER BY round(lift, 9) DESC, x, y, ant1 LIMIT 50), pairs AS (SELECT x, y, max(lift) AS lift FROM best GROUP BY ALL)
"""
QUERIES = {
    "A1_global_frequencies": global_frequencies, "A2_weighted_frequencies": weighted_frequencies, "T1_decay_weights": decay_weights, "A4_conditional": conditional, "A5_co_occurrence": co_occurrence, "A6_sum_distribution": sum_distribution,
    "A13_distributions": distributions, "A14_correlation": correlation, "A15_markov": markov, "A16_blue_transition": blue_transition, "K1_top_balls": top_balls, "A17_itemsets": itemsets, "A18_rules": association_rules, "A19_pair_scores": pair_scores, "A20_stability": stability, "M5_combination_scores": combination_scores,
}
_F = {"red_sum": "list_sum(reds)", "red_span": "reds[6] - reds[1]", "red_std": "list_stddev_pop(reds)", "red_odd_count": "len(list_filter(reds, lambda x: x % 2 = 1))", "red_zone_small": "len(list_filter(reds, lambda x: x <= 11))", "red_ac": _AC, "blue": "blue"}
_FREQ = f", f AS (SELECT 'red' AS colour, ball, sum({_W}) AS w, count(*) AS n FROM balls GROUP BY ball UNION ALL SELECT 'blue', blue, sum({_W}), count(*) FROM draws GROUP BY blue), pool AS (SELECT 'red' AS colour, ball FROM dim_red UNION ALL SELECT 'blue', ball FROM dim_blue)\n"
SQL = {
    "A1_global_frequencies": SQL_DRAWS + _FREQ + "SELECT colour, ball, coalesce(n, 0)::BIGINT AS n FROM pool LEFT JOIN f USING (colour, ball)",
    "A2_weighted_frequencies": SQL_DRAWS + _FREQ + "SELECT colour, ball, round(coalesce(w, 0), 6) + 0.0 AS weight FROM pool LEFT JOIN f USING (colour, ball)",
    "T1_decay_weights": SQL_DRAWS + f"SELECT idx, round(exp(-ln(2.0::DOUBLE) * idx / {HALF_LIFE}), 6) + 0.0 AS weight, 1.0::DOUBLE AS flat FROM draws",
    "A4_conditional": SQL_DRAWS + f", p AS (SELECT x.ball AS a, y.ball AS b, sum(exp(-ln(2.0::DOUBLE) * x.idx / {HALF_LIFE})) AS w FROM balls x JOIN balls y ON x.idx = y.idx AND x.ball <> y.ball GROUP BY ALL), s AS (SELECT ball AS a, sum({_W}) AS wa FROM balls GROUP BY ball) SELECT d.ball AS a, e.ball AS b, round(coalesce(w, 0) / greatest(coalesce(wa, 0), 0.001), 6) + 0.0 AS p FROM dim_red d CROSS JOIN dim_red e LEFT JOIN p ON p.a = d.ball AND p.b = e.ball LEFT JOIN s ON s.a = d.ball",
    "A5_co_occurrence": SQL_DRAWS + f", p AS (SELECT x.ball AS a, y.ball AS b, sum(exp(-ln(2.0::DOUBLE) * x.idx / {HALF_LIFE})) AS w FROM balls x JOIN balls y ON x.idx = y.idx GROUP BY ALL), t AS (SELECT sum({_W}) AS t FROM draws) SELECT d.ball AS a, e.ball AS b, round(coalesce(w, 0) / t, 6) + 0.0 AS value FROM dim_red d CROSS JOIN dim_red e CROSS JOIN t LEFT JOIN p ON p.a = d.ball AND p.b = e.ball",
    "A6_sum_distribution": SQL_DRAWS + "SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, min(s)::INT AS min, max(s)::INT AS max FROM (SELECT list_sum(reds) AS s FROM draws)",
    "A13_distributions": SQL_DRAWS + f""", v AS (SELECT 'span' AS dist, reds[6] - reds[1] AS k1, -1 AS k2, -1 AS k3 FROM draws UNION ALL SELECT 'parity', len(list_filter(reds, lambda x: x % 2 = 1)), -1, -1 FROM draws
UNION ALL SELECT 'zone', len(list_filter(reds, lambda x: x <= 11)), len(list_filter(reds, lambda x: x BETWEEN 12 AND 22)), len(list_filter(reds, lambda x: x >= 23)) FROM draws UNION ALL SELECT 'ac', {_AC}, -1, -1 FROM draws
UNION ALL SELECT 'position', k, reds[k], -1 FROM draws, range(1, 7) t(k) UNION ALL SELECT 'gap', reds[k + 1] - reds[k], -1, -1 FROM draws, range(1, 6) t(k))
SELECT dist, k1::INT AS k1, k2::INT AS k2, k3::INT AS k3, round(count(*)::DOUBLE / max(n * CASE WHEN dist = 'gap' THEN 5 ELSE 1 END), 6) + 0.0 AS p FROM v, n_draws GROUP BY ALL""",
    "A14_correlation": SQL_DRAWS + ", f AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _F.items()) + ", 1.0::DOUBLE AS constant FROM draws) " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, " + ("max(1.0::DOUBLE)" if x == y else f"round(CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN 0 ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 6) + 0.0") + " AS r FROM f" for x in [*_F, "constant"] for y in [*_F, "constant"]),
    "A15_markov": SQL_DRAWS + f", pr AS (SELECT DISTINCT c.idx, p.ball AS prev FROM draws c JOIN balls p ON p.idx IN (c.idx + 1, c.idx + 2) CROSS JOIN n_draws WHERE c.idx < n - 2), cell AS (SELECT prev, ball, sum({_W}) AS w FROM pr JOIN balls USING (idx) GROUP BY ALL) SELECT prev, ball, round(w / sum(w) OVER (PARTITION BY prev), 6) + 0.0 AS p FROM cell",
    "A16_blue_transition": SQL_DRAWS + f", cell AS (SELECT p.blue AS prev, c.blue, sum(exp(-ln(2.0::DOUBLE) * c.idx / {HALF_LIFE})) AS w FROM draws c JOIN draws p ON p.idx = c.idx + 1 GROUP BY ALL) SELECT prev, blue, round(w / sum(w) OVER (PARTITION BY prev), 6) + 0.0 AS p FROM cell",
    "K1_top_balls": SQL_DRAWS + _FREQ + "SELECT colour, ball, round(w, 6) + 0.0 AS weight, (row_number() OVER (ORDER BY round(w, 9) DESC, ball))::INT AS place FROM f WHERE colour = 'red' ORDER BY place LIMIT 10",
    "A17_itemsets": SQL_DRAWS + _SETS.format(support=0.01) + "SELECT a, b, c, size, round(support, 6) + 0.0 AS support FROM sets",
    "A18_rules": SQL_DRAWS + _SETS.format(support=0.006) + _RULES + "SELECT ant1, ant2, con, size, round(support, 6) + 0.0 AS support, round(lift, 6) + 0.0 AS lift, round(confidence, 6) + 0.0 AS confidence FROM rules",
    "A19_pair_scores": SQL_DRAWS + _SETS.format(support=0.01) + _RULES + _TOP + "SELECT x, y, round(lift, 6) + 0.0 AS lift FROM pairs",
    "A20_stability": SQL_DRAWS + """, seg AS (SELECT idx, least(idx // greatest(n // 3, 1), 2) AS g FROM draws, n_draws), t AS (SELECT g, count(*) AS t FROM seg GROUP BY g), o AS (SELECT g, ball, count(*) AS c FROM balls JOIN seg USING (idx) GROUP BY ALL),
p AS (SELECT g, x.ball AS x, y.ball AS y, count(*) AS c FROM balls x JOIN balls y ON x.idx = y.idx AND x.ball < y.ball JOIN seg ON seg.idx = x.idx GROUP BY ALL),
l AS (SELECT p.g, p.x, p.y, (p.c::DOUBLE / t) / greatest((a.c::DOUBLE / t) * (b.c::DOUBLE / t), 1e-4) AS lift FROM p JOIN t USING (g) JOIN o a ON a.g = p.g AND a.ball = p.x JOIN o b ON b.g = p.g AND b.ball = p.y WHERE round(p.c::DOUBLE / t, 9) >= 0.01)
SELECT x, y, round(count(*) / 3.0::DOUBLE, 6) AS share FROM l WHERE round(lift, 9) > 1.05 GROUP BY x, y HAVING count(*) >= 2""",
    "M5_combination_scores": SQL_DRAWS + _SETS.format(support=0.01) + _RULES + _TOP + ", e AS (SELECT a.idx, coalesce(lift, 1.0::DOUBLE) AS l FROM balls a JOIN balls b ON a.idx = b.idx AND a.ball < b.ball LEFT JOIN pairs ON pairs.x = a.ball AND pairs.y = b.ball) SELECT idx, round(avg(l), 6) + 0.0 AS mean_lift, round(min(l), 6) + 0.0 AS min_lift, round(max(l), 6) + 0.0 AS max_lift, round(avg((round(l, 9) > 1.1)::INT), 6) + 0.0 AS share_over FROM e GROUP BY idx",
}
