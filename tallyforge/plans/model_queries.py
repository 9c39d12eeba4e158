"""Queries of scoring, evaluation, probability and voting, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import energy as en
from ..operators import evaluate as ev
from ..operators import stats
from ..operators import strategies as st
from ..operators.predictor import Predictor
from ..operators.predictor import report as predictor_report
from ..sources.draws import SQL_DRAWS, draws, written_draws
from .sequence_queries import CLASSES, rounded
from .stats_queries import HALF_LIFE


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best-scored combinations of the whole space under the fitted model."""
    return rounded(en.recommend(spark, en.fit(draws(spark, sf_dir), HALF_LIFE)))


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted energy terms of every past draw."""
    d = draws(spark, sf_dir)
    t = en.terms(en.fit(d, HALF_LIFE))
    return rounded(d.select("idx", *[c.alias(f"e_{n}") for n, c in t.items()], sum(list(t.values())[1:], t["sum"]).alias("e_total")))


def enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations by their sum, and the draws of that sum beside them."""
    total = F.aggregate("reds", F.lit(0), lambda a, x: a + x)
    space = en.combinations(spark).groupBy(total.alias("sum")).agg(F.count("*").alias("n"))
    seen = draws(spark, sf_dir).groupBy(total.alias("sum")).agg(F.count("*").alias("drawn"))
    return space.join(seen, "sum", "left").select("sum", "n", F.coalesce("drawn", F.lit(0)).alias("drawn"))


def constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draws(spark, sf_dir)
    return d.where(en.constraints(en.fit(d, HALF_LIFE, mine=False))).select("idx")


def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(en.marginal_exact(spark, en.fit(draws(spark, sf_dir), HALF_LIFE)))


def candidate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(en.marginal_share(draws(spark, sf_dir).select("reds")))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty commonest combinations of six reds and blue, with their share."""
    return rounded(stats.rank_by_frequency(draws(spark, sf_dir), 20))


def _n(spark: SparkSession, sf_dir: str) -> int:
    return draws(spark, sf_dir).count()


def expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fold_range(spark, _n(spark, sf_dir), 500, 200, 300)


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fold_range(spark, _n(spark, sf_dir), 0, 200, 300, 500)


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fold_table(spark, ev.anchored(_n(spark, sf_dir), (0.25, 0.5)))


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = written_draws(spark, sf_dir)
    folds = ev.fold_table(spark, ev.walk_forward(d.count()))
    return ev.evaluated(d, folds, ev.frequency_picks(d, folds))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_walk(spark, sf_dir))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.summarised(_walk(spark, sf_dir)))


def _strategy(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pick = st.STRATEGIES[name](HALF_LIFE)(written_draws(spark, sf_dir))
        return pick.select(*[F.get("reds", F.lit(k)).alias(f"r{k + 1}") for k in range(6)], "blue")

    query.__doc__ = f"The pick of the strategy `{name}` over the whole history."
    return query


def cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the frequency strategy over rolling folds, summed up."""
    _, summary = ev.run_cv(written_draws(spark, sf_dir), ev.frequency_picks, "rolling", train=500, val=200, step=300)
    return rounded(summary)


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fold of the walk-forward evaluation, what chance gives over its draws, and how many
    standard errors the strategy's rates are above it."""
    each = _walk(spark, sf_dir).select("fold", "n", "red_rate", "blue_rate", *[c.alias(k) for k, c in ev.chance(F.col("n")).items()])
    return rounded(each.select("fold", "n", "red", "blue", "red_std", "blue_std", "three_or_more", ((F.col("red_rate") - F.col("red")) / F.col("red_std")).alias("red_z"), ((F.col("blue_rate") - F.col("blue")) / F.col("blue_std")).alias("blue_z")))


def binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fold, the chance of as many hits or more if the strategy picked at random."""
    each = _walk(spark, sf_dir)
    return rounded(each.select("fold", "n", "red_hits", "blue_hits", ev.upper_tail(F.col("red_hits"), F.col("n") * 6, ev.P_RED).alias("red_p"), ev.upper_tail(F.col("blue_hits"), F.col("n"), ev.P_BLUE).alias("blue_p")), 6)


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up probabilities of whole thousandths against whether a draw's blue is odd."""
    return draws(spark, sf_dir).select("idx", (F.col("sales") % 1001 / 1000.0).alias("p"), (F.col("blue") % 2).cast("double").alias("y"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.calibration(_probabilities(spark, sf_dir)))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probabilities(spark, sf_dir)
    return rounded(ev.calibrated(rows, ev.calibration(rows)).select("idx", "calibrated"))


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.calibration_error(ev.calibration(_probabilities(spark, sf_dir))))


def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every draw and the two before it (fewer at the far end)."""
    d = draws(spark, sf_dir).select(F.explode(F.sequence(F.greatest(F.col("idx") - 2, F.lit(0)), "idx")).alias("idx"), "reds", "blue")
    return rounded(ev.disagreement(d, "idx"))


def _member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of members 0..2 over all draws with an earlier one to pick: member m picks the draw m + 1 before."""
    d = draws(spark, sf_dir).select("idx", "reds", "blue")
    m = d.sparkSession.range(0, 3).select(F.col("id").cast("int").alias("member"))
    p = d.select((F.col("idx")).alias("j"), F.col("reds").alias("picked"), F.col("blue").alias("blue_picked"))
    rows = d.crossJoin(F.broadcast(m)).join(p, F.expr("j = idx + member + 1"))
    return rows.select("member", "idx", (F.size(F.array_intersect("reds", "picked")) / 6.0 * 0.7 + (F.col("blue") == F.col("blue_picked")).cast("int") * 0.3).alias("score"))


def member_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.member_weights(_member_scores(spark, sf_dir)))


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote at every draw: member m picks the draw m + 1 before it."""
    w = ev.member_weights(_member_scores(spark, sf_dir)).select("member", "weight")
    d = draws(spark, sf_dir)
    picks = d.select(F.explode(F.array(*map(F.lit, range(3)))).alias("member"), "idx", "reds", "blue")
    picks = picks.select((F.col("idx") - F.col("member") - 1).alias("idx"), "member", "reds", "blue").where("idx >= 0")
    return rounded(ev.voted(picks, w, "idx"))


def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.frequencies(draws(spark, sf_dir), HALF_LIFE)
    return rounded(f.select("colour", "ball", ev.softmax("weight", 2.0, "colour").alias("p")))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.frequencies(draws(spark, sf_dir), HALF_LIFE).withColumn("p", ev.softmax("weight", 2.0, "colour"))
    return rounded(ev.entropy_level(f, "p", "colour"))


def combination_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draws(spark, sf_dir)
    return rounded(ev.combination_probability(d, stats.frequencies(d)))


def probability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the likeliest balls under a softmax of their weights, with entropies and their levels."""
    f = stats.frequencies(draws(spark, sf_dir), HALF_LIFE).withColumn("p", ev.softmax("weight", 2.0, "colour"))
    return rounded(ev.probability_report(f.select("colour", "ball", "p")))


def hotness_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.hotness_test(draws(spark, sf_dir)))


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.permutation_test(written_draws(spark, sf_dir)))


def permutation_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 of the greedy strategy: refitted, pairs and all, for four folds of 500 shuffles."""
    return rounded(st.permutation_test(written_draws(spark, sf_dir), strategy="greedy"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a prediction over 4,000 seeded samples."""
    p = Predictor(spark, HALF_LIFE)
    p.prepare(draws(spark, sf_dir))
    return predictor_report(p.predict(10, 4000))


QUERIES = {
    "C11_recommend": recommend, "E12_energy_components": energies, "C6_enumeration": enumeration, "P2_constraints": constrained, "C11_marginal_exact": marginals, "A22_marginal_share": candidate_share, "A21_rank_by_frequency": ranked,
    "V1_expanding": expanding, "V2_rolling": rolling, "V3_anchored": anchored, "V5_run_cv": cross_validated, "V6_walk_forward": walk_forward, "V7_compare_to_baseline": compared, "V8_permutation_test": permutation, "V8_permutation_greedy": permutation_greedy, "V9_permutation_hotness": hotness_p,
    "G1_frequency_strategy": _strategy("frequency"), "G2_greedy_strategy": _strategy("greedy"), "G3_hot_strategy": _strategy("hot"), "G4_cold_strategy": _strategy("cold"), "G5_association_strategy": _strategy("paired"),
    "G7_vote": voted, "G8_member_weights": member_weights, "A23_random_baseline": baseline, "A25_binomial_tail": binomial, "A29_calibration": calibration, "A30_calibrated": calibrated, "A31_calibration_error": calibration_error, "A28_disagreement": disagreement, "M1_softmax": softmax, "M4_entropy_level": entropy,
    "M3_combination_probability": combination_probability, "K2_probability_report": probability_report, "C7_prediction_report": report,
}
_F = f", f AS (SELECT 'red' AS colour, ball, sum(exp(-ln(2.0::DOUBLE) * idx / {HALF_LIFE})) AS w, count(*)::DOUBLE AS c FROM balls GROUP BY ball UNION ALL SELECT 'blue', blue, sum(exp(-ln(2.0::DOUBLE) * idx / {HALF_LIFE})), count(*) FROM draws GROUP BY blue)\n"
_FOLDS = "SELECT (row_number() OVER (ORDER BY s DESC))::INT - 1 AS fold, s::INT AS val_lo, (s + 200)::INT AS val_hi, (s + 200)::INT AS train_lo, {hi}::INT AS train_hi FROM (SELECT n, n - 700 - 300 * k AS s FROM n_draws, range(100000) t(k) WHERE n - 700 - 300 * k >= 0)"
_P = ", pr AS (SELECT idx, (sales % 1001) / 1000.0::DOUBLE AS p, (blue % 2)::DOUBLE AS y FROM draws), cal AS (SELECT b.bin, coalesce(avg(p), (b.bin + 0.5::DOUBLE) / 10) AS predicted, coalesce(avg(y), 0) AS actual, count(p) AS n FROM (SELECT i::INT AS bin FROM range(10) t(i)) b LEFT JOIN pr ON least(floor(p * 10), 9)::INT = b.bin GROUP BY b.bin)\n"
_CMB = "SELECT a.ball AS a, b.ball AS b, c.ball AS c, d.ball AS d, e.ball AS e, f.ball AS f FROM dim_red a JOIN dim_red b ON a.ball < b.ball JOIN dim_red c ON b.ball < c.ball JOIN dim_red d ON c.ball < d.ball JOIN dim_red e ON d.ball < e.ball JOIN dim_red f ON e.ball < f.ball"
_WALK = ", fold AS (SELECT k::INT AS fold, v * k AS lo, v * (k + 1) AS hi FROM (SELECT CASE WHEN floor(n * (1 - 0.8::DOUBLE) / 5) < 10 THEN greatest(10, floor(0.02::DOUBLE * n)::BIGINT) ELSE floor(n * (1 - 0.8::DOUBLE) / 5)::BIGINT END AS v, n FROM n_draws), range(5) t(k) WHERE v * (k + 1) < n), pk AS (SELECT fold, 'red' AS colour, ball, count(*) AS w FROM balls JOIN fold ON idx >= hi GROUP BY ALL UNION ALL SELECT fold, 'blue', blue, count(*) FROM draws JOIN fold ON idx >= hi GROUP BY ALL), bst AS (SELECT *, row_number() OVER (PARTITION BY fold, colour ORDER BY w DESC, ball) AS r FROM pk), pick AS (SELECT fold, list(ball) FILTER (colour = 'red' AND r <= 6) AS reds, max(ball) FILTER (colour = 'blue' AND r = 1) AS blue FROM bst GROUP BY fold), hit AS (SELECT fold, len(list_intersect(d.reds, p.reds)) AS h, (d.blue = p.blue)::INT AS b FROM draws d JOIN fold ON idx >= lo AND idx < hi JOIN pick p USING (fold)), res AS (SELECT fold, count(*) AS n, sum(h)::BIGINT AS red_hits, sum(b)::BIGINT AS blue_hits, avg(h) AS avg_hits, avg((h >= 3)::INT) AS share_3, avg((h >= 4)::INT) AS share_4, avg((h >= 5)::INT) AS share_5, avg((h >= 6)::INT) AS share_6, sum(h)::DOUBLE / (count(*) * 6) AS red_rate, sum(b)::DOUBLE / count(*) AS blue_rate, sum(h) - count(*) * 36.0::DOUBLE / 33 AS excess_red, sum(b) - count(*) / 16.0::DOUBLE AS excess_blue FROM hit GROUP BY fold)\n"
_MEM = ", sc AS (SELECT m::INT AS member, d.idx, len(list_intersect(d.reds, e.reds)) / 6.0::DOUBLE * 0.7 + (d.blue = e.blue)::INT * 0.3 AS score FROM draws d, range(3) t(m), draws e WHERE e.idx = d.idx + m + 1), mw AS (SELECT member, pow(0.9::DOUBLE, count(*)) + sum(0.1::DOUBLE * score * pow(0.9::DOUBLE, idx)) AS weight, sum(score) FILTER (idx < 10) / 10 AS recent FROM sc GROUP BY member)\n"
# Tables of the energy as lists of minus logarithms, from counts: dist, key, floor of what never occurs.
_W = f"exp(-ln(2.0::DOUBLE) * idx / {HALF_LIFE})"
_AC = "len(list_distinct([" + ", ".join(f"reds[{j}] - reds[{i}]" for i in range(1, 7) for j in range(i + 1, 7)) + "])) - 5"
_ODD, _Z1, _Z2 = (f"len(list_filter(reds, lambda x: {c}))" for c in ("x % 2 = 1", "x <= 11", "x BETWEEN 12 AND 22"))
_ONE = {"span": "reds[6] - reds[1]", "parity": _ODD, "zone": f"{_Z1} * 7 + {_Z2}", "ac": _AC}
_SIZES = {"span": (33, 0.001), "parity": (7, 0.001), "zone": (49, 0.001), "ac": (11, 0.001), "gap": (33, 0.001), "position": (204, 0.0001)}
MODEL = (
    _F
    + ", tot AS (SELECT sum(w) FILTER (colour = 'red') AS r, sum(w) FILTER (colour = 'blue') AS b FROM f), wt AS (SELECT sum(" + _W + ") AS t FROM draws),\n"
    + "marks AS (" + " UNION ALL ".join([f"SELECT '{d}' AS d, {e} AS k FROM draws" for d, e in _ONE.items()] + [f"SELECT 'gap', reds[{k + 1}] - reds[{k}] FROM draws" for k in range(1, 6)] + [f"SELECT 'position', {k} * 34 + reds[{k + 1}] FROM draws" for k in range(6)]) + "),\n"
    + "sizes(d, size, floor) AS (VALUES " + ", ".join(f"('{d}', {n}, {x}::DOUBLE)" for d, (n, x) in _SIZES.items()) + "), cnt AS (SELECT d, k, count(*)::DOUBLE / any_value(n) / CASE d WHEN 'gap' THEN 5 ELSE 1 END AS p FROM marks, n_draws GROUP BY d, k),\n"
    + "lists AS (SELECT s.d, list(-ln(coalesce(p, floor)) ORDER BY i) AS l FROM sizes s JOIN range(204) t(i) ON i < size LEFT JOIN cnt ON cnt.d = s.d AND cnt.k = i GROUP BY s.d),\n"
    + f"pw AS (SELECT a.ball AS x, b.ball AS y, sum(exp(-ln(2.0::DOUBLE) * a.idx / {HALF_LIFE})) AS w FROM balls a JOIN balls b ON a.idx = b.idx AND a.ball <> b.ball GROUP BY ALL), fr AS (SELECT ball, w, CASE WHEN round(w / t, 9) >= 0.01 THEN w / t ELSE 0.001 END AS s FROM f, wt WHERE colour = 'red'),\n"
    + "lf AS (SELECT x, y, pw.w / t / greatest(a.s * b.s, 1e-4) AS lift FROM pw, wt, fr a, fr b WHERE a.ball = x AND b.ball = y AND x < y AND round(pw.w / t, 9) >= 0.01), best AS (SELECT * FROM lf WHERE round(lift, 9) >= 1.02 ORDER BY round(lift, 9) DESC, x, y LIMIT 25),\n"
    + "sq AS (SELECT a.ball AS a, b.ball AS b, coalesce(lift, 1.0::DOUBLE) AS lift, coalesce(pw.w, 0) / greatest(fa.w, 0.001) AS p, coalesce(pw.w, 0) / greatest(fb.w, 0.001) AS q FROM dim_red a CROSS JOIN dim_red b JOIN fr fa ON fa.ball = a.ball JOIN fr fb ON fb.ball = b.ball LEFT JOIN pw ON pw.x = a.ball AND pw.y = b.ball LEFT JOIN best ON best.x = least(a.ball, b.ball) AND best.y = greatest(a.ball, b.ball)),\n"
    + "m AS MATERIALIZED (SELECT " + ", ".join(f"(SELECT l FROM lists WHERE d = '{d}') AS a_{d}" for d in _SIZES)
    + ", (SELECT list(-ln(greatest(w / greatest(r, 1), 1e-4)) ORDER BY ball) FROM fr, tot) AS a_red, (SELECT list(ln(greatest(w / greatest(r, 1), 1e-10)) ORDER BY ball) FROM fr, tot) AS a_share, (SELECT list(lift ORDER BY a, b) FROM sq) AS a_lift, (SELECT list(-ln(greatest((p + q) / 2, 1e-4)) ORDER BY a, b) FROM sq) AS a_both, (SELECT avg(list_sum(reds)) FROM draws) AS mean, (SELECT stddev_pop(list_sum(reds)) FROM draws) AS sd)\n"
)
_PAIRS = [f"(reds[{i}] - 1) * 33 + reds[{j}]" for i in range(1, 7) for j in range(i + 1, 7)]
_LIFT = "(" + " + ".join(f"a_lift[{p}]" for p in _PAIRS) + ") / 15.0::DOUBLE"
_TERMS = {
    "sum": "0.5::DOUBLE * ((list_sum(reds) - mean) / greatest(sd, 0.01)) ** 2", "span": f"a_span[{_ONE['span']} + 1]", "parity": f"1.5::DOUBLE * a_parity[{_ODD} + 1]", "zone": f"1.5::DOUBLE * a_zone[{_ONE['zone']} + 1]", "ac": f"0.5::DOUBLE * a_ac[{_AC} + 1]",
    "gap": "0.5::DOUBLE * (" + " + ".join(f"a_gap[reds[{k + 1}] - reds[{k}] + 1]" for k in range(1, 6)) + ")", "position": "2.0::DOUBLE * (" + " + ".join(f"a_position[{k * 34} + reds[{k + 1}] + 1]" for k in range(6)) + ")",
    "frequency": "0.3::DOUBLE * (" + " + ".join(f"a_red[reds[{k}]]" for k in range(1, 7)) + ")", "association": f"0.2::DOUBLE * CASE WHEN {_LIFT} > 1 THEN -ln({_LIFT}) ELSE 0 END", "conditional": "0.1::DOUBLE * (" + " + ".join(f"a_both[{p}]" for p in _PAIRS) + ")",
}
ENERGY = " + ".join(_TERMS.values())
_KEPT = ", od AS (SELECT len(list_filter(reds, lambda x: x % 2 = 1)) AS k, count(*)::DOUBLE / any_value(n) AS p FROM draws, n_draws GROUP BY 1), kept AS (SELECT k FROM (SELECT k, coalesce(sum(p) OVER (ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM od) WHERE before < 0.8)\n"


def _grown(first: str, value: str) -> str:
    """Six reds: a first few, then the ball of most mean value with what is picked times its share."""
    steps, n = [f"p0 AS ({first})"], 0
    for n in range(1, 6):
        steps.append(f"p{n} AS (SELECT ball FROM p{n - 1} UNION ALL (SELECT sq.b AS ball FROM sq JOIN p{n - 1} ON sq.a = p{n - 1}.ball JOIN fr ON fr.ball = sq.b, tot WHERE sq.b NOT IN (SELECT ball FROM p{n - 1}) AND (SELECT count(*) FROM p{n - 1}) < 6 GROUP BY sq.b ORDER BY round(avg({value}) * any_value(fr.w) / greatest(any_value(tot.r), 1), 12) DESC, sq.b LIMIT 1))")
    return ", " + ", ".join(steps) + f", six_balls AS (SELECT list(ball ORDER BY ball) AS reds FROM p{n})\n"


_PICK = "SELECT " + ", ".join(f"reds[{k}] AS r{k}" for k in range(1, 7)) + ", {blue} AS blue FROM six_balls"
_BLUE = "(SELECT ball FROM f WHERE colour = 'blue' ORDER BY round(w, 9) DESC, ball LIMIT 1)"


def _filled(name: str, order: str) -> str:
    return _F + CLASSES + f", pick AS (SELECT f.ball FROM f JOIN cl USING (colour, ball) WHERE colour = 'red' ORDER BY class <> '{name}', CASE WHEN class = '{name}' THEN ball END, round(w, 9) {order}, ball LIMIT 6), six_balls AS (SELECT list(ball ORDER BY ball) AS reds FROM pick)" + _PICK.format(blue=f"coalesce((SELECT min(ball) FROM cl WHERE colour = 'blue' AND class = '{name}'), 1)")


_CV = ", fold AS (SELECT k, n - 700 - 300 * k AS lo, n - 500 - 300 * k AS hi, n - 300 * k AS top FROM n_draws, range(100000) t(k) WHERE n - 700 - 300 * k >= 0), pk AS (SELECT k, 'red' AS colour, ball, count(*) AS w FROM balls JOIN fold ON idx >= hi AND idx < top GROUP BY ALL UNION ALL SELECT k, 'blue', blue, count(*) FROM draws JOIN fold ON idx >= hi AND idx < top GROUP BY ALL), bst AS (SELECT *, row_number() OVER (PARTITION BY k, colour ORDER BY w DESC, ball) AS r FROM pk), pick AS (SELECT k, list(ball) FILTER (colour = 'red' AND r <= 6) AS reds, max(ball) FILTER (colour = 'blue' AND r = 1) AS blue FROM bst GROUP BY k), res AS (SELECT k, sum(len(list_intersect(d.reds, p.reds))) / (count(*) * 6.0::DOUBLE) AS red, avg((d.blue = p.blue)::INT) AS blue, avg((len(list_intersect(d.reds, p.reds)) >= 3)::INT) AS three FROM draws d JOIN fold ON idx >= lo AND idx < hi JOIN pick p USING (k) GROUP BY k)\n"
_PERM = ", perm AS (SELECT 0 AS perm, idx, idx AS place FROM {t} UNION ALL SELECT p, idx, row_number() OVER (PARTITION BY p ORDER BY md5('1:' || p || ':' || idx), idx) - 1 FROM {t}, range(1, {n} + 1) r(p))\n"
_VALIDATED = ", v AS (SELECT n, CASE WHEN floor(n * (1 - 0.85::DOUBLE) / 4) < 10 THEN greatest(10, floor(0.02::DOUBLE * n)::BIGINT) ELSE floor(n * (1 - 0.85::DOUBLE) / 4)::BIGINT END AS val FROM n_draws), fold AS (SELECT k::INT AS fold, val FROM v, range(4) t(k) WHERE (k + 1) * val < n), nf AS (SELECT count(*) AS nf, any_value(val) AS val FROM fold)\n"
# Counts of each shuffle's folds as lists: rl of reds and pl of pairs that are trained on, cl of reds validated.
_COUNTED = (
    ", pb AS (SELECT perm, place // val AS fold, idx FROM perm, nf WHERE place < val * nf), keys AS MATERIALIZED (SELECT perm, fold FROM (SELECT DISTINCT perm FROM perm), fold), c1 AS (SELECT perm, fold, ball, count(*) AS c FROM pb JOIN balls USING (idx) GROUP BY ALL),\n"
    "c2 AS (SELECT perm, fold, a.ball AS a, b.ball AS b, count(*) AS c FROM pb JOIN balls a USING (idx) JOIN balls b USING (idx) WHERE a.ball <> b.ball GROUP BY ALL), h2 AS (SELECT x.ball AS a, y.ball AS b, count(i.idx) AS n FROM dim_red x CROSS JOIN dim_red y LEFT JOIN (SELECT a.idx, a.ball AS a, b.ball AS b FROM balls a JOIN balls b USING (idx) WHERE a.ball <> b.ball) i ON i.a = x.ball AND i.b = y.ball GROUP BY ALL),\n"
    "t1 AS (SELECT perm, fold, ball, coalesce(c, 0) AS c, (h.n - sum(coalesce(c, 0)) OVER (PARTITION BY perm, ball ORDER BY fold))::DOUBLE AS t FROM keys CROSS JOIN (SELECT ball, count(*) AS n FROM balls GROUP BY ball) h LEFT JOIN c1 USING (perm, fold, ball)), t2 AS (SELECT perm, fold, a, b, (h2.n - sum(coalesce(c, 0)) OVER (PARTITION BY perm, a, b ORDER BY fold))::DOUBLE AS t FROM keys CROSS JOIN h2 LEFT JOIN c2 USING (perm, fold, a, b)),\n"
    "g AS MATERIALIZED (SELECT * FROM (SELECT perm, fold, list(t ORDER BY ball) AS rl, list(c ORDER BY ball) AS cl FROM t1 GROUP BY ALL) JOIN (SELECT perm, fold, list(t ORDER BY a, b) AS pl FROM t2 GROUP BY ALL) USING (perm, fold))\n"
)


def _greedy_steps() -> str:
    least = "list_min(list_transform(list_filter(range(1, 34), lambda b: NOT list_contains(picked, b)), lambda b: {{'s': -round({score}, {places}), 'b': b}})).b"
    mean = "list_sum(list_transform(picked, lambda s: pl[(s - 1) * 33 + b] / greatest(rl[s], 0.001::DOUBLE))) / len(picked) * rl[b] / greatest(list_sum(rl), 1)"
    steps = [f"g0 AS (SELECT *, []::BIGINT[] AS picked FROM g), g1 AS (SELECT * REPLACE ([{least.format(score='rl[b]', places=9)}] AS picked) FROM g0)"]
    steps += [f"g{k} AS (SELECT * REPLACE (list_append(picked, {least.format(score=mean, places=12)}) AS picked) FROM g{k - 1})" for k in range(2, 7)]
    return ", " + ", ".join(steps) + ", h AS (SELECT perm, sum(list_sum(list_transform(picked, lambda b: cl[b])))::BIGINT AS h FROM g6 GROUP BY perm), o AS (SELECT h AS o FROM h WHERE perm = 0)\n"


_R = "round({0}, 6) + 0.0 AS {0}"
SQL = {
    "C6_enumeration": SQL_DRAWS + f"SELECT sum, n, coalesce(drawn, 0) AS drawn FROM (SELECT a + b + c + d + e + f AS sum, count(*) AS n FROM ({_CMB}) GROUP BY 1) LEFT JOIN (SELECT list_sum(reds)::INT AS sum, count(*) AS drawn FROM draws GROUP BY 1) USING (sum)",
    "P2_constraints": SQL_DRAWS + ", st AS (SELECT avg(list_sum(reds)) AS m, stddev_pop(list_sum(reds)) AS sd FROM draws), od AS (SELECT len(list_filter(reds, lambda x: x % 2 = 1)) AS k, count(*)::DOUBLE / any_value(n) AS p FROM draws, n_draws GROUP BY 1), kept AS (SELECT k, coalesce(sum(p) OVER (ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM od) SELECT idx FROM draws, st WHERE list_sum(reds) BETWEEN m - 3 * sd AND m + 3 * sd AND len(list_filter(reds, lambda x: x % 2 = 1)) IN (SELECT k FROM kept WHERE before < 0.8)",
    "V1_expanding": SQL_DRAWS + _FOLDS.format(hi="n"), "V2_rolling": SQL_DRAWS + _FOLDS.format(hi="(s + 700)"),
    "V3_anchored": SQL_DRAWS + "SELECT k::INT AS fold, 0 AS val_lo, s AS val_hi, s AS train_lo, n::INT AS train_hi FROM (SELECT n, k, floor(n * [0.25::DOUBLE, 0.5::DOUBLE][k + 1])::INT AS s FROM n_draws, range(2) t(k))",
    "V6_walk_forward": SQL_DRAWS + _WALK + "SELECT fold, n, red_hits, blue_hits, " + ", ".join(_R.format(c) for c in ("avg_hits", "share_3", "share_4", "share_5", "share_6", "red_rate", "blue_rate", "excess_red", "excess_blue")) + " FROM res",
    "V7_compare_to_baseline": SQL_DRAWS + _WALK + ", s AS (SELECT avg(red_rate) AS red_mean, stddev_pop(red_rate) AS red_std, avg(blue_rate) AS blue_mean, avg(red_rate) / (6.0::DOUBLE / 33) AS ratio_to_chance, avg((red_rate > 6.0::DOUBLE / 33)::INT) AS consistency, avg(excess_red) AS excess, avg(excess_red) / greatest(stddev_pop(excess_red), 0.001) AS information_ratio FROM res) SELECT " + ", ".join(_R.format(c) for c in ("red_mean", "red_std", "blue_mean", "ratio_to_chance", "consistency", "excess", "information_ratio")) + ", (excess > 0)::INT + (information_ratio > 1)::INT + (consistency > 0.6)::INT AS grade FROM s",
    "G8_member_weights": SQL_DRAWS + _MEM + "SELECT member, round(weight, 6) AS weight, round(recent, 6) AS recent FROM mw",
    "A23_random_baseline": SQL_DRAWS + _WALK + ", ch AS (SELECT *, 6 / 33.0::DOUBLE AS red, 1 / 16.0::DOUBLE AS blue, sqrt(6 / 33.0::DOUBLE * 27 / 33 / n) AS red_std, sqrt(1 / 16.0::DOUBLE * 15 / 16 / n) AS blue_std FROM res) SELECT fold, n, round(red, 6) AS red, round(blue, 6) AS blue, round(red_std, 6) AS red_std, round(blue_std, 6) AS blue_std, round(63928 / 1107568.0::DOUBLE, 6) AS three_or_more, round((red_rate - red) / red_std, 6) + 0.0 AS red_z, round((blue_rate - blue) / blue_std, 6) + 0.0 AS blue_z FROM ch",
    "A25_binomial_tail": SQL_DRAWS + _WALK + ", ".join(["", *(f"{c}_t AS (SELECT fold, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln({p}) + (m - k) * ln(1 - {p}))) AS p FROM (SELECT fold, {c}_hits AS h, n * {m} AS m FROM res) r, LATERAL (SELECT unnest(range(h, m + 1)) AS k) GROUP BY fold)" for c, p, m in (("red", "6 / 33.0::DOUBLE", 6), ("blue", "1 / 16.0::DOUBLE", 1)))]) + " SELECT fold, n, red_hits, blue_hits, round(least(red_t.p, 1), 6) + 0.0 AS red_p, round(least(blue_t.p, 1), 6) + 0.0 AS blue_p FROM res JOIN red_t USING (fold) JOIN blue_t USING (fold)",
    "A29_calibration": SQL_DRAWS + _P + "SELECT bin, round(predicted, 6) AS predicted, round(actual, 6) AS actual, n FROM cal",
    "A30_calibrated": SQL_DRAWS + _P + "SELECT idx, round(actual, 6) AS calibrated FROM pr JOIN cal ON cal.bin = least(floor(p * 10), 9)::INT",
    "A31_calibration_error": SQL_DRAWS + _P + "SELECT round(sum(n * abs(predicted - actual)) / sum(n), 6) AS ece FROM cal",
    "M1_softmax": SQL_DRAWS + _F + "SELECT colour, ball, round(exp((w - max(w) OVER p) / 2) / sum(exp(w / 2)) OVER p * exp(max(w) OVER p / 2), 6) + 0.0 AS p FROM f WINDOW p AS (PARTITION BY colour)",
    "M4_entropy_level": SQL_DRAWS + _F + ", q AS (SELECT colour, exp(w / 2) / sum(exp(w / 2)) OVER (PARTITION BY colour) AS p FROM f), h AS (SELECT colour, -sum(p * ln(greatest(p, 1e-10))) AS e, count(*) AS n FROM q GROUP BY colour) SELECT colour, round(e, 6) AS entropy, CASE WHEN e / ln(n) > 0.8 THEN 'high' WHEN e / ln(n) > 0.5 THEN 'mid' ELSE 'low' END AS level FROM h",
    "A22_marginal_share": SQL_DRAWS + "SELECT ball, round(count(*) / any_value(n)::DOUBLE, 6) AS p FROM balls, n_draws GROUP BY ball",
    "A21_rank_by_frequency": SQL_DRAWS + "SELECT " + ", ".join(f"reds[{k}] AS r{k}" for k in range(1, 7)) + ", blue, count(*) AS count, round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM draws, n_draws GROUP BY reds, blue ORDER BY 8 DESC, 1, 2, 3, 4, 5, 6, 7 LIMIT 20",
    "A28_disagreement": SQL_DRAWS + ", pk AS (SELECT d.idx AS i, e.reds, e.blue FROM draws d JOIN draws e ON e.idx BETWEEN d.idx AND d.idx + 2), n AS (SELECT i, count(*) AS n FROM pk GROUP BY i), r AS (SELECT i, ball, count(*) AS c FROM (SELECT i, unnest(reds) AS ball FROM pk) GROUP BY ALL), b AS (SELECT i, max(c) AS most FROM (SELECT i, blue, count(*) AS c FROM pk GROUP BY ALL) GROUP BY i) SELECT i AS idx, round(CASE WHEN any_value(n) <= 1 THEN 0 ELSE 1 - (count(*) FILTER (c = n))::DOUBLE / count(*) END, 6) + 0.0 AS red, round(CASE WHEN any_value(n) <= 1 THEN 0 ELSE 1 - any_value(most)::DOUBLE / any_value(n) END, 6) + 0.0 AS blue FROM r JOIN n USING (i) JOIN b USING (i) GROUP BY i",
    "G7_vote": SQL_DRAWS + _MEM + ", pk AS (SELECT d.idx, weight, e.reds, e.blue FROM draws d JOIN mw ON true JOIN draws e ON e.idx = d.idx + member + 1), v AS (SELECT idx, 'red' AS colour, unnest(reds) AS ball, weight FROM pk UNION ALL SELECT idx, 'blue', blue, weight FROM pk), s AS (SELECT idx, colour, ball, sum(weight) AS votes FROM v GROUP BY ALL), p AS (SELECT *, (row_number() OVER (PARTITION BY idx, colour ORDER BY round(votes, 9) DESC, ball))::INT AS place FROM s) SELECT idx, colour, ball, round(votes, 6) + 0.0 AS votes, place, place <= CASE colour WHEN 'red' THEN 6 ELSE 1 END AS chosen FROM p",
    "M3_combination_probability": SQL_DRAWS + _F + ", l AS (SELECT colour, ball, log10(greatest(c / sum(c) OVER (PARTITION BY colour), 1e-10)) AS l FROM f) SELECT idx, round(sum(l), 6) AS log10_p FROM (SELECT idx, 'red' AS colour, ball FROM balls UNION ALL SELECT idx, 'blue', blue FROM draws) JOIN l USING (colour, ball) GROUP BY idx",
    "K2_probability_report": SQL_DRAWS + _F + ", q AS (SELECT colour, ball, exp(w / 2) / sum(exp(w / 2)) OVER (PARTITION BY colour) AS p FROM f), h AS (SELECT colour, -sum(p * ln(greatest(p, 1e-10))) AS e, count(*) AS n FROM q GROUP BY colour), r AS (SELECT *, (row_number() OVER (PARTITION BY colour ORDER BY round(p, 12) DESC, ball))::INT AS place FROM q) SELECT colour, place, ball, round(p, 6) + 0.0 AS p, round(e, 6) AS entropy, CASE WHEN e / ln(n) > 0.8 THEN 'high' WHEN e / ln(n) > 0.5 THEN 'mid' ELSE 'low' END AS level FROM r JOIN h USING (colour) WHERE place <= CASE colour WHEN 'red' THEN 6 ELSE 5 END",
    "E12_energy_components": SQL_DRAWS + MODEL + "SELECT idx, " + ", ".join(f"round({e}, 6) + 0.0 AS e_{n}" for n, e in _TERMS.items()) + f", round({ENERGY}, 6) + 0.0 AS e_total FROM draws, m",
    "C11_marginal_exact": SQL_DRAWS + MODEL + f", cmb AS (SELECT [a, b, c, d, e, f] AS reds FROM ({_CMB})), e AS (SELECT reds, exp(-({ENERGY})) AS w FROM cmb, m), z AS (SELECT sum(w) AS z FROM e) SELECT ball, round(sum(w) / any_value(z), 6) + 0.0 AS p FROM (SELECT unnest(reds) AS ball, w FROM e), z GROUP BY ball",
    "C11_recommend": SQL_DRAWS + MODEL + _KEPT + f", cmb AS (SELECT [a, b, c, d, e, f] AS reds FROM ({_CMB})), ok AS (SELECT reds, {ENERGY} AS e, {' + '.join(f'a_share[reds[{k}]]' for k in range(1, 7))} + 0.5::DOUBLE * ln(greatest({_LIFT}, 0.01)) AS s FROM cmb, m WHERE list_sum(reds) BETWEEN mean - 3 * sd AND mean + 3 * sd AND {_ODD} IN (SELECT k FROM kept)), bl AS (SELECT ball AS blue, ln(greatest(w / greatest(b, 1), 1e-10)) AS s, -0.3::DOUBLE * ln(greatest(w / greatest(b, 1), 1e-4)) AS e FROM f, tot WHERE colour = 'blue'), every AS (SELECT reds, blue, ok.e + bl.e AS energy, ok.s + bl.s - 0.1::DOUBLE * (ok.e + bl.e) AS score FROM ok CROSS JOIN bl) SELECT " + ", ".join(f"reds[{k}] AS r{k}" for k in range(1, 7)) + ", blue, round(energy, 6) + 0.0 AS energy, round(score, 6) + 0.0 AS score FROM every ORDER BY round(every.score, 9) DESC, reds, blue LIMIT 10",
    "G1_frequency_strategy": SQL_DRAWS + _F + ", six_balls AS (SELECT list(ball ORDER BY ball) AS reds FROM (SELECT ball FROM f WHERE colour = 'red' ORDER BY round(w, 9) DESC, ball LIMIT 6))" + _PICK.format(blue=_BLUE),
    "G2_greedy_strategy": SQL_DRAWS + MODEL + _grown("SELECT ball FROM fr ORDER BY round(w, 9) DESC, ball LIMIT 1", "p") + _PICK.format(blue=_BLUE),
    "G3_hot_strategy": SQL_DRAWS + _filled("hot", "DESC"), "G4_cold_strategy": SQL_DRAWS + _filled("cold", "ASC"),
    "G5_association_strategy": SQL_DRAWS + MODEL + _grown("SELECT unnest([x, y]) AS ball FROM (SELECT x, y FROM best ORDER BY round(lift, 9) DESC, x, y LIMIT 1)", "lift") + _PICK.format(blue=_BLUE),
    "V5_run_cv": SQL_DRAWS + _CV + "SELECT count(*) AS n_folds, round(avg(red), 6) AS red_rate_mean, round(stddev_pop(red), 6) + 0.0 AS red_rate_std, round(avg(blue), 6) AS blue_rate_mean, round(stddev_pop(blue), 6) + 0.0 AS blue_rate_std, round(avg(three), 6) + 0.0 AS share_3_mean, round(avg((red > 6.0::DOUBLE / 33)::INT), 6) + 0.0 AS consistency_red, round(avg((blue > 1.0::DOUBLE / 16)::INT), 6) + 0.0 AS consistency_blue, round(avg(red) / (6.0::DOUBLE / 33), 6) AS red_to_chance, round(avg(blue) * 16, 6) AS blue_to_chance FROM res HAVING count(*) > 0",
    "V8_permutation_test": SQL_DRAWS + _PERM.format(t="draws", n=500) + ", v AS (SELECT n, CASE WHEN floor(n * (1 - 0.85::DOUBLE) / 4) < 10 THEN greatest(10, floor(0.02::DOUBLE * n)::BIGINT) ELSE floor(n * (1 - 0.85::DOUBLE) / 4)::BIGINT END AS val FROM n_draws), fold AS (SELECT k::INT AS fold, val FROM v, range(4) t(k) WHERE (k + 1) * val < n), nf AS (SELECT count(*) AS nf, any_value(val) AS val FROM fold), c AS (SELECT perm, place // val AS fold, ball, count(*) AS c FROM perm JOIN balls USING (idx), nf WHERE place < val * nf GROUP BY ALL), tr AS (SELECT perm, fold, ball, t.n - sum(coalesce(c, 0)) OVER (PARTITION BY perm, ball ORDER BY fold) AS trained, coalesce(c, 0) AS c FROM (SELECT DISTINCT perm FROM perm) CROSS JOIN fold CROSS JOIN (SELECT ball, count(*) AS n FROM balls GROUP BY ball) t LEFT JOIN c USING (perm, fold, ball)), pk AS (SELECT perm, c, trained, row_number() OVER (PARTITION BY perm, fold ORDER BY trained DESC, ball) AS r FROM tr), h AS (SELECT perm, sum(c) AS h FROM pk WHERE r <= 6 AND trained > 0 GROUP BY perm), o AS (SELECT h AS o FROM h WHERE perm = 0) SELECT round(avg((h >= o)::INT), 6) + 0.0 AS p, round(any_value(o)::DOUBLE / any_value(val * nf), 6) AS observed FROM h, o, nf WHERE perm > 0",
    "V8_permutation_greedy": SQL_DRAWS + _PERM.format(t="draws", n=500) + _VALIDATED + _COUNTED + _greedy_steps() + "SELECT round(avg((h >= o)::INT), 6) + 0.0 AS p, round(any_value(o)::DOUBLE / any_value(val * nf), 6) AS observed FROM h, o, nf WHERE perm > 0",
    "V9_permutation_hotness": SQL_DRAWS + ", part AS (SELECT idx - 1 AS idx, reds, blue FROM draws WHERE idx BETWEEN 1 AND 150)" + _PERM.format(t="part", n=1000) + ", e AS (SELECT sum(pow(2.0::DOUBLE, -idx / 50.0::DOUBLE)) AS e FROM part), hit AS (SELECT perm, 'red' AS colour, unnest(reds) AS ball, pow(2.0::DOUBLE, -place / 50.0::DOUBLE) AS w FROM perm JOIN part USING (idx) UNION ALL SELECT perm, 'blue', blue, pow(2.0::DOUBLE, -place / 50.0::DOUBLE) FROM perm JOIN part USING (idx)), s AS (SELECT perm, colour, ball, sum(w) AS w FROM hit GROUP BY ALL), pool AS (SELECT 'red' AS colour, ball, 6.0::DOUBLE / 33 AS q FROM dim_red UNION ALL SELECT 'blue', ball, 1.0::DOUBLE / 16 FROM dim_blue), z AS (SELECT perm, max(round(abs((coalesce(w, 0) / e - q) / sqrt(q * (1 - q) / e)), 9)) AS z FROM (SELECT DISTINCT perm FROM perm) CROSS JOIN pool CROSS JOIN e LEFT JOIN s USING (perm, colour, ball) GROUP BY perm), o AS (SELECT z AS o FROM z WHERE perm = 0) SELECT round(avg((z >= o)::INT), 6) + 0.0 AS p, round(any_value(o), 6) AS observed FROM z, o WHERE perm > 0",
}
