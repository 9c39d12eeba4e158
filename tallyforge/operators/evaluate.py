"""Folds, walk-forward evaluation of strategies against chance, tests, calibration and voting."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.draws import BLOCK, BLUES, PICKED, REDS, weight

P_RED, P_BLUE = PICKED / REDS, 1 / BLUES
#: Chance of three hits or more of six, exactly (hypergeometric).
P_THREE = sum(math.comb(6, k) * math.comb(27, 6 - k) for k in range(3, 7)) / math.comb(33, 6)

Fold = tuple[int, int, int, int, int]  # number, validation [lo, hi), training [lo, hi)


def expanding(n: int, least: int, val: int, step: int) -> list[Fold]:
    return [(k, s, s + val, s + val, n) for k, s in enumerate(range(n - least - val, -1, -step))]


def rolling(n: int, train: int, val: int, step: int) -> list[Fold]:
    return [(k, s, s + val, s + val, s + val + train) for k, s in enumerate(range(n - train - val, -1, -step))]


def anchored(n: int, anchors: tuple[float, ...]) -> list[Fold]:
    """The share of each anchor that is newest validates."""
    return [(k, 0, int(n * a), int(n * a), n) for k, a in enumerate(anchors)]


def walk_forward(n: int, n_folds: int = 5, train_ratio: float = 0.8) -> list[Fold]:
    val = int(n * (1 - train_ratio) / n_folds)
    if val < 10:
        val = max(10, int(0.02 * n))
    return [(k, k * val, (k + 1) * val, (k + 1) * val, n) for k in range(n_folds) if (k + 1) * val < n]


def fold_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame(folds, "fold int, val_lo int, val_hi int, train_lo int, train_hi int")


def fold_range(spark: SparkSession, n: int, least: int, val: int, step: int, train: int | None = None) -> DataFrame:
    """The folds of `expanding` (or, with the size of the training part, of `rolling`) as a table that the
    tasks make: their number grows with the history."""
    first = n - (least if train is None else train) - val
    many = max(0, first // step + 1) if first >= 0 else 0
    lo = F.lit(first) - F.col("id") * step
    hi = F.lit(n) if train is None else lo + val + train
    return spark.range(many).select(*[c.cast("int").alias(k) for k, c in {"fold": F.col("id"), "val_lo": lo, "val_hi": lo + val, "train_lo": lo + val, "train_hi": hi}.items()])


def _before(sizes: DataFrame, size: str) -> DataFrame:
    """(block, start): the sum of `size` over the blocks before, a row a block."""
    own = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("block", F.coalesce(F.sum(size).over(own), F.lit(0)).alias("start"))


#: Bounds up to which a draw is held against each of them, in its row.
FEW = 64


def cut(d: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """d with `segment`, how many of the bounds are its idx or less, and (bound, segment) of the bounds
    themselves. More than FEW bounds are put in order with the draws within blocks of idx, so no draw meets
    a bound of another block."""
    own = bounds.select(F.col("bound").cast("long").alias("idx")).distinct()
    few = sorted(r["idx"] for r in own.limit(FEW + 1).collect())
    if len(few) <= FEW:
        number = F.array(*map(F.lit, few)).cast("array<bigint>")
        at = d.sparkSession.createDataFrame([(b, k + 1) for k, b in enumerate(few)], "bound long, segment long")
        return d.withColumn("segment", F.size(F.filter(number, lambda b: b <= F.col("idx"))).cast("long")), at
    own = own.withColumn("is_draw", F.lit(False))
    rows = d.withColumn("is_draw", F.lit(True)).unionByName(own, allowMissingColumns=True).withColumn("block", F.floor(F.col("idx") / BLOCK))
    starts = _before(rows.groupBy("block").agg(F.count_if(~F.col("is_draw")).alias("n")), "n")
    # A bound comes ahead of the draw that it is at.
    within = F.count_if(~F.col("is_draw")).over(Window.partitionBy("block").orderBy("idx", "is_draw").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("within", within).join(starts, "block").withColumn("segment", F.col("start") + F.col("within")).drop("block", "start", "within")
    return found.where("is_draw").drop("is_draw"), found.where("NOT is_draw").select(F.col("idx").alias("bound"), "segment")


def fold_sums(d: DataFrame, folds: DataFrame, half_life: float = 0) -> DataFrame:
    """(fold, slot, w, n): decayed weight and number of the draws with a ball in each fold's training
    part; slots are the 33 reds, then the 16 blues.

    The ends of all training parts cut the history into segments, whose sums are added up in order; the
    sum of a fold is the difference of two of these, however long it is. So the work is that of the
    draws and of 49 rows a fold."""
    ends = folds.select(F.explode(F.array("train_lo", "train_hi")).alias("bound"))
    rows, at = cut(d.select("idx", "reds", "blue"), ends)
    slots = F.concat("reds", F.array(F.col("blue") + REDS))
    parts = rows.select("segment", weight(half_life).alias("w"), F.explode(slots).alias("slot")).groupBy("segment", "slot").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    pool = F.explode(F.sequence(F.lit(1), F.lit(REDS + BLUES))).alias("slot")
    # The segment just before each bound: all that is newer than the bound ends with it.
    dense = at.select((F.col("segment") - 1).alias("segment"), pool)
    every = dense.join(parts, ["segment", "slot"], "left")
    upto = Window.partitionBy("slot").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    sums = every.select("segment", "slot", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("w", "n")])
    sums = sums.join(at.select((F.col("segment") - 1).alias("segment"), "bound"), "segment").drop("segment")
    lo, hi = (sums.select(F.col("bound").alias(b), "slot", F.col("w").alias(f"w_{b}"), F.col("n").alias(f"n_{b}")) for b in ("train_lo", "train_hi"))
    both = folds.select("fold", F.col("train_lo").cast("long").alias("train_lo"), F.col("train_hi").cast("long").alias("train_hi")).join(lo, "train_lo").join(hi, ["train_hi", "slot"])
    return both.select("fold", "slot", (F.col("w_train_hi") - F.col("w_train_lo")).cast("double").alias("w"), (F.col("n_train_hi") - F.col("n_train_lo")).alias("n"))


def frequency_picks(d: DataFrame, folds: DataFrame, half_life: float = 0) -> DataFrame:
    """(fold, reds, blue): the six reds and the blue of most decayed weight in each fold's training
    part; ties to the lower ball."""
    red = F.col("slot") <= REDS
    seen = fold_sums(d, folds, half_life).where("n > 0").select("fold", "w", red.alias("is_red"), F.when(red, F.col("slot")).otherwise(F.col("slot") - REDS).alias("ball"))
    place = F.row_number().over(Window.partitionBy("fold", "is_red").orderBy(F.desc(F.round("w", 9)), "ball"))
    best = seen.withColumn("place", place).where((F.col("place") <= PICKED) & F.col("is_red") | (F.col("place") == 1))
    return best.groupBy("fold").agg(F.array_sort(F.collect_list(F.when(F.col("is_red"), F.col("ball")))).alias("reds"), F.max(F.when(~F.col("is_red"), F.col("ball"))).alias("blue"))


def validated(d: DataFrame, folds: DataFrame) -> DataFrame:
    """d's rows, each with the columns of every fold that it validates. A fold's part falls into two or
    three blocks of its own size (a power of two), so that draws meet folds by equal blocks."""
    level = F.floor(F.log2(F.greatest(F.col("val_hi") - F.col("val_lo"), F.lit(1)).cast("double"))).cast("int")
    own = folds.withColumn("level", level)
    levels = [r["level"] for r in own.select("level").distinct().collect()]  # 63 at most
    shifted = lambda c: F.expr(f"shiftright({c}, level)")
    own = own.withColumn("block", F.explode(F.sequence(shifted("CAST(val_lo AS BIGINT)"), shifted("CAST(val_hi - 1 AS BIGINT)"))))
    rows = d.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("block", shifted("CAST(idx AS BIGINT)"))
    met = rows.join(own, ["level", "block"]).where((F.col("idx") >= F.col("val_lo")) & (F.col("idx") < F.col("val_hi")))
    return met.drop("level", "block")


def evaluated(d: DataFrame, folds: DataFrame, picks: DataFrame) -> DataFrame:
    """(fold, n, hit rates, shares of draws with 3, 4, 5 and 6 hits, excess over chance)."""
    p = picks.select("fold", F.col("reds").alias("picked"), F.col("blue").alias("blue_picked"))
    rows = validated(d, folds.join(p, "fold"))
    hits = rows.select("fold", F.size(F.array_intersect("reds", "picked")).alias("h"), (F.col("blue") == F.col("blue_picked")).cast("int").alias("b"))
    share = lambda k: F.avg((F.col("h") >= k).cast("double")).alias(f"share_{k}")
    agg = hits.groupBy("fold").agg(F.count("*").alias("n"), F.sum("h").alias("red_hits"), F.sum("b").alias("blue_hits"), F.avg("h").alias("avg_hits"), *[share(k) for k in (3, 4, 5, 6)])
    return agg.select("*", (F.col("red_hits") / (F.col("n") * PICKED)).alias("red_rate"), (F.col("blue_hits") / F.col("n")).alias("blue_rate"), (F.col("red_hits") - F.col("n") * (PICKED * P_RED)).alias("excess_red"), (F.col("blue_hits") - F.col("n") * P_BLUE).alias("excess_blue"))


def summarised(folds: DataFrame) -> DataFrame:
    """Mean and deviation over folds, ratio to chance, share of folds above it, and a grade."""
    agg = folds.agg(F.avg("red_rate").alias("red_mean"), F.coalesce(F.stddev_pop("red_rate"), F.lit(0.0)).alias("red_std"), F.avg("blue_rate").alias("blue_mean"), F.avg((F.col("red_rate") > P_RED).cast("double")).alias("consistency"), F.avg("excess_red").alias("excess"), F.coalesce(F.stddev_pop("excess_red"), F.lit(0.0)).alias("excess_std"))
    ratio = F.col("excess") / F.greatest(F.col("excess_std"), F.lit(0.001))
    grade = (F.col("excess") > 0).cast("int") + (ratio > 1).cast("int") + (F.col("consistency") > 0.6).cast("int")
    return agg.select("red_mean", "red_std", "blue_mean", (F.col("red_mean") / P_RED).alias("ratio_to_chance"), "consistency", "excess", ratio.alias("information_ratio"), grade.alias("grade"))


def binomial_tail(spark: SparkSession, n: int, p: float) -> DataFrame:
    """(k, tail): P(X >= k) for k = 0..n, by logarithms, so large n don't overflow."""
    lf = F.lit(math.lgamma(n + 1))
    rows = spark.range(0, n + 1).select(F.col("id").alias("k"))
    logs = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(n + 1)])
    term = F.exp(lf - F.get(logs, F.col("k").cast("int")) - F.get(logs, (n - F.col("k")).cast("int")) + F.col("k") * math.log(p) + (n - F.col("k")) * math.log(1 - p))
    own = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # n + 1 rows
    return rows.withColumn("term", term).select("k", F.least(F.sum("term").over(own), F.lit(1.0)).alias("tail"))


def upper_tail(hits: Column, trials: Column, p: float) -> Column:
    """P(X >= hits) of a binomial X in each row: terms follow one another by their ratio, in logarithms."""
    first = F.struct((trials * math.log1p(-p)).alias("log"), F.lit(0.0).alias("tail"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.when(k > 0, F.ln((trials - k + 1) / F.greatest(k, F.lit(1))) + math.log(p / (1 - p))).otherwise(0.0)
        return F.struct(log.alias("log"), (acc["tail"] + F.when(k >= hits, F.exp(log)).otherwise(0.0)).alias("tail"))

    return F.least(F.aggregate(F.sequence(F.lit(0).cast("long"), trials.cast("long")), first, step, lambda acc: acc["tail"]), F.lit(1.0))


def chance(n: Column) -> dict[str, Column]:
    """What picking at random gives over n draws: mean rates, their standard errors, and the share of draws
    with three hits or more, exactly."""
    error = lambda p: F.lit(math.sqrt(p * (1 - p))) / F.sqrt(n.cast("double"))
    return {"red": F.lit(P_RED), "blue": F.lit(P_BLUE), "red_std": error(P_RED), "blue_std": error(P_BLUE), "three_or_more": F.lit(P_THREE)}


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, predicted, actual, n) of columns p and y in bins of equal width; empty: midpoint and 0."""
    spark = rows.sparkSession
    own = rows.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.avg("p").alias("predicted"), F.avg("y").alias("actual"), F.count("*").alias("n"))
    every = spark.range(0, bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", F.coalesce("predicted", (F.col("bin") + 0.5) / bins).alias("predicted"), F.coalesce("actual", F.lit(0.0)).alias("actual"), F.coalesce("n", F.lit(0)).alias("n"))


def calibrated(rows: DataFrame, table: DataFrame, bins: int = 10) -> DataFrame:
    """rows with the actual rate of their bin as `calibrated`."""
    b = rows.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    return b.join(F.broadcast(table.select("bin", F.col("actual").alias("calibrated"))), "bin").drop("bin")


def calibration_error(table: DataFrame) -> DataFrame:
    """(ece): mean distance of predicted and actual, weighted by rows; 1 without rows."""
    return table.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))), F.sum("n")), F.lit(1.0)).alias("ece"))


def disagreement(picks: DataFrame, *keys: str) -> DataFrame:
    """(*keys, red, blue): 1 - |common reds| / |any reds|, and 1 - share of the commonest blue, of the picks
    of each key; 0 for one pick."""
    n = picks.groupBy(*keys).agg(F.count("*").alias("n"))
    on = lambda a, b: a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b))  # noqa: E731 - without keys, a row each
    by = on(picks.select(*keys, F.explode("reds").alias("ball")).groupBy(*keys, "ball").agg(F.count("*").alias("c")), n)
    red = by.groupBy(*keys).agg(F.coalesce(F.try_divide(F.count_if(F.col("c") == F.col("n")), F.count("*")), F.lit(1.0)).alias("common"), F.max("n").alias("n"))
    blue = picks.groupBy(*keys, "blue").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max("c").alias("most"))
    return on(red, blue).select(*keys, F.when(F.col("n") <= 1, 0.0).otherwise(1 - F.col("common")).alias("red"), F.when(F.col("n") <= 1, 0.0).otherwise(1 - F.col("most") / F.col("n")).alias("blue"))


def member_weights(scores: DataFrame, beta: float = 0.9) -> DataFrame:
    """(member, weight, recent): weights after w <- beta w + (1 - beta) score from 1, over the scores of
    each member, oldest (largest idx) first; recent: sum of the last ten scores over ten.

    Scores are folded within blocks of idx; then each member folds its blocks."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "score")), asc=False), lambda x: x["score"])
    blocks = scores.groupBy("member", F.floor(F.col("idx") / BLOCK).alias("block")).agg(ordered.alias("s"))
    folded = F.aggregate("s", F.lit(0.0), lambda a, x: a * beta + x * (1 - beta))
    parts = blocks.select("member", "block", folded.alias("w"), F.pow(F.lit(beta), F.size("s")).alias("left"), F.slice("s", F.greatest(F.size("s") - 9, F.lit(1)), 10).alias("last"))
    rows = parts.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("block", "w", "left", "last")), asc=False).alias("b"))
    w = F.aggregate("b", F.lit(1.0), lambda a, x: a * x["left"] + x["w"])
    newest = F.aggregate("b", F.array().cast("array<double>"), lambda a, x: F.slice(F.concat(a, x["last"]), F.greatest(F.size(a) + F.size(x["last"]) - 9, F.lit(1)), 10))
    rows = rows.withColumn("last", newest)
    last = F.col("last")
    return rows.select("member", w.alias("weight"), (F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / 10.0).alias("recent"))


def voted(picks: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """(*keys, colour, ball, votes, place, chosen): balls by weight of the members that pick them, for each
    key; the first six reds and the first blue are chosen. Weights are a row a member."""
    marks = F.concat(F.transform("reds", lambda b: F.struct(F.lit("red").alias("colour"), b.alias("ball"))), F.array(F.struct(F.lit("blue").alias("colour"), F.col("blue").alias("ball"))))
    v = picks.join(F.broadcast(weights), "member").select(*keys, "weight", F.explode(marks).alias("m")).groupBy(*keys, "m.colour", "m.ball").agg(F.sum("weight").alias("votes"))
    v = v.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "colour").orderBy(F.desc(F.round("votes", 9)), "ball")))  # 33 rows at most
    return v.withColumn("chosen", F.col("place") <= F.when(F.col("colour") == "red", PICKED).otherwise(1))


def elected(votes: DataFrame) -> DataFrame:
    """(reds, blue, confidence): the chosen balls, and the share of the reds' votes that these have (of 1
    vote at least); no row without votes."""
    red = F.col("colour") == "red"
    one = votes.agg(F.array_sort(F.collect_list(F.when(red & F.col("chosen"), F.col("ball")))).alias("reds"), F.max(F.when(~red & F.col("chosen"), F.col("ball"))).alias("blue"), (F.sum(F.when(red & F.col("chosen"), F.col("votes"))) / F.greatest(F.sum(F.when(red, F.col("votes"))), F.lit(1.0))).alias("confidence"))
    return one.where(F.size("reds") > 0)


def run_cv(d: DataFrame, picks: Callable[[DataFrame, DataFrame], DataFrame], method: str = "expanding", **options) -> tuple[DataFrame, DataFrame]:
    """(folds, summary) of a set-based strategy (draws, folds) -> (fold, reds, blue), all folds in one
    job. Methods and their options: expanding (least, val, step), rolling (train, val, step), anchored
    (anchors); another raises ValueError. Without folds both tables are empty."""
    if method not in ("expanding", "rolling", "anchored"):
        raise ValueError(f"unknown method of cross-validation: {method}")
    n = d.count()
    folds = fold_table(d.sparkSession, anchored(n, **options)) if method == "anchored" else fold_range(d.sparkSession, n, **({"least": 0} | options))
    each = evaluated(d, folds, picks(d, folds))
    mean = lambda c: F.avg(c).alias(f"{c}_mean")
    above = lambda c, p: F.avg((F.col(c) > p).cast("double"))
    agg = each.agg(F.count("*").alias("n_folds"), mean("red_rate"), F.coalesce(F.stddev_pop("red_rate"), F.lit(0.0)).alias("red_rate_std"), mean("blue_rate"), F.coalesce(F.stddev_pop("blue_rate"), F.lit(0.0)).alias("blue_rate_std"), mean("share_3"), above("red_rate", P_RED).alias("consistency_red"), above("blue_rate", P_BLUE).alias("consistency_blue"))
    return each, agg.where("n_folds > 0").select("*", (F.col("red_rate_mean") / P_RED).alias("red_to_chance"), (F.col("blue_rate_mean") / P_BLUE).alias("blue_to_chance"))


def softmax(x: str, temperature: float = 1.0, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    e = F.exp((F.col(x) - F.max(x).over(w)) / temperature)
    return e / F.sum(e).over(w)


def entropy_level(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """(*keys, entropy, level) of probabilities: above 0.8 and 0.5 of ln n."""
    agg = df.groupBy(*keys).agg((-F.sum(F.col(p) * F.ln(F.greatest(F.col(p), F.lit(1e-10))))).alias("entropy"), F.count("*").alias("n"))
    share = F.try_divide(F.col("entropy"), F.ln(F.col("n").cast("double")))
    return agg.select(*keys, "entropy", F.when(share > 0.8, "high").when(share > 0.5, "mid").otherwise("low").alias("level"))


def combination_probability(d: DataFrame, f: DataFrame, floor: float = 1e-10) -> DataFrame:
    """(idx, log10_p) of the product of the shares of a draw's seven balls, each floored; f has colour,
    ball, weight. A product of seven shares is given by its logarithm, which can't underflow."""
    total = f.groupBy("colour").agg(F.sum("weight").alias("t"))
    p = f.join(F.broadcast(total), "colour").select("colour", "ball", F.log10(F.greatest(F.col("weight") / F.col("t"), F.lit(floor))).alias("l"))
    marks = F.concat(F.transform("reds", lambda b: F.struct(F.lit("red").alias("colour"), b.alias("ball"))), F.array(F.struct(F.lit("blue").alias("colour"), F.col("blue").alias("ball"))))
    rows = d.select("idx", F.explode(marks).alias("m")).select("idx", "m.*").join(F.broadcast(p), ["colour", "ball"])  # 49 rows
    return rows.groupBy("idx").agg(F.sum("l").alias("log10_p"))


def probability_report(p: DataFrame, k: int = 6, k_blue: int = 5) -> DataFrame:
    """(colour, place, ball, p, entropy, level): the k reds and k_blue blues of most probability, with the
    entropy of their colour; p has colour, ball, p."""
    place = F.row_number().over(Window.partitionBy("colour").orderBy(F.desc(F.round("p", 12)), "ball"))  # 33 rows at most
    top = p.withColumn("place", place).where(F.col("place") <= F.when(F.col("colour") == "red", k).otherwise(k_blue))
    return top.join(F.broadcast(entropy_level(p, "p", "colour")), "colour").select("colour", "place", "ball", "p", "entropy", "level")
