"""Strategies refitted for many shuffles and folds in one job.

A fold of a shuffle trains on all places behind the newest few. What strategies count (balls, and pairs of
balls) is therefore the history's count less that of the newest places, and what they look at in order (the
window of the hot and cold balls) is a few places behind them. So a shuffle needs its newest places only,
whatever the length of the history (`shuffles`); one row of counts stands for each shuffle and fold, and a strategy is
an expression over such a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.draws import BLUES, PICKED, REDS
from . import evaluate, shuffles, strategies
from .stats import FLOOR

BALLS = REDS + BLUES
#: Half life of the window of hot and cold balls, and draws that it needs.
HALF_LIFE, LEAST = 50, 10


#: A table of one row for each key, with n (training draws), red and blue (counts by ball), pair (counts of
#: two balls, 33 by 33) and z (hotness of all balls, null where the window is too short), to the same rows
#: with `reds` and `pick`, the blue.
Picked = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Keyed:
    """A strategy over rows of counts; `pairs` and `window` say whether it looks at pair and z."""

    picked: Picked
    pairs: bool = False
    window: bool = False


def _order(pool: int, key: Callable[[Column], Column], kept: Callable[[Column], Column] | None = None) -> Column:
    """Balls of the pool by key, then by ball."""
    balls = F.sequence(F.lit(1), F.lit(pool))
    balls = balls if kept is None else F.filter(balls, kept)
    return F.transform(F.array_sort(F.transform(balls, lambda b: F.struct(key(b).alias("k"), b.alias("ball")))), lambda x: x["ball"])


def _red(b: Column) -> Column:
    return F.get("red", b - 1)


def _frequent_blue() -> Column:
    return F.get(_order(BLUES, lambda b: -F.get("blue", b - 1)), F.lit(0))


def _frequent() -> Column:
    """The most frequent reds, of those that occur at all."""
    return F.slice(_order(REDS, lambda b: -_red(b), lambda b: _red(b) > 0), 1, PICKED)


def _shared(mean: Callable[[Column, Column], Column], first: Column) -> Column:
    """Six balls: first, then one after another that of most mean value with what is picked, times its share."""
    total = F.greatest(F.aggregate("red", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return strategies.grown(first, lambda picked, b: mean(picked, b) * _red(b) / total, 12)


def _greedy() -> Column:
    p = lambda s, b: F.get(F.get("pair", s - 1), b - 1) / F.greatest(_red(s), F.lit(FLOOR))
    mean = lambda picked, b: F.aggregate(picked, F.lit(0.0), lambda a, s: a + p(s, b)) / F.size(picked)
    return _shared(mean, F.slice(_order(REDS, lambda b: -_red(b)), 1, 1))


def _paired(rows: DataFrame, min_support: float = 0.01, min_lift: float = 1.02, most: int = 25) -> DataFrame:
    """As strategies.paired: the pairs over both limits, `most` of them (a rule each way), by lift."""
    share = lambda x: x / F.col("n")
    often = lambda x: F.round(share(x), 9) >= min_support
    alone = lambda b: F.when(often(_red(b)), share(_red(b))).otherwise(0.001)
    cell = lambda x, y: F.get(F.get("pair", x - 1), y - 1)
    lift = lambda x, y: share(cell(x, y)) / F.greatest(alone(x) * alone(y), F.lit(1e-4))
    upper = F.sequence(F.lit(1), F.lit(REDS))
    made = F.flatten(F.transform(upper, lambda x: F.transform(F.filter(upper, lambda y: (y > x) & often(cell(x, y))), lambda y: F.struct((-F.round(lift(x, y), 9)).alias("k"), x.alias("x"), y.alias("y"), lift(x, y).alias("lift")))))
    best = F.slice(F.array_sort(F.filter(made, lambda t: -t["k"] >= min_lift)), 1, most)

    def mean(picked: Column, b: Column) -> Column:
        own = lambda s: F.coalesce(F.get(F.filter("best", lambda t: (t["x"] == F.least(s, b)) & (t["y"] == F.greatest(s, b))), F.lit(0))["lift"], F.lit(1.0))
        return F.when(F.size(picked) == 0, 1.0).otherwise(F.aggregate(picked, F.lit(0.0), lambda a, s: a + own(s)) / F.size(picked))

    first = F.flatten(F.transform(F.slice("best", 1, 1), lambda t: F.array(t["x"], t["y"])))
    return rows.withColumn("best", best).withColumns({"reds": _shared(mean, first), "pick": _frequent_blue()}).drop("best")


def _filled(rows: DataFrame, hot: bool) -> DataFrame:
    """Up to six reds of the class, lower first, then the most (hot) or least (cold) frequent others; the
    class's lowest blue, or 1."""
    z = lambda k: F.round(F.get("z", k - 1), 9)
    own = lambda k: F.coalesce(z(k) >= 2.0 if hot else z(k) < -1.5, F.lit(False))
    first = F.slice(F.filter(F.sequence(F.lit(1), F.lit(REDS)), own), 1, PICKED)
    blue = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(BLUES)), lambda b: own(b + REDS))), F.lit(1))
    return rows.withColumns({"reds": strategies.grown(first, lambda _, b: _red(b) * (1 if hot else -1), 9), "pick": blue})


#: The strategies of strategies.STRATEGIES, without decay, over rows of counts.
KEYED = {
    "frequency": Keyed(lambda rows: rows.withColumns({"reds": _frequent(), "pick": _frequent_blue()})),
    "greedy": Keyed(lambda rows: rows.withColumns({"reds": _greedy(), "pick": _frequent_blue()}), pairs=True),
    "hot": Keyed(lambda rows: _filled(rows, True), window=True),
    "cold": Keyed(lambda rows: _filled(rows, False), window=True),
    "paired": Keyed(_paired, pairs=True),
}


def _slots(pairs: bool) -> Column:
    """The slots that a draw counts in: 0 to 32 reds, to 48 blues, then pairs row by row, both ways."""
    own = F.concat(F.transform("reds", lambda b: b - 1), F.array(F.col("blue") + REDS - 1))
    both = F.flatten(F.transform("reds", lambda a: F.transform(F.filter("reds", lambda b: b != a), lambda b: (a - 1) * REDS + b - 1 + BALLS)))
    return F.concat(own, both) if pairs else own


def refitted(draws: DataFrame, strategy: Keyed, val: int, n_folds: int, n_perm: int, seed: int = 1) -> DataFrame:
    """(perm, fold, reds, blue, hits, blue_hits): what the strategy picks from the draws behind fold
    number `fold` of each shuffle (perm 0: the history itself), and how often the `val` draws of the fold
    hit it. Fold k validates places k val to (k + 1) val."""
    n, reach, rate = draws.count(), 3 * HALF_LIFE, math.log(2) / HALF_LIFE
    slots = BALLS + (REDS * REDS if strategy.pairs else 0)
    counts = shuffles.fold_counts(draws, n, val, n_folds, n_perm, seed, strategy.pairs, reach if strategy.window else 0, rate)
    seen = draws.select(F.explode(_slots(strategy.pairs)).alias("slot")).groupBy("slot").agg(F.count("*").alias("h"))
    every = draws.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(seen, "slot", "left")  # a row a slot
    history = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("h", F.lit(0)).alias("h")))), lambda x: x["h"]).alias("h"))
    rows = counts.crossJoin(F.broadcast(history)).withColumn("t", F.zip_with("h", "before", lambda h, x: (h - x).cast("double")))  # one row
    columns = {"n": F.lit(n) - (F.col("fold") + 1) * val, "red": F.slice("t", 1, REDS), "blue": F.slice("t", REDS + 1, BLUES)}
    if strategy.pairs:
        columns["pair"] = F.transform(F.sequence(F.lit(0), F.lit(REDS - 1)), lambda a: F.slice("t", a * REDS + (BALLS + 1), F.lit(REDS)))
    if strategy.window:
        columns["z"] = _hotness(n, val, n_folds)
    hit = lambda slot: F.get("c", slot.cast("int"))
    picked = strategy.picked(rows.withColumns(columns).drop("t", "h", "before", "w"))
    return picked.select("perm", "fold", F.array_sort("reds").alias("reds"), F.col("pick").cast("int").alias("blue"), F.aggregate("reds", F.lit(0).cast("long"), lambda a, b: a + hit(b - 1)).alias("hits"), hit(F.col("pick") + REDS - 1).alias("blue_hits"))


def _hotness(n: int, val: int, n_folds: int) -> Column:
    """z of all balls at the newest training draw of a fold, from the decayed sums w of the window behind it."""
    reach, rate = 3 * HALF_LIFE, math.log(2) / HALF_LIFE
    z = F.lit(None).cast("array<double>")
    for fold in range(n_folds):  # a few folds
        size = min(reach, n - (fold + 1) * val - 1)
        effective = sum(math.exp(-k * rate) for k in range(max(0, size)))
        if size >= LEAST and effective >= LEAST:
            z = F.when(F.col("fold") == fold, F.transform(F.sequence(F.lit(1), F.lit(BALLS)), _z(effective))).otherwise(z)
    return z


def _z(effective: float) -> Callable[[Column], Column]:
    return lambda k: (F.get("w", k - 1) / effective - _even(k)) / F.sqrt(_even(k) * (1 - _even(k)) / effective)


def _even(k: Column) -> Column:
    return F.when(k <= REDS, evaluate.P_RED).otherwise(evaluate.P_BLUE)


def permutation_test(draws: DataFrame, strategy: str | Keyed = "frequency", n_folds: int = 4, n_perm: int = 500, seed: int = 1, train_ratio: float = 0.85) -> DataFrame:
    """(p, observed): share of shuffles of the sequence whose walk-forward evaluation of the strategy,
    refitted for every fold, hits as often or more; p is 1 without folds."""
    folds = evaluate.walk_forward(draws.count(), n_folds, train_ratio)
    spark = draws.sparkSession
    if not folds:
        return spark.createDataFrame([(1.0, None)], "p double, observed double")
    val = folds[0][2]
    each = refitted(draws, KEYED[strategy] if isinstance(strategy, str) else strategy, val, len(folds), n_perm, seed)
    hits = each.groupBy("perm").agg(F.sum("hits").alias("h"))
    # One row for each shuffle; the history's own is perm 0.
    both = hits.select("h", F.max(F.when(F.col("perm") == 0, F.col("h"))).over(Window.partitionBy()).alias("o"), "perm")
    agg = both.where("perm > 0").agg(F.avg((F.col("h") >= F.col("o")).cast("double")).alias("p"), F.max("o").alias("observed"))
    return agg.select("p", (F.col("observed") / (val * len(folds))).alias("observed"))
