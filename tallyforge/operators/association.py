"""Frequent ball sets and rules between them, with decayed support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.draws import weight


def _subsets() -> Column:
    """Every set of one to three balls of a draw, as (a, b, c) with null for absent ones, made in its row."""
    r, none = F.col("reds"), F.lit(None).cast("int")
    at = [F.get(r, k) for k in range(6)]
    triple = lambda *x: F.struct(*[(x[k] if k < len(x) else none).alias(n) for k, n in enumerate("abc")])
    return F.array(*[triple(at[i]) for i in range(6)], *[triple(at[i], at[j]) for i in range(6) for j in range(i + 1, 6)], *[triple(at[i], at[j], at[k]) for i in range(6) for j in range(i + 1, 6) for k in range(j + 1, 6)])


def itemsets(d: DataFrame, min_support: float = 0.01, max_size: int = 3, half_life: float = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, a, b, c, size, support) of frequent sets, all sizes in one aggregation.

    Support falls with size, so a set of frequent support has frequent parts and no candidate step is
    needed: the filter after the sum gives what level-wise mining gives.
    """
    w = weight(half_life)
    size = max(1, min(3, max_size))
    total = d.groupBy(*keys).agg(F.sum(w).alias("total"))
    cells = d.select(*keys, w.alias("w"), F.explode(_subsets()).alias("x")).select(*keys, "w", "x.*")
    cells = cells.withColumn("size", F.when(F.col("c").isNotNull(), 3).when(F.col("b").isNotNull(), 2).otherwise(1)).where(F.col("size") <= size)
    sums = cells.groupBy(*keys, "a", "b", "c", "size").agg(F.sum("w").alias("w"))
    joined = sums.join(F.broadcast(total), list(keys)) if keys else sums.crossJoin(F.broadcast(total))  # a row for each key value
    return joined.withColumn("support", F.col("w") / F.col("total")).where(F.round("support", 9) >= min_support).drop("w", "total")


def rules(sets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, ant1, ant2, con, size, support, lift, confidence): pairs both ways, triples two to one."""
    k = list(keys)
    one = sets.where("size = 1").select(*k, F.col("a").alias("con"), F.col("support").alias("s_con"))
    pair = sets.where("size = 2").select(*k, F.col("a").alias("p1"), F.col("b").alias("p2"), F.col("support").alias("s_pair"))
    none = F.lit(None).cast("int")
    way = lambda x, y, z: F.struct(x.alias("ant1"), y.alias("ant2"), z.alias("con"))
    a, b, c = (F.col(n) for n in "abc")
    both = sets.where("size = 2").select(*k, "size", "support", F.explode(F.array(way(a, none, b), way(b, none, a))).alias("r"))
    three = sets.where("size = 3").select(*k, "size", "support", F.explode(F.array(way(a, b, c), way(a, c, b), way(b, c, a))).alias("r"))
    every = both.unionByName(three).select(*k, "size", "support", "r.*")
    ant = one.select(*k, F.col("con").alias("ant1"), F.col("s_con").alias("s_one"))
    full = every.join(one, [*k, "con"], "left").join(ant, [*k, "ant1"], "left").join(pair.withColumnsRenamed({"p1": "ant1", "p2": "ant2"}), [*k, "ant1", "ant2"], "left")
    s_con = F.coalesce("s_con", F.lit(0.001))
    s_ant = F.coalesce(F.when(F.col("size") == 2, F.col("s_one")).otherwise(F.col("s_pair")), F.lit(0.001))
    lift = F.col("support") / F.greatest(s_ant * s_con, F.lit(1e-4))
    return full.select(*k, "ant1", "ant2", "con", "size", "support", lift.alias("lift"), (F.col("support") / F.greatest(s_ant, F.lit(0.001))).alias("confidence"))


def pair_scores(r: DataFrame, min_lift: float = 1.02, n_top: int = 50) -> DataFrame:
    """(x, y, lift) of the n_top directed rules between two balls of most lift; the greater of both ways.

    Ties go to the lower pair, whose two directions are neighbours.
    """
    x, y = F.least("ant1", "con"), F.greatest("ant1", "con")
    two = r.where((F.col("size") == 2) & (F.round("lift", 9) >= min_lift)).select(x.alias("x"), y.alias("y"), "ant1", F.round("lift", 9).alias("key"), "lift")
    return two.orderBy(F.desc("key"), "x", "y", "ant1").limit(n_top).groupBy("x", "y").agg(F.max("lift").alias("lift"))


def stability(d: DataFrame, n_splits: int = 3, min_lift: float = 1.2) -> DataFrame:
    """(x, y, share) of pairs over min_lift in two segments of the history or more; the segments are
    mined together, as one more key."""
    n = d.agg(F.count("*").alias("n"))
    cut = F.least(F.expr(f"idx div greatest(n div {n_splits}, 1)"), F.lit(n_splits - 1)).cast("int")
    parts = d.crossJoin(F.broadcast(n)).withColumn("segment", cut)
    r = rules(itemsets(parts, 0.01, 2, 0, ("segment",)), ("segment",)).where((F.col("size") == 2) & (F.round("lift", 9) > min_lift))
    return r.select("segment", F.least("ant1", "con").alias("x"), F.greatest("ant1", "con").alias("y")).distinct().groupBy("x", "y").agg(F.count("*").alias("n")).where("n >= 2").select("x", "y", (F.col("n") / n_splits).alias("share"))


def combination_scores(combos: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, mean, min, max lift and share over 1.1) of the 15 pairs of each combination `reds`; pairs
    without a score count 1. The scores are at most 528 rows and broadcast."""
    made = F.flatten(F.transform("reds", lambda a: F.transform(F.filter("reds", lambda b: b > a), lambda b: F.struct(a.alias("x"), b.alias("y")))))
    rows = combos.select("idx", F.explode(made).alias("p")).select("idx", "p.x", "p.y").join(F.broadcast(pairs), ["x", "y"], "left")
    lift = F.coalesce("lift", F.lit(1.0))
    return rows.groupBy("idx").agg(F.avg(lift).alias("mean_lift"), F.min(lift).alias("min_lift"), F.max(lift).alias("max_lift"), F.avg((F.round(lift, 9) > 1.1).cast("double")).alias("share_over"))
