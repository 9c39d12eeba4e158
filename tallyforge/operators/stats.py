"""Counts, matrices and distributions over the history. Tables are long; what never occurs is filled in.

Pairs and values of a draw are made within its row, so each statistic is one aggregation whose map side
already reduces to the pool's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rows
from ..sources.draws import BLUES, REDS, dim, weight

FLOOR = 0.001


def frequencies(d: DataFrame, half_life: float = 0) -> DataFrame:
    """(colour, ball, weight): decayed counts, every ball of both pools."""
    w = weight(half_life)
    marks = F.concat(F.transform("reds", lambda b: F.struct(F.lit("red").alias("colour"), b.alias("ball"))), F.array(F.struct(F.lit("blue").alias("colour"), F.col("blue").alias("ball"))))
    sums = d.select(w.alias("w"), F.explode(marks).alias("m")).groupBy("m.colour", "m.ball").agg(F.sum("w").alias("w"))
    spark = d.sparkSession
    pool = dim(spark, REDS).withColumn("colour", F.lit("red")).unionByName(dim(spark, BLUES).withColumn("colour", F.lit("blue")))
    return pool.join(sums, ["colour", "ball"], "left").select("colour", "ball", F.coalesce("w", F.lit(0.0)).cast("double").alias("weight"))


def _pairs(same: bool) -> Column:
    return F.flatten(F.transform("reds", lambda a: F.transform(F.col("reds") if same else F.filter("reds", lambda b: b != a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def square(spark) -> DataFrame:
    """(a, b): every pair of reds, each ball with itself included."""
    a, b = dim(spark, REDS).toDF("a"), dim(spark, REDS).toDF("b")
    return a.crossJoin(F.broadcast(b))  # 33 x 33


def conditional(d: DataFrame, half_life: float = 0) -> DataFrame:
    """(a, b, p): decayed share of a's draws that also hold b; 0 on the diagonal."""
    w = weight(half_life)
    pair = d.select(w.alias("w"), F.explode(_pairs(False)).alias("x")).groupBy("x.a", "x.b").agg(F.sum("w").alias("w"))
    single = d.select(w.alias("w"), F.explode("reds").alias("a")).groupBy("a").agg(F.sum("w").alias("wa"))
    return square(d.sparkSession).join(pair, ["a", "b"], "left").join(single, "a", "left").select("a", "b", (F.coalesce("w", F.lit(0.0)) / F.greatest(F.coalesce("wa", F.lit(0.0)), F.lit(FLOOR))).alias("p"))


def co_occurrence(d: DataFrame, half_life: float = 0) -> DataFrame:
    """(a, b, value): decayed share of draws with both, each ball with itself included."""
    w = weight(half_life)
    total = d.agg(F.sum(w).alias("total"))
    pair = d.select(w.alias("w"), F.explode(_pairs(True)).alias("x")).groupBy("x.a", "x.b").agg(F.sum("w").alias("w"))
    return square(d.sparkSession).join(pair, ["a", "b"], "left").crossJoin(F.broadcast(total)).select("a", "b", (F.coalesce("w", F.lit(0.0)) / F.col("total")).alias("value"))


def sum_distribution(d: DataFrame) -> DataFrame:
    s = rows.numeric()["sum"]
    return d.select(s.alias("s")).agg(F.avg("s").alias("mean"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("std"), F.min("s").alias("min"), F.max("s").alias("max"))


def distributions(d: DataFrame) -> DataFrame:
    """(dist, k1, k2, k3, p) of span, odd count, zones, AC, position and gap, in one pass."""
    none = F.lit(None).cast("int")
    z = rows.zones()

    def mark(name: str, k1: Column, k2: Column = none, k3: Column = none) -> Column:
        return F.struct(F.lit(name).alias("dist"), k1.cast("int").alias("k1"), k2.cast("int").alias("k2"), k3.cast("int").alias("k3"))

    own = F.array(mark("span", rows.numeric()["span"]), mark("parity", rows.parity()["odd_count"]), mark("zone", z["zone_small"], z["zone_mid"], z["zone_large"]), mark("ac", rows.ac_value()))
    position = F.transform("reds", lambda b, k: mark("position", k + 1, b))
    gap = F.transform(rows.gaps(F.col("reds")), lambda g: mark("gap", g))
    counts = d.select(F.explode(F.concat(own, position, gap)).alias("x")).select("x.*").groupBy("dist", "k1", "k2", "k3").agg(F.count("*").alias("n"))
    totals = d.agg(F.count("*").alias("draws"))
    return counts.crossJoin(F.broadcast(totals)).select("dist", "k1", "k2", "k3", (F.col("n") / (F.col("draws") * F.when(F.col("dist") == "gap", 5).otherwise(1))).alias("p"))


def correlation(d: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(x, y, r): Pearson over the population; 0 for a constant, 1 with itself. One aggregation."""
    names = list(columns)
    base = d.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    moments = [F.covar_pop(x, y).alias(f"{x}|{y}") for k, x in enumerate(names) for y in names[k:]]
    one = base.agg(*moments)

    def r(x: str, y: str) -> Column:
        if x == y:
            return F.lit(1.0)
        a, b = sorted((x, y), key=names.index)
        return F.coalesce(F.try_divide(F.col(f"`{a}|{b}`"), F.sqrt(F.col(f"`{x}|{x}`")) * F.sqrt(F.col(f"`{y}|{y}`"))), F.lit(0.0))

    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r(x, y).alias("r")) for x in names for y in names])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def markov(d: DataFrame, order: int = 2, half_life: float = 0) -> DataFrame:
    """(prev, ball, p): from the union of the `order` draws before to each drawn ball, rows sum to 1."""
    from pyspark.sql import Window

    from .sequence import haloed, own_rows

    h, size = haloed(d.select("idx", "reds"), order)
    before = [F.lead("reds", k).over(Window.partitionBy("block").orderBy("idx")) for k in range(1, order + 1)]
    full = own_rows(h.select("idx", "block", "reds", F.array_distinct(F.flatten(F.array(*before))).alias("prev"), before[-1].alias("last")), size).where(F.col("last").isNotNull())
    cells = full.select(weight(half_life).alias("w"), F.explode("prev").alias("prev"), "reds").select("w", "prev", F.explode("reds").alias("ball")).groupBy("prev", "ball").agg(F.sum("w").alias("w"))
    return cells.select("prev", "ball", (F.col("w") / F.sum("w").over(Window.partitionBy("prev"))).alias("p"))


def blue_transition(d: DataFrame, half_life: float = 0) -> DataFrame:
    """(prev, blue, p) over observed steps from one draw's blue to the next one's."""
    from pyspark.sql import Window

    from .sequence import haloed, own_rows

    h, size = haloed(d.select("idx", "blue"), 1)
    step = own_rows(h.withColumn("prev", F.lead("blue").over(Window.partitionBy("block").orderBy("idx"))), size).where(F.col("prev").isNotNull())
    cells = step.select("prev", "blue", weight(half_life).alias("w")).groupBy("prev", "blue").agg(F.sum("w").alias("w"))
    return cells.select("prev", "blue", (F.col("w") / F.sum("w").over(Window.partitionBy("prev"))).alias("p"))


def top(weights: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """The k balls of most (or least) weight, ties to the lower ball, with their place."""
    from pyspark.sql import Window

    key = F.round("weight", 9)
    few = weights.orderBy(F.desc(key) if descending else F.asc(key), "ball").limit(k)
    return few.withColumn("place", F.row_number().over(Window.orderBy(F.desc(key) if descending else F.asc(key), "ball")))  # k rows




def rank_by_frequency(samples: DataFrame, top_n: int = 20) -> DataFrame:
    """(r1..r6, blue, count, share) of the top_n combinations that samples hold most often; ties to the
    lower balls."""
    keys = [*[f"r{k}" for k in range(1, 7)], "blue"]
    rows_ = samples.select(*[F.get("reds", F.lit(k)).alias(f"r{k + 1}") for k in range(6)], "blue")
    n = rows_.agg(F.count("*").alias("n"))
    best = rows_.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys).limit(top_n)
    return best.crossJoin(F.broadcast(n)).select(*keys, "count", (F.col("count") / F.col("n")).alias("share"))
