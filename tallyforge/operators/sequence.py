"""Windows over the sequence of draws, dealt in blocks with a halo.

A frame that looks back over at most `reach` draws needs only the rows of its own block and the first
`reach` rows of the next, so those rows are repeated there and the window is partitioned by block: a
global ORDER BY would bring the whole history into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rows
from ..sources.draws import BLUES, PICKED, REDS

BLOCK = 1024


def haloed(d: DataFrame, reach: int) -> tuple[DataFrame, int]:
    size = max(BLOCK, reach)
    own = F.floor(F.col("idx") / size)
    blocks = F.when((F.col("idx") % size < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return d.withColumn("block", F.explode(blocks)), size


def own_rows(d: DataFrame, size: int) -> DataFrame:
    """Drops the halo."""
    return d.where(F.floor(F.col("idx") / size) == F.col("block")).drop("block")


def past(w: int, *keys: str) -> Window:
    """The w draws before each one (larger idx), without the draw itself."""
    return Window.partitionBy("block", *keys).orderBy("idx").rowsBetween(1, w)


def windowed(d: DataFrame, reach: int, columns: dict[str, Column]) -> DataFrame:
    """d with columns over `past(...)` frames of at most `reach` draws."""
    h, size = haloed(d, reach)
    return own_rows(h.withColumns(columns), size)


def _older() -> Column:
    """Draws before this one that its block and halo hold: all there are, or as many as a window reaches."""
    return F.max("idx").over(Window.partitionBy("block")) - F.col("idx")


def _running(h: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """h with sums over its block from the newest draw down to each one: a window's sum is the difference
    of two of them, so every row costs the same whatever the window."""
    down = Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumns({n: F.sum(c).over(down) for n, c in columns.items()} | {"older": _older()})


def _sum_before(name: str, w: int) -> Column:
    """Sum over the w draws before, of a column of `_running`."""
    order = Window.partitionBy("block").orderBy("idx")
    last = F.last(name).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(F.lead(name, w).over(order), last) - F.col(name)


def _emas(names: list[str], windows: tuple[int, ...]) -> dict[str, Column]:
    """Starts at the newest earlier draw and folds towards older ones; null without earlier draws. The
    fold weighs a draw by (1 - a) to the number of window rows older than it, so it is a window's sum of
    values times (1 - a) to minus the place in the block, scaled back. These grow towards older draws by
    less than 1e70 in a block; the oldest ones, which the window's sum consists of, are never lost."""
    return {f"{n}_{w}": F.col(n) * F.exp(F.col("place") * -math.log(1 - 2.0 / (w + 1))) for w in windows for n in names}


def followed(d: DataFrame, kind: str, windows: tuple[int, ...], features: dict[str, Column] | None = None) -> DataFrame:
    """idx and, for each feature (by default the simple ones) and window, over the draws before: ema (see
    `_emas`), trend (least-squares slope against age, 0 the newest; null under three earlier draws) or vol
    (population deviation; null under two); for kind `delta`, the difference to the draw so many before.

    Slopes and deviations of the simple features come from differences of sums of whole numbers, exactly.
    Given features are columns of any numbers, null counting as 0: differences of sums would lose the
    digits of small values beside large ones, so their slopes and deviations are made anew in each window
    about its own mean, and a row costs its window; for ema, the median of the block is left out of the
    sums and given back after."""
    given = rows.simple() if features is None else features
    h, size = haloed(d.select("idx", *[(c.cast("long") if features is None else F.coalesce(c.cast("double"), F.lit(0.0))).alias(n) for n, c in given.items()]), max(windows))
    names, order, made = list(given), Window.partitionBy("block").orderBy("idx"), {}
    if kind == "delta":
        change = {f"delta_{w}_{n}": F.col(n) - F.lead(n, w).over(order) for w in windows for n in names}
        made = {n: c.cast("int") if features is None else c for n, c in change.items()}
        return own_rows(h.select("idx", "block", *[c.alias(n) for n, c in made.items()]), size)
    base = {n: F.lit(0) for n in names}
    if features is not None and kind != "ema":
        for w in windows:
            frame = past(w)
            n_rows = F.count("*").over(frame)
            for n in names:
                if kind == "trend":
                    # regr_slope as SQL defines it. Spark's own divides the sums of both, not their means, and
                    # more slopes that end in half a place fall to the other side than DuckDB's.
                    made[f"trend_{w}_{n}"] = F.when(n_rows >= 3, F.covar_pop("idx", n).over(frame) / F.var_pop("idx").over(frame))
                else:
                    made[f"vol_{w}_{n}"] = F.when(n_rows >= 2, F.stddev_pop(n).over(frame))
        return own_rows(h.select("idx", "block", *[c.alias(n) for n, c in made.items()]), size)
    if features is not None:
        middle = Window.partitionBy("block")
        h = h.withColumns({f"base_{n}": F.percentile_approx(n, 0.5, 100).over(middle) for n in names})
        h = h.withColumns({n: F.col(n) - F.col(f"base_{n}") for n in names})
        base = {n: F.col(f"base_{n}") for n in names}
    h = h.withColumn("place", F.col("idx") - F.col("block") * size)
    if kind == "ema":
        sums = _running(h, _emas(names, windows))
        for w in windows:
            a, n_rows = 2.0 / (w + 1), F.least(F.col("older"), F.lit(w))
            for n in names:
                newest = F.lead(n, 1).over(order)
                rest = _sum_before(f"{n}_{w}", w) - newest * F.exp((F.col("place") + 1) * -math.log(1 - a))
                made[f"ema_{w}_{n}"] = base[n] + rest * a * F.exp((F.col("place") + n_rows) * math.log(1 - a)) + newest * F.exp((n_rows - 1) * math.log(1 - a))
    else:
        power = {"trend": lambda n: F.col(n) * F.col("place"), "vol": lambda n: F.col(n) * F.col(n)}[kind]
        sums = _running(h, {f"s_{n}": F.col(n) for n in names} | {f"p_{n}": power(n) for n in names})
        for w in windows:
            k = F.least(F.col("older"), F.lit(w)).cast("long")
            for n in names:
                s, p = _sum_before(f"s_{n}", w), _sum_before(f"p_{n}", w)
                if kind == "trend":
                    age = k * (k + 1) / 2  # sum of the distances 1..k, and below of their squares
                    slope = (k * (p - F.col("place") * s) - age * s) / (k * (k * (k + 1) * (2 * k + 1) / 6) - age * age)
                    made[f"trend_{w}_{n}"] = F.when(k >= 3, slope)
                else:
                    made[f"vol_{w}_{n}"] = F.when(k >= 2, F.sqrt(F.greatest((k * p - s * s).cast("double"), F.lit(0.0))) / k)
    return own_rows(sums.select("idx", "block", *[c.alias(n) for n, c in made.items()]), size)


def mask(balls: Column) -> Column:
    """A bit for each ball."""
    return F.aggregate(balls, F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def overlap(d: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Reds shared with each of the w draws before: mean, most, mean difference of sums, flag for >= 5.
    Draws are bit masks, so what two share is one count of bits."""
    total = F.aggregate("reds", F.lit(0), lambda a, x: a + x).cast("long")
    h, size = haloed(d.select("idx", mask(F.col("reds")).alias("m"), total.alias("total")), max(windows))
    order = Window.partitionBy("block").orderBy("idx")
    sums = _running(h, {"s": F.col("total")})
    shared = sums.withColumns({f"o{k}": F.bit_count(F.col("m").bitwiseAND(F.lead("m", k).over(order))) for k in range(1, max(windows) + 1)} | {f"s{w}": _sum_before("s", w) for w in windows})
    out = {}
    for w in windows:
        own = [F.col(f"o{k}") for k in range(1, w + 1)]
        n, most = F.least(F.col("older"), F.lit(w)), F.greatest(*own)
        out[f"sim_{w}_avg_overlap"] = F.try_divide(sum((F.coalesce(c, F.lit(0)) for c in own), F.lit(0)), n)
        out[f"sim_{w}_max_overlap"] = most
        out[f"sim_{w}_avg_sum_diff"] = F.col("total") - F.try_divide(f"s{w}", n)
        out[f"sim_{w}_has_identical"] = F.when(n > 0, (most >= 5).cast("int"))
    return own_rows(shared.select("idx", "block", *[c.alias(n) for n, c in out.items()]), size)


def repeats(d: DataFrame) -> DataFrame:
    """Shared with the draw before; zeros without one."""
    h, size = haloed(d.select("idx", "reds", "blue"), 1)
    order = Window.partitionBy("block").orderBy("idx")
    n = F.coalesce(F.size(F.array_intersect("reds", F.lead("reds").over(order))), F.lit(0))
    n = F.when(F.lead("blue").over(order).isNull(), 0).otherwise(n)
    same = F.coalesce((F.lead("blue").over(order) == F.col("blue")).cast("int"), F.lit(0))
    return own_rows(h.select("idx", "block", n.alias("repeat_red_count"), (n / 6.0).alias("repeat_ratio"), same.alias("repeat_blue")), size)


def _last_seen(colour: str, balls: int) -> list[Column]:
    """For each ball of a colour the idx of the last draw before with it, in the block and its halo. One
    pass from old to new keeps the latest; no row looks at another window than the one before it."""
    before = Window.partitionBy("block").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    hit = (lambda b: F.col("m").bitwiseAND(F.lit(1 << b)) != 0) if colour == "red" else (lambda b: F.col("blue") == b)
    return [F.last(F.when(hit(b), F.col("idx")), ignorenulls=True).over(before) for b in range(1, balls + 1)]


def _gaps(d: DataFrame, lookback: int) -> tuple[DataFrame, int]:
    """d's rows with halo, `n` (draws before, `lookback` at most), and red_gaps: draws since each ball was
    drawn last before this draw, n + 1 if none of the n holds it."""
    h, size = haloed(d.select("idx", "reds", "blue", mask(F.col("reds")).alias("m")), lookback)
    n = F.least(_older(), F.lit(lookback).cast("long"))
    seen = h.withColumns({"n": n} | {f"r{b}": c for b, c in enumerate(_last_seen("red", REDS), 1)})
    gap = [F.when(F.col(f"r{b}") - F.col("idx") <= F.col("n"), F.col(f"r{b}") - F.col("idx")).otherwise(F.col("n") + 1) for b in range(1, REDS + 1)]
    return seen.select("idx", "block", "reds", "blue", "m", "n", F.array(*gap).alias("red_gaps")), size


def ball_gaps(d: DataFrame, lookback: int = 200) -> DataFrame:
    """(idx, ball, hit, gap): draws since each red ball was drawn last before this one."""
    g, size = _gaps(d, lookback)
    return own_rows(g, size).select("idx", "reds", F.posexplode("red_gaps").alias("at", "gap")).select("idx", (F.col("at") + 1).alias("ball"), F.array_contains("reds", F.col("at") + 1).alias("hit"), "gap")


def missing(d: DataFrame, lookback: int = 200) -> DataFrame:
    """Per draw: gaps of its own balls and of all 33 (mean, deviation, skew with a floor of 0.001), and of
    its blue. Moments come from sums of whole numbers."""
    g, size = _gaps(d, lookback)
    blue = F.array(*_last_seen("blue", BLUES))
    g = own_rows(g.withColumn("blue_gap", F.element_at(blue, F.col("blue")) - F.col("idx")), size)
    own = F.transform("reds", lambda b: F.element_at("red_gaps", b))
    total = lambda power: F.aggregate("red_gaps", F.lit(0).cast("long"), lambda a, x: a + math.prod([x] * power)).cast("double")
    s = g.select("idx", "n", "blue_gap", own.alias("own"), *[total(k).alias(f"t{k}") for k in (1, 2, 3)])
    m, m2, m3 = (F.col(f"t{k}") / REDS for k in (1, 2, 3))
    sd = F.sqrt(F.col("t2") * REDS - F.col("t1") * F.col("t1")) / REDS
    third = m3 - 3 * m * m2 + 2 * m * m * m
    mean_own = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x) / PICKED
    return s.select("idx", mean_own.alias("red_avg_missing"), F.array_max("own").alias("red_max_missing"), F.array_min("own").alias("red_min_missing"), F.when(F.col("blue_gap") <= F.col("n"), F.col("blue_gap")).otherwise(F.col("n") + 1).alias("blue_missing"), m.alias("global_avg_missing"), sd.alias("global_missing_std"), (third / F.greatest(F.pow(sd, F.lit(3.0)), F.lit(0.001))).alias("missing_skew"), F.size(F.filter("own", lambda x: x <= 3)).cast("long").alias("hot_red_count"), F.size(F.filter("own", lambda x: x >= 20)).cast("long").alias("cold_red_count"))


def _runs(d: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows with halo, `n` (draws before, `most` at most), red_gaps as in `_gaps`, `runs`: for k = 1..most
    the balls (as bits) that all of the last k draws hold, and blue_streak."""
    g, size = _gaps(d, most)
    order = Window.partitionBy("block").orderBy("idx")
    both = F.lead("m", 1).over(order)
    steps = {"c1": both} | {f"l{k}": F.lead("m", k).over(order) for k in range(2, most + 1)}
    changed = g.withColumn("end", F.when(F.coalesce(F.lead("blue").over(order) != F.col("blue"), F.lit(True)), F.col("idx")))
    from_old = Window.partitionBy("block").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    seen = changed.withColumns(steps | {"run_end": F.last("end", ignorenulls=True).over(from_old), "blue_before": F.lead("blue").over(order), "blue_last": F.element_at(F.array(*_last_seen("blue", BLUES)), F.col("blue"))})
    runs = [F.coalesce("c1", F.lit(0).cast("long"))]
    leads = F.array(*[F.coalesce(f"l{k}", F.lit(0).cast("long")) for k in range(2, most + 1)])
    # Bits that are left after each further draw; a draw that is not there ends all runs.
    left = F.aggregate(leads, F.struct(runs[0].alias("c"), F.array(runs[0]).alias("out")), lambda acc, m: F.when(acc["c"] == 0, acc).otherwise(F.struct(acc["c"].bitwiseAND(m).alias("c"), F.concat(acc["out"], F.array(acc["c"].bitwiseAND(m))).alias("out"))), lambda acc: acc["out"])
    n = F.col("n")
    same = F.least(F.col("run_end") - F.col("idx"), n)
    other = F.least(F.coalesce(F.col("blue_last") - F.col("idx") - 1, n), n)
    blue = F.when(n == 0, F.lit(0)).when(F.col("blue_before") == F.col("blue"), same).otherwise(-other)
    return seen.select("idx", "block", "n", "red_gaps", left.alias("runs"), blue.cast("int").alias("blue_streak")), size


def ball_streaks(d: DataFrame, most: int = 50) -> DataFrame:
    """(idx, ball, streak): draws in a row before this one with the ball (positive) or without it."""
    g, size = _runs(d, most)
    rows_ = own_rows(g, size).select("idx", "runs", F.posexplode("red_gaps").alias("at", "gap"))
    ball = F.col("at") + 1
    held = F.size(F.filter("runs", lambda c: F.call_function("shiftright", c, ball).bitwiseAND(F.lit(1)) == 1))
    return rows_.select("idx", ball.alias("ball"), F.when(held > 0, held).otherwise((1 - F.col("gap")).cast("int")).alias("streak"))


def streaks(d: DataFrame, most: int = 50) -> DataFrame:
    """Per draw, over the draws before: the longest runs of a red ball with and without, the balls in
    runs of more than 2 with and more than 10 without, and the run of this draw's blue."""
    g, size = _runs(d, most)
    without = F.transform("red_gaps", lambda x: x - 1)
    out = own_rows(g, size)
    longest = F.size(F.filter("runs", lambda c: c != 0))
    return out.select("idx", longest.alias("red_max_positive_streak"), F.array_max(without).cast("int").alias("red_max_negative_streak"), F.coalesce(F.bit_count(F.get("runs", F.lit(2))), F.lit(0)).cast("long").alias("current_hot_streak_sum"), F.size(F.filter(without, lambda x: x > 10)).cast("long").alias("current_cold_streak_sum"), "blue_streak")


def hotness(d: DataFrame, at: Column, half_life: int = 50, least: float = 10) -> DataFrame:
    """(idx, colour, ball, z) for the draws that `at` selects: decayed share of each ball over the
    3 * half_life draws before, against its even share, in standard errors. Draws with fewer earlier
    draws or effective draws than `least` have no rows."""
    reach = 3 * half_life
    h, size = haloed(d.select("idx", "reds", "blue"), reach)
    f = past(reach)
    seen = F.collect_list(F.struct("reds", "blue")).over(f)
    rows_ = own_rows(h.select("idx", "block", seen.alias("seen")), size).where(at & (F.size("seen") >= least))
    per = rows_.select("idx", F.size("seen").alias("n"), F.posexplode("seen").alias("age", "x"))
    w = F.exp(F.col("age") * (-math.log(2) / half_life))
    marks = F.concat(F.transform("x.reds", lambda b: F.struct(F.lit("red").alias("colour"), b.alias("ball"))), F.array(F.struct(F.lit("blue").alias("colour"), F.col("x.blue").alias("ball"))))
    effective = rows_.select("idx", F.aggregate(F.sequence(F.lit(0), F.size("seen") - 1), F.lit(0.0), lambda a, k: a + F.exp(k * (-math.log(2) / half_life))).alias("effective"), F.explode(F.array(F.lit("red"), F.lit("blue"))).alias("colour"))
    pool = effective.where(F.col("effective") >= least).select("idx", "colour", "effective", F.explode(F.when(F.col("colour") == "red", F.sequence(F.lit(1), F.lit(REDS))).otherwise(F.sequence(F.lit(1), F.lit(BLUES)))).alias("ball"))
    sums = per.select("idx", w.alias("w"), F.explode(marks).alias("m")).groupBy("idx", "m.colour", "m.ball").agg(F.sum("w").alias("w"))
    p = F.when(F.col("colour") == "red", PICKED / REDS).otherwise(1.0 / BLUES)
    z = (F.coalesce("w", F.lit(0.0)) / F.col("effective") - p) / F.sqrt(p * (1 - p) / F.col("effective"))
    return pool.join(sums, ["idx", "colour", "ball"], "left").select("idx", "colour", "ball", z.alias("z"))


def hotness_of_all(d: DataFrame, half_life: int = 50, least: float = 10) -> DataFrame:
    """hotness of every draw, from running sums of each ball within a block: weights count from the
    block's newest draw (2 to the power of -25 at the least), and a window is the sum down to the draw
    before less the sum down to the draw that has just left it."""
    reach = 3 * half_life
    h, size = haloed(d.select("idx", "reds", "blue"), reach)
    hits = {("red", b): F.array_contains("reds", b) for b in range(1, REDS + 1)} | {("blue", b): F.col("blue") == b for b in range(1, BLUES + 1)}
    from_old = Window.partitionBy("block").orderBy(F.desc("idx"))
    rate, age = math.log(2) / half_life, F.col("idx") - F.col("block") * size
    # A row a draw, with a sum a ball: a block is put in order once, not once for each ball.
    total = {f"{c}{b}": F.sum(F.when(hit, F.exp(age * -rate)).otherwise(0.0)).over(from_old.rowsBetween(Window.unboundedPreceding, 0)) for (c, b), hit in hits.items()}
    sums = h.select("idx", "block", *[c.alias(n) for n, c in total.items()], (F.row_number().over(from_old) - 1).alias("older"))
    w = {n: F.lag(n, 1, 0.0).over(from_old) - F.lag(n, reach + 1, 0.0).over(from_old) for n in total}
    own = own_rows(sums.select("idx", "block", "older", *[(c * F.exp((age + 1) * rate)).alias(n) for n, c in w.items()]), size)
    n = F.least("older", F.lit(reach))
    effective = (1 - F.exp(n * -rate)) / (1 - math.exp(-rate))
    own = own.withColumns({"n": n, "effective": effective}).where((F.col("n") >= least) & (F.col("effective") >= least))
    balls = F.explode(F.array(*[F.struct(F.lit(c).alias("colour"), F.lit(b).alias("ball"), F.col(f"{c}{b}").alias("w")) for c, b in hits]))
    p = F.when(F.col("colour") == "red", PICKED / REDS).otherwise(1.0 / BLUES)
    z = (F.col("w") / F.col("effective") - p) / F.sqrt(p * (1 - p) / F.col("effective"))
    return own.select("idx", "effective", balls.alias("m")).select("idx", "effective", "m.*").select("idx", "colour", "ball", z.alias("z"))


def hot_cold(z: DataFrame, hot: float = 2.0, cold: float = -1.5) -> DataFrame:
    """z with its class."""
    s = F.round("z", 9)  # so that the last bits of a sum decide nothing
    return z.withColumn("class", F.when(s >= hot, "hot").when(s >= 0.5, "warm").when(s >= -0.5, "neutral").when(s >= cold, "cool").otherwise("cold"))


def intervals(d: DataFrame, idx: int, lookback: int = 200) -> DataFrame:
    """(ball, age_of_oldest, avg_interval, overdue) over the draws before idx; empty under ten.

    The age is counted from the far end of the window, to the oldest draw with the ball."""
    part = d.where((F.col("idx") > idx) & (F.col("idx") <= idx + lookback)).select((F.col("idx") - idx - 1).alias("gap"), "reds")
    n = part.agg(F.count("*").alias("n"))
    seen = part.select("gap", F.explode("reds").alias("ball")).groupBy("ball").agg(F.max("gap").alias("oldest"), F.min("gap").alias("newest"), F.count("*").alias("c"))
    spark = d.sparkSession
    pool = spark.range(1, REDS + 1).select(F.col("id").cast("int").alias("ball"))
    age = F.when(F.col("oldest").isNotNull(), F.col("n") - F.col("oldest")).otherwise(F.col("n") + 1)
    mean = F.when(F.col("c") > 1, (F.col("oldest") - F.col("newest")) / (F.col("c") - 1)).otherwise(F.lit(REDS / PICKED))
    return pool.join(seen, "ball", "left").crossJoin(F.broadcast(n)).where("n >= 10").select("ball", age.alias("age_of_oldest"), mean.alias("avg_interval"), (age / mean).alias("overdue"))


def money(d: DataFrame, w: int = 50) -> DataFrame:
    """d's idx, sales, jackpot with mean and deviation of the positive ones before: null under two
    earlier draws, (0, 1) under two positive ones."""
    h, size = haloed(d.select("idx", "sales", "jackpot"), w)
    out = {}
    for x in ("sales", "jackpot"):
        v = F.when(F.col(x) > 0, F.col(x).cast("double"))
        some = F.count(v).over(past(w)) >= 2
        enough = F.count("*").over(past(w)) >= 2
        out[f"{x}_mean"] = F.when(enough, F.when(some, F.avg(v).over(past(w))).otherwise(0.0))
        out[f"{x}_std"] = F.when(enough, F.when(some, F.stddev_pop(v).over(past(w))).otherwise(1.0))
    return own_rows(h.withColumns(out), size)


def first_prizes(d: DataFrame, w: int = 20) -> DataFrame:
    """Draws in a row before without a first prize, and sum and mean of first prizes over the window."""
    h, size = haloed(d.select("idx", "first_prize_count"), w)
    n, c = F.count("*").over(past(w)), F.coalesce("first_prize_count", F.lit(0))
    run = F.coalesce(F.min(F.when(c > 0, F.col("idx"))).over(past(w)) - F.col("idx") - 1, n)
    total = F.coalesce(F.sum(c).over(past(w)), F.lit(0))
    return own_rows(h.select("idx", "block", run.alias("no_first_prize_streak"), total.alias("recent_first_prize_sum"), (total / F.greatest(n, F.lit(1))).alias("recent_first_prize_mean")), size)
