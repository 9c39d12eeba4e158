"""Strategies that pick six reds and a blue, an ensemble of weighted members, and permutation tests.

A strategy takes draws to one row (reds sorted, blue). Its tables are bounded by the pools (33 weights,
33 x 33 pairs), so they are gathered in one row, and greedy steps fold over it; ties go to the lower ball.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.draws import BLUES, PICKED, REDS
from . import association, evaluate, sequence, stats

#: Draws -> one row (reds, blue).
Strategy = Callable[[DataFrame], DataFrame]


def _listed(key: Column, value: Column) -> Column:
    """Values in the order of their keys, of a group of at most 33 rows."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"])


def _weights(draws: DataFrame, half_life: float) -> DataFrame:
    """One row: red and blue, the decayed weights of all balls."""
    f = stats.frequencies(draws, half_life).withColumn("slot", F.when(F.col("colour") == "red", F.col("ball")).otherwise(F.col("ball") + REDS))
    return f.agg(_listed(F.col("slot"), F.col("weight")).alias("w")).select(F.slice("w", 1, REDS).alias("red"), F.slice("w", REDS + 1, BLUES).alias("blue"))


def _matrix(cells: DataFrame, value: str) -> DataFrame:
    """One row: m, the values of (a, b) as 33 arrays of 33."""
    rows = cells.groupBy("a").agg(_listed(F.col("b"), F.col(value)).alias("r"))
    return rows.agg(_listed(F.col("a"), F.col("r")).alias("m"))


def _best(pool: int, score: Callable[[Column], Column], skip: Column | None = None, places: int = 9) -> Column:
    """The ball of the greatest score, rounded so that last bits decide nothing."""
    ranked = F.transform(F.sequence(F.lit(1), F.lit(pool)), lambda b: F.struct((-F.round(score(b), places)).alias("s"), b.alias("ball")))
    if skip is not None:
        ranked = F.filter(ranked, lambda x: ~F.array_contains(skip, x["ball"]))
    return F.array_min(ranked)["ball"]


def grown(first: Column, score: Callable[[Column, Column], Column], places: int) -> Column:
    """Six balls: first, then one after another the best by score(picked, ball)."""
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(PICKED)), first.cast("array<int>"), lambda picked, _: F.concat(picked, F.array(_best(REDS, lambda b: score(picked, b), picked, places).cast("int")))), 1, PICKED)


def _pick(one: DataFrame, reds: Column, blue: Column) -> DataFrame:
    return one.select(F.array_sort(reds).alias("reds"), blue.cast("int").alias("blue"))


def _frequent_blue() -> Column:
    return _best(BLUES, lambda b: F.get("blue", b - 1))


def frequency(half_life: float = 0) -> Strategy:
    """The most frequent reds and blue."""
    return lambda draws: _pick(_weights(draws, half_life), grown(F.array(), lambda _, b: F.get("red", b - 1), 9), _frequent_blue())


def greedy(half_life: float = 0) -> Strategy:
    """First the most frequent red, then the ball of most mean P(ball | picked) times its share."""

    def pick(draws: DataFrame) -> DataFrame:
        one = _weights(draws, half_life).crossJoin(F.broadcast(_matrix(stats.conditional(draws, half_life), "p")))  # a row each
        total = F.greatest(F.aggregate("red", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
        mean = lambda picked, b: F.aggregate(picked, F.lit(0.0), lambda a, s: a + F.get(F.get("m", s - 1), b - 1)) / F.size(picked)
        first = F.array(_best(REDS, lambda b: F.get("red", b - 1)))
        return _pick(one, grown(first, lambda picked, b: mean(picked, b) * F.get("red", b - 1) / total, 12), _frequent_blue())

    return pick


def _filled(classes: DataFrame, draws: DataFrame, half_life: float, name: str, sign: int) -> DataFrame:
    """Up to six reds of a class, lower first, then the most (sign 1) or least (-1) frequent others; the
    class's lowest blue, or 1."""
    own = classes.where(F.col("class") == name).agg(F.array_sort(F.collect_list(F.when(F.col("colour") == "red", F.col("ball")))).alias("own"), F.coalesce(F.min(F.when(F.col("colour") == "blue", F.col("ball"))), F.lit(1)).alias("own_blue"))
    one = _weights(draws, half_life).crossJoin(F.broadcast(own))  # a row each
    return _pick(one, grown(F.slice("own", 1, PICKED), lambda _, b: F.get("red", b - 1) * sign, 9), F.col("own_blue"))


def _classes(draws: DataFrame, half_life: int = 50) -> DataFrame:
    """Classes of all balls at the newest draw, whose window is the 3 half lives of draws before it."""
    window = draws.where(F.col("idx") <= 3 * half_life)
    return sequence.hot_cold(sequence.hotness(window, F.col("idx") == 0, half_life))


def hot(half_life: float = 0) -> Strategy:
    """Hot reds of the newest draw's window, filled up by the most frequent."""
    return lambda draws: _filled(_classes(draws), draws, half_life, "hot", 1)


def cold(half_life: float = 0) -> Strategy:
    """Cold reds of the newest draw's window, filled up by the least frequent."""
    return lambda draws: _filled(_classes(draws), draws, half_life, "cold", -1)


def paired(half_life: float = 0, min_support: float = 0.01, min_lift: float = 1.02) -> Strategy:
    """The pair of most lift, then the ball of most mean lift with what is picked (1 for pairs without a
    score) times its share; without pairs the most frequent."""

    def pick(draws: DataFrame) -> DataFrame:
        pairs = association.pair_scores(association.rules(association.itemsets(draws, min_support, 2, half_life)), min_lift)
        both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("c"), "lift").select("c.*", "lift")
        cells = stats.square(draws.sparkSession).join(both, ["a", "b"], "left").select("a", "b", F.coalesce("lift", F.lit(1.0)).alias("lift"))
        first = pairs.agg(F.min(F.struct((-F.round("lift", 9)).alias("s"), "x", "y")).alias("p"))
        one = _weights(draws, half_life).crossJoin(F.broadcast(_matrix(cells, "lift"))).crossJoin(F.broadcast(first))  # a row each
        total = F.greatest(F.aggregate("red", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
        mean = lambda picked, b: F.when(F.size(picked) == 0, 1.0).otherwise(F.aggregate(picked, F.lit(0.0), lambda a, s: a + F.get(F.get("m", s - 1), b - 1)) / F.size(picked))
        start = F.when(F.col("p").isNull(), F.array().cast("array<int>")).otherwise(F.array("p.x", "p.y"))
        return _pick(one, grown(start, lambda picked, b: mean(picked, b) * F.get("red", b - 1) / total, 12), _frequent_blue())

    return pick


#: Strategies by name, as members and for queries.
STRATEGIES = {"frequency": frequency, "greedy": greedy, "hot": hot, "cold": cold, "paired": paired}


@dataclass
class Ensemble:
    """Members by name; weights is (member, weight) and scores (member, n, score), a row for each member
    and update. Their number is that of the members times the updates, not of the draws."""

    spark: SparkSession
    beta: float = 0.9
    members: dict[str, Strategy] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    scores: dict[str, list[float]] = field(default_factory=dict)
    failed: dict[str, Exception] = field(default_factory=dict)
    last: DataFrame | None = None

    def add(self, name: str, strategy: Strategy, weight: float = 1.0) -> None:
        self.members[name], self.weights[name], self.scores[name] = strategy, weight, []

    def remove(self, name: str) -> None:
        for own in (self.members, self.weights, self.scores):
            own.pop(name, None)

    def picks(self, draws: DataFrame) -> DataFrame:
        """(member, reds, blue); a member that fails has no row, and its error is in `failed`. They are kept
        for `update`. All members are one query; only if that fails is each one tried alone, to tell whose
        fault it is."""
        self.failed = {}
        plans: dict[str, DataFrame] = {}
        for name, strategy in self.members.items():
            try:
                one = strategy(draws).select(F.lit(name).alias("member"), F.col("reds").cast("array<int>"), F.col("blue").cast("int")).limit(1)
                plans[name] = one
            except Exception as e:  # noqa: BLE001 - a member may be anything; what it raised is kept
                self.failed[name] = e
        rows = self._collected(plans)
        self.last = self.spark.createDataFrame(rows, "member string, reds array<int>, blue int")
        return self.last

    def _collected(self, plans: dict[str, DataFrame]) -> list[Row]:
        """Their rows, one a member at most."""
        if not plans:
            return []
        try:
            return reduce(DataFrame.unionByName, plans.values()).collect()
        except PySparkException as e:
            if len(plans) == 1:
                self.failed |= dict.fromkeys(plans, e)
                return []
        return [r for name, plan in plans.items() for r in self._collected({name: plan})]

    def weight_table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.weights.items()), "member string, weight double")

    def predict(self, draws: DataFrame) -> DataFrame:
        """(reds, blue, confidence) by votes; no row where no member picked."""
        return evaluate.elected(evaluate.voted(self.picks(draws), self.weight_table()))

    def update(self, reds: list[int], blue: int, picks: DataFrame | None = None) -> None:
        """w <- beta w + (1 - beta)(0.7 hits / 6 + 0.3 if the blue is right), for the members of the last
        picks (or of those given)."""
        drawn = F.array(*map(F.lit, reds))
        score = F.size(F.array_intersect("reds", drawn)) / 6.0 * 0.7 + (F.col("blue") == blue).cast("int") * 0.3
        for r in (self.last if picks is None else picks).select("member", score.alias("s")).collect():  # a row a member
            self.scores[r["member"]].append(r["s"])
            self.weights[r["member"]] = self.beta * self.weights[r["member"]] + (1 - self.beta) * r["s"]

    def summary(self) -> DataFrame:
        """(member, weight, share, recent): recent is the sum of the last ten scores over ten."""
        total = sum(self.weights.values()) or 1.0
        return self.spark.createDataFrame([(n, w, w / total, sum(self.scores[n][-10:]) / 10) for n, w in self.weights.items()], "member string, weight double, share double, recent double")


# Permutation tests

#: Hexadecimal digits of a key that deal a permutation's draws to ranges.
DIGITS = 2
#: Ranges of all shuffles up to which they are broadcast (some 20 bytes each).
STARTS = 1_000_000


def permutation_key(perm: Column, idx: Column, seed: int = 1) -> Column:
    """Order of a draw in a permutation: the same on every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), perm.cast("string"), idx.cast("string")))


def shuffled(draws: DataFrame, n_perm: int, newest: int, seed: int = 1) -> DataFrame:
    """(perm, place, idx) of the `newest` first places: of the sequence itself as perm 0 and of n_perm
    shuffles of it by key.

    A permutation isn't sorted in one task: draws fall into ranges of the key, the ranges are counted,
    and draws are placed within ranges that begin before the last place asked for."""
    perms = F.explode(F.sequence(F.lit(1), F.lit(n_perm)))
    rows = draws.select("idx", perms.alias("perm")).withColumn("key", permutation_key(F.col("perm"), F.col("idx"), seed))
    rows = rows.withColumn("range", F.substring("key", 1, DIGITS))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("perm").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("perm", "range").agg(F.count("*").alias("n")).withColumn("start", before).where(F.col("start") < newest)
    place = F.col("start") + F.row_number().over(Window.partitionBy("perm", "range").orderBy("key", "idx")) - 1
    starts = starts.select("perm", "range", "start")
    # Their number is that of the shuffles times the ranges; joined ahead of the shuffle, they leave only
    # the draws of the ranges that are asked for to be dealt.
    starts = F.broadcast(starts) if n_perm * 16**DIGITS <= STARTS else starts
    placed = rows.join(starts, ["perm", "range"]).select("perm", place.alias("place"), "idx")
    own = draws.where(F.col("idx") < newest).select(F.lit(0).alias("perm"), F.col("idx").alias("place"), "idx")
    return own.unionByName(placed.where(F.col("place") < newest))


def permutation_test(draws: DataFrame, n_folds: int = 4, n_perm: int = 500, seed: int = 1, train_ratio: float = 0.85, strategy: str = "frequency") -> DataFrame:
    """(p, observed) of a strategy by name; see keyed.permutation_test, which takes one's own too."""
    from . import keyed

    return keyed.permutation_test(draws, strategy, n_folds, n_perm, seed, train_ratio)


def hotness_test(draws: DataFrame, idx: int = 0, half_life: int = 50, n_perm: int = 1000, seed: int = 1) -> DataFrame:
    """(p, observed): share of shuffles of the window before idx (3 half lives at most) whose most extreme
    ball, by hotness over all 33 and 16, is as extreme; p is 1 for windows under 20 draws. The window is
    bounded, so a shuffle of it is a few rows."""
    part = draws.where((F.col("idx") > idx) & (F.col("idx") <= idx + 3 * half_life)).select((F.col("idx") - (idx + 1)).alias("idx"), "reds", "blue")
    n = part.count()
    if n < 20:
        return draws.sparkSession.createDataFrame([(1.0, None)], "p double, observed double")
    w = [2.0 ** (-k / half_life) for k in range(n)]
    e = sum(w)
    aged = shuffled(part, n_perm, n, seed).join(F.broadcast(part), "idx")
    marks = F.concat(F.transform("reds", lambda b: b), F.array(F.col("blue") + REDS))
    sums = aged.select("perm", F.get(F.array(*map(F.lit, w)), F.col("place").cast("int")).alias("w"), F.explode(marks).alias("slot")).groupBy("perm", "slot").agg(F.sum("w").alias("w"))
    pool = draws.sparkSession.range(0, n_perm + 1).select(F.col("id").cast("int").alias("perm"), F.explode(F.sequence(F.lit(1), F.lit(REDS + BLUES))).alias("slot"))
    p = F.when(F.col("slot") <= REDS, evaluate.P_RED).otherwise(evaluate.P_BLUE)
    z = F.abs((F.coalesce("w", F.lit(0.0)) / max(e, 1.0) - p) / F.greatest(F.sqrt(p * (1 - p) / max(e, 1.0)), F.lit(0.001)))
    most = pool.join(sums, ["perm", "slot"], "left").groupBy("perm").agg(F.max(F.round(z, 9)).alias("z"))
    seen = most.where("perm = 0").select(F.col("z").alias("observed"))
    return most.where("perm > 0").crossJoin(F.broadcast(seen)).agg(F.avg((F.col("z") >= F.col("observed")).cast("double")).alias("p"), F.max("observed").alias("observed"))
