"""The whole space of combinations, scored exactly.

The space has C(33,6) = 1,107,568 red sets, and only the frequency term depends on blue, so reds are
enumerated once and blue is ranked apart. Model tables have at most 33 x 33 cells; they are collected
(bounded by construction) and become literal arrays, so scoring is one projection without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows
from ..sources.draws import BLUES, REDS, weight

#: Weights of the terms. Fixed values.
WEIGHTS = {"sum": 1.0, "span": 1.0, "parity": 1.5, "zone": 1.5, "ac": 0.5, "gap": 0.5, "position": 2.0, "frequency": 0.3, "association": 0.2, "conditional": 0.1}


@dataclass
class Model:
    """Fitted tables of a history, as plain numbers."""

    mean: float
    std: float
    dist: dict[str, dict[tuple, float]]
    red: list[float]
    blue: list[float]
    conditional: list[list[float]]
    lifts: dict[tuple[int, int], float]
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def _cells(d: DataFrame, half_life: float) -> dict[str, dict[tuple, tuple[float, int]]]:
    """(weight, count) of all that the model counts in draws, by kind and key: one aggregation, whose map
    side already reduces to some 1,300 cells, bounded by the pools."""
    none = F.lit(None).cast("int")
    z, at = rows.zones(), [F.get("reds", F.lit(k)) for k in range(6)]

    def cell(kind: str, *keys: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[(keys[k].cast("int") if k < len(keys) else none).alias(f"k{k}") for k in range(3)])

    own = [cell("draws"), cell("total", rows.numeric()["sum"]), cell("span", rows.numeric()["span"]), cell("parity", rows.parity()["odd_count"]), cell("zone", z["zone_small"], z["zone_mid"], z["zone_large"]), cell("ac", rows.ac_value()), cell("blue", F.col("blue"))]
    own += [cell("position", F.lit(k + 1), at[k]) for k in range(6)] + [cell("gap", at[k + 1] - at[k]) for k in range(5)] + [cell("red", x) for x in at]
    own += [cell("pair", at[i], at[j]) for i in range(6) for j in range(i + 1, 6)]
    sums = d.select(weight(half_life).alias("w"), F.explode(F.array(*own)).alias("x")).groupBy("x.kind", "x.k0", "x.k1", "x.k2").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    out: dict[str, dict[tuple, tuple[float, int]]] = {}
    for r in sums.collect():
        out.setdefault(r["kind"], {})[tuple(k for k in (r["k0"], r["k1"], r["k2"]) if k is not None)] = (float(r["w"]), r["n"])
    return out


def _lifts(cells: dict, min_support: float, min_lift: float, n_top: int = 50) -> dict[tuple[int, int], float]:
    """What association.pair_scores gives: of the n_top directed pairs of most lift, ties to the lower."""
    total = cells["draws"][()][0]
    single = {b: w / total for (b,), (w, _) in cells["red"].items()}
    frequent = {b: s if round(s, 9) >= min_support else 0.001 for b, s in single.items()}
    found = {}
    for pair, (w, _) in cells["pair"].items():
        if round(w / total, 9) >= min_support:
            found[pair] = w / total / max(frequent[pair[0]] * frequent[pair[1]], 1e-4)
    best = sorted((p for p in found if round(found[p], 9) >= min_lift), key=lambda p: (-round(found[p], 9), p))
    return {p: found[p] for p in best[: n_top // 2]}


def fit(d: DataFrame, half_life: float = 200, min_support: float = 0.01, min_lift: float = 1.02, mine: bool = True) -> Model:
    """One job over the history; the model's tables follow from its cells on the driver. A history
    without draws gives empty tables."""
    cells = _cells(d, half_life)
    draws = cells.get("draws", {(): (0.0, 0)})[()][1]
    totals = {k[0]: n for k, (_, n) in cells.get("total", {}).items()}
    mean = sum(t * n for t, n in totals.items()) / max(draws, 1)
    std = math.sqrt(max(0.0, sum(t * t * n for t, n in totals.items()) * draws - sum(t * n for t, n in totals.items()) ** 2)) / max(draws, 1)
    dist = {name: {k: n / (draws * (5 if name == "gap" else 1)) for k, (_, n) in cells.get(name, {}).items()} for name in ("span", "parity", "zone", "ac", "position", "gap")}
    ball = lambda kind, b: cells.get(kind, {}).get((b,), (0.0, 0))[0]
    pair = lambda a, b: cells.get("pair", {}).get((min(a, b), max(a, b)), (0.0, 0))[0]
    pool = range(1, REDS + 1)
    conditional = [[pair(a, b) / max(ball("red", a), 0.001) if a != b else 0.0 for b in pool] for a in pool]
    return Model(mean, std, dist, [ball("red", b) for b in pool], [ball("blue", b) for b in range(1, BLUES + 1)], conditional, _lifts(cells, min_support, min_lift) if mine and draws else {})


def combinations(spark: SparkSession) -> DataFrame:
    """reds: every set of six balls. Pairs and triples are made in a row each and spread first, so that
    the million sets come from 5,984 rows in parallel."""
    base = spark.range(1, REDS - 4).select(F.col("id").cast("int").alias("a"))
    for last, new, top in (("a", "b", 29), ("b", "c", 30), ("c", "d", 31), ("d", "e", 32), ("e", "f", 33)):
        base = base.where(F.col(last) < top).withColumn(new, F.explode(F.sequence(F.col(last) + 1, F.lit(top))))
        if new == "c":
            base = base.repartition(spark.sparkContext.defaultParallelism * 2)
    return base.select(F.array(*"abcdef").alias("reds"))


def _log(p: float, floor: float) -> float:
    return math.log(max(p, floor))


def _literal(values: list[float]) -> Column:
    """An array of numbers in three expressions, which the optimizer folds into one literal; an array of
    a thousand literals would be walked anew at each of its many uses."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def terms(m: Model) -> dict[str, Column]:
    """Weighted energies of `reds` (blue apart)."""
    reds = F.col("reds")
    at = [F.get(reds, k) for k in range(6)]
    total = sum(at[1:], at[0])

    def minus_log(name: str, size: int, floor: float = 0.001) -> Column:
        cells = m.dist.get(name, {})
        return _literal([-math.log(cells[(k,)] if (k,) in cells else floor) for k in range(size)])

    z = rows.zones()
    zone = _literal([-math.log(m.dist.get("zone", {}).get((k // 7, k % 7, 6 - k // 7 - k % 7), 0.001)) for k in range(49)])
    gap = minus_log("gap", REDS)
    place = [_literal([-math.log(m.dist.get("position", {}).get((k + 1, b), 0.0001)) for b in range(REDS + 1)]) for k in range(6)]
    all_red = max(sum(m.red), 1)
    red = _literal([-_log(w / all_red, 1e-4) for w in m.red])
    both = _literal([-_log((m.conditional[a][b] + m.conditional[b][a]) / 2, 1e-4) for a in range(REDS) for b in range(REDS)])
    lift = _literal([m.lifts.get((min(a, b), max(a, b)), 1.0) for a in range(1, REDS + 1) for b in range(1, REDS + 1)])
    pair = [(at[i] - 1) * REDS + at[j] - 1 for i in range(6) for j in range(i + 1, 6)]
    add = lambda cs: sum(cs[1:], cs[0])
    deviation = (total - m.mean) / max(m.std, 0.01)
    mean_lift = add([F.get(lift, p) for p in pair]) / 15.0
    out = {
        "sum": deviation * deviation * 0.5,
        "span": F.get(minus_log("span", REDS), at[5] - at[0]),
        "parity": F.get(minus_log("parity", 7), rows.parity()["odd_count"]),
        "zone": F.get(zone, z["zone_small"] * 7 + z["zone_mid"]),
        "ac": F.get(minus_log("ac", 11), rows.ac_value()),
        "gap": add([F.get(gap, at[k + 1] - at[k]) for k in range(5)]),
        "position": add([F.get(place[k], at[k]) for k in range(6)]),
        "frequency": add([F.get(red, x - 1) for x in at]),
        "association": F.when(mean_lift > 1, -F.ln(mean_lift)).otherwise(0.0),
        "conditional": add([F.get(both, p) for p in pair]),
    }
    return {n: c * m.weights[n] for n, c in out.items()}


def energy(m: Model) -> Column:
    t = list(terms(m).values())
    return sum(t[1:], t[0])


def blue_energy(m: Model) -> list[float]:
    total = max(sum(m.blue), 1)
    return [-m.weights["frequency"] * _log(w / total, 1e-4) for w in m.blue]


def constraints(m: Model, strictness: float = 0.8) -> Column:
    """Sum within three deviations and a parity among the fewest most probable ones that reach the
    strictness together."""
    kept, reached = [], 0.0
    for (k,), p in sorted(m.dist["parity"].items(), key=lambda kv: (-kv[1], kv[0])):
        if reached >= strictness:
            break
        kept.append(k)
        reached += p
    total = rows.numeric()["sum"]
    return total.between(m.mean - 3 * m.std, m.mean + 3 * m.std) & rows.parity()["odd_count"].isin(*kept)


def score(m: Model) -> Column:
    """Of `reds`: the sum of ln frequency shares + 0.5 ln max(mean lift, 0.01) - 0.1 energy."""
    total = max(sum(m.red), 1)
    share = _literal([_log(w / total, 1e-10) for w in m.red])
    lift = _literal([m.lifts.get((min(a, b), max(a, b)), 1.0) for a in range(1, REDS + 1) for b in range(1, REDS + 1)])
    at = [F.get("reds", F.lit(k)) for k in range(6)]
    add = lambda cs: sum(cs[1:], cs[0])
    mean_lift = add([F.get(lift, (at[i] - 1) * REDS + at[j] - 1) for i in range(6) for j in range(i + 1, 6)]) / 15.0
    return add([F.get(share, x - 1) for x in at]) + F.ln(F.greatest(mean_lift, F.lit(0.01))) * 0.5 - energy(m) * 0.1


def of_blue(m: Model, what: str) -> Column:
    """What `blue` adds to a red set's energy or score."""
    total = max(sum(m.blue), 1)
    own = blue_energy(m)
    return F.get(_literal(own if what == "energy" else [_log(w / total, 1e-10) - 0.1 * e for w, e in zip(m.blue, own)]), F.col("blue") - 1)


def scored(spark: SparkSession, m: Model, strictness: float = 0.8) -> DataFrame:
    """(reds, energy, score) of every allowed red set."""
    return combinations(spark).where(constraints(m, strictness)).withColumns({"energy": energy(m), "score": score(m)})


def recommend(spark: SparkSession, m: Model, k: int = 10, strictness: float = 0.8) -> DataFrame:
    """The k best (r1..r6, blue, energy, score) of the whole space, ties to the lower numbers.

    Blue adds its own share and energy to any red set, so the k best pairs lie in the k best red sets
    times the k best blues."""
    total = max(sum(m.blue), 1)
    blue = [(_log(w / total, 1e-10) - 0.1 * e, e, b) for b, (w, e) in enumerate(zip(m.blue, blue_energy(m)), 1)]
    few = scored(spark, m, strictness).orderBy(F.desc(F.round("score", 9)), "reds").limit(k)
    options = F.array(*[F.struct(F.lit(b).alias("blue"), F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e, b in sorted(blue, key=lambda x: (-round(x[0], 9), x[2]))[:k]])
    both = few.withColumn("o", F.explode(options))
    out = both.select(*[F.get("reds", F.lit(j)).alias(f"r{j + 1}") for j in range(6)], F.col("o.blue").alias("blue"), (F.col("energy") + F.col("o.e")).alias("energy"), (F.col("score") + F.col("o.s")).alias("score"))
    return out.orderBy(F.desc(F.round("score", 9)), *[f"r{j}" for j in range(1, 7)], "blue").limit(k)


def marginal_exact(spark: SparkSession, m: Model, temperature: float = 1.0) -> DataFrame:
    """(ball, p): probability that a red set drawn with weight exp(-energy / temperature) holds the ball."""
    e = combinations(spark).select("reds", F.exp(-energy(m) / temperature).alias("w"))
    sums = e.agg(F.sum("w").alias("all"), *[F.sum(F.when(F.array_contains("reds", b), F.col("w"))).alias(f"b{b}") for b in range(1, REDS + 1)])
    cells = F.array(*[F.struct(F.lit(b).alias("ball"), (F.col(f"b{b}") / F.col("all")).alias("p")) for b in range(1, REDS + 1)])
    return sums.select(F.explode(cells).alias("x")).select("x.*")


def marginal_share(candidates: DataFrame) -> DataFrame:
    """(ball, p): share of candidates `reds` that hold the ball; no rows for none."""
    n = candidates.agg(F.count("*").alias("n"))
    return candidates.select(F.explode("reds").alias("ball")).groupBy("ball").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("ball", (F.col("c") / F.col("n")).alias("p"))
