"""Metropolis chains over combinations, one per row of a range, in parallel and seeded.

The exact enumeration (`energy`) replaces sampling wherever it fits; this is the sampler itself, for
models whose energy has no closed table. A chain is independent of all others, and its numbers are hashes
of counters, so a lost task repeats the same chain, and another engine can.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.draws import BLUES, PICKED, REDS
from .energy import Model, blue_energy

#: Chances of changing one red, two reds, the blue. Fixed values.
MOVES = (0.5, 0.3, 0.2)
#: Floor of the temperature. Fixed value.
COLDEST = 0.001
SCHEMA = "chain int, sample int, reds array<int>, blue int, energy double, acceptance double"


def energy_function(m: Model) -> Callable[[list[int], int], float]:
    """The energy of a combination in plain Python, from the tables that `energy.terms` uses."""
    get = lambda name, key, floor: -math.log(m.dist.get(name, {}).get(key, floor))
    red_total, blue = max(sum(m.red), 1), blue_energy(m)
    red = [-math.log(max(w / red_total, 1e-4)) for w in m.red]
    w = m.weights

    def energy(reds: list[int], b: int) -> float:
        pairs = [(x, y) for k, x in enumerate(reds) for y in reds[k + 1 :]]
        lift = sum(m.lifts.get(p, 1.0) for p in pairs) / len(pairs)
        zone = (sum(x <= 11 for x in reds), sum(12 <= x <= 22 for x in reds), sum(x >= 23 for x in reds))
        ac = len({y - x for x, y in pairs}) - 5
        return (
            w["sum"] * 0.5 * ((sum(reds) - m.mean) / max(m.std, 0.01)) ** 2
            + w["span"] * get("span", (reds[-1] - reds[0],), 0.001)
            + w["parity"] * get("parity", (sum(x % 2 for x in reds),), 0.001)
            + w["zone"] * get("zone", zone, 0.001)
            + w["ac"] * get("ac", (ac,), 0.001)
            + w["gap"] * sum(get("gap", (y - x,), 0.001) for x, y in zip(reds, reds[1:]))
            + w["position"] * sum(get("position", (k + 1, x), 0.0001) for k, x in enumerate(reds))
            + w["frequency"] * sum(red[x - 1] for x in reds)
            + w["association"] * (-math.log(lift) if lift > 1 else 0.0)
            + w["conditional"] * sum(-math.log(max((m.conditional[x - 1][y - 1] + m.conditional[y - 1][x - 1]) / 2, 1e-4)) for x, y in pairs)
            + blue[b - 1]
        )

    return energy


def uniform(*counters: object) -> float:
    """A number of [0, 1) by its counters alone: 48 bits of their MD5, the same on every engine that has it."""
    return int(md5(":".join(map(str, counters)).encode()).hexdigest()[:12], 16) / 2**48


def moved(reds: list[int], blue: int, u: Callable[[int], float]) -> tuple[list[int], int]:
    """What a step proposes: one or two reds for others, or another blue, by the numbers u(0) to u(4)."""
    if u(0) >= MOVES[0] + MOVES[1]:
        return reds, (blue + int(u(1) * (BLUES - 1))) % BLUES + 1
    rest = [x for x in range(1, REDS + 1) if x not in reds]
    out, new = [int(u(1) * PICKED)], [int(u(2) * len(rest))]
    if u(0) >= MOVES[0]:
        # The second of each is one of those left.
        for own, many, k in ((out, PICKED, 3), (new, len(rest), 4)):
            second = int(u(k) * (many - 1))
            own.append(second + (second >= own[0]))
    return sorted([x for k, x in enumerate(reds) if k not in out] + [rest[k] for k in new]), blue


def chain(energy: Callable[[list[int], int], float], n: int, seed: object, temperature: float = 1.0, tau: float = 3000.0, burn_in: int = 1000, thin: int = 2) -> tuple[list[tuple[tuple[int, ...], int, float]], float]:
    """(states, acceptance): n states (reds, blue, energy) after the burn-in, every thin-th step.

    The temperature falls as exp(-step / tau) during the burn-in only (if tau is positive), and no lower
    than COLDEST. Numbers come from the seed, the step and their place in it."""
    reds = sorted(sorted(range(1, REDS + 1), key=lambda b: (uniform(seed, "start", b), b))[:PICKED])
    blue = int(uniform(seed, "start", 0) * BLUES) + 1
    now, taken, out = energy(reds, blue), 0, []
    steps = burn_in + n * thin
    for step in range(steps):
        t = temperature * math.exp(-step / tau) if step < burn_in and tau > 0 else temperature
        new, b = moved(reds, blue, partial(uniform, seed, step))
        e = energy(new, b)
        if e <= now or uniform(seed, step, 5) < math.exp((now - e) / max(t, COLDEST)):
            reds, blue, now = new, b, e
            taken += 1
        if step >= burn_in and (step - burn_in) % thin == 0:
            out.append((tuple(reds), blue, now))
    return out, taken / max(1, steps)


def sample(spark: SparkSession, m: Model, n: int, n_chains: int = 4, seed: int = 0, **options) -> DataFrame:
    """(chain, sample, reds, blue, energy, acceptance): n samples of each chain, repeats included."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        energy = energy_function(m)
        for part in parts:
            for c in part["id"]:
                got, rate = chain(energy, n, f"{seed}:{c}", **options)
                yield pd.DataFrame({"chain": int(c), "sample": range(len(got)), "reds": [list(r) for r, _, _ in got], "blue": [b for _, b, _ in got], "energy": [e for _, _, e in got], "acceptance": rate})

    return spark.range(0, n_chains, 1, n_chains).mapInPandas(work, SCHEMA)


def distinct_states(samples: DataFrame) -> DataFrame:
    return samples.select("reds", "blue", "energy").dropDuplicates(["reds", "blue"])


def autocorrelation(samples: DataFrame) -> DataFrame:
    """(chain, r): lag-one autocorrelation of the energies, with a floor of 0.001 on the denominator."""
    from pyspark.sql import Window

    w = Window.partitionBy("chain")
    d = samples.withColumn("x", F.col("energy") - F.avg("energy").over(w)).withColumn("before", F.lag("x").over(w.orderBy("sample")))
    return d.groupBy("chain").agg((F.coalesce(F.sum(F.col("x") * F.col("before")), F.lit(0.0)) / F.greatest(F.sum(F.col("x") * F.col("x")), F.lit(0.001))).alias("r"))
