"""A small attention model over sequences of draw features, in NumPy behind vectorised functions, and the
vector functions it is made of as columns.

One block: self-attention, a feed-forward layer with GELU, each with a residual and a normalisation with
gain and shift; then mean pooling and two heads (33 reds, 16 blues). Gradients are analytic. `train` takes
one step a pass over all rows; mini-batches are in `training`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.draws import BLUES, REDS

Params = dict[str, np.ndarray]
EPS = 1e-5


# Vectors in the query: built-in functions over arrays


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mat_vec(matrix: Column, v: Column) -> Column:
    """Products of the rows of array<array<double>> with a vector."""
    return F.transform(matrix, lambda row: dot(row, v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body's own functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(v: Column) -> Column:
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v))


def variance(v: Column) -> Column:
    return let(mean(v), lambda m: F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(v)))


def layer_norm(v: Column, gain: Column | None = None, shift: Column | None = None) -> Column:
    """With gain and shift of each place, if they are given."""
    out = let(mean(v), lambda m: let(F.sqrt(variance(v) + EPS), lambda s: F.transform(v, lambda x: (x - m) / s)))
    out = mul(out, gain) if gain is not None else out
    return add(out, shift) if shift is not None else out


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(v: Column) -> Column:
    return F.transform(v, lambda x: 1.0 / (1.0 + F.exp(-x)))


def gelu(v: Column) -> Column:
    return F.transform(v, lambda x: x * 0.5 * (1.0 + F.tanh((x + x * x * x * 0.044715) * 0.7978845608028654)))


def multi_hot(balls: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.array_contains(balls, k).cast("int"))


def cross_entropy(p: Column, target: Column) -> Column:
    """-ln of the probability at a place (0-based), floored at 1e-10."""
    return -F.ln(F.greatest(F.get(p, target), F.lit(1e-10)))


def binary_cross_entropy(p: Column, y: Column) -> Column:
    """Mean of -(y ln p + (1 - y) ln(1 - p)), each probability floored at 1e-10; null for empty arrays."""
    safe = lambda x: F.ln(F.greatest(x, F.lit(1e-10)))
    return mean(F.zip_with(p, y, lambda q, t: -(t * safe(q) + (1.0 - t) * safe(1.0 - q))))


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    whole = let(top, lambda m: m + F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - m))))
    return let(whole, lambda t: F.transform(v, lambda x: x - t))


def softmax_2d(m: Column) -> Column:
    return F.transform(m, softmax)


def tanh(v: Column) -> Column:
    return F.transform(v, F.tanh)


def elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of two arrays of one length; `add`, `sub`, `mul` and `div` are its cases."""
    return F.zip_with(a, b, op)


def add(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x * y)


def div(a: Column, b: Column) -> Column:
    """With 1e-8 added to the divisor."""
    return elementwise(a, b, lambda x, y: x / (y + 1e-8))


def scaled(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x * k)


def sqrt(v: Column) -> Column:
    """Of what is over 0; 0 elsewhere."""
    return F.transform(v, lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def std(v: Column) -> Column:
    return F.sqrt(variance(v))


def along(m: Column, axis: int, f: Callable[[Column], Column]) -> Column:
    """f (total, mean, variance, std) of the columns (axis 0) or rows (axis 1) of a matrix."""
    return F.transform(transpose(m) if axis == 0 else m, f)


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda k: F.transform(m, lambda row: F.get(row, k)))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def mat_mul(a: Column, b: Column) -> Column:
    return let(transpose(b), lambda columns: F.transform(a, lambda row: F.transform(columns, lambda c: dot(row, c))))


def shape(m: Column) -> Column:
    """Rows and columns of a matrix."""
    return F.array(F.size(m), F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0)))


def reshape(v: Column, rows: int, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.slice(v, k * columns + 1, F.lit(columns)))


def flatten(m: Column) -> Column:
    return F.flatten(m)


def one_hot(place: Column, n: int) -> Column:
    """place is 0-based."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == place).cast("int"))


def argsort(v: Column, descending: bool = False) -> Column:
    """Places (0-based) by value; equal values in the order they stand."""
    key = F.transform(v, lambda x, k: F.struct((-x if descending else x).alias("x"), k.alias("k")))
    return F.transform(F.array_sort(key), lambda s: s["k"])


def argmax(v: Column) -> Column:
    """The first place of the greatest value; null for an empty array."""
    return F.get(argsort(v, True), F.lit(0))


def dropout(v: Column, rate: float, *keys: Column, seed: int = 0) -> Column:
    """Each element is 0 with probability `rate`, else divided by 1 - rate. What falls is drawn from a hash
    of the keys, the place and the seed, so a repeated task drops the same."""
    def kept(x: Column, k: Column) -> Column:
        u = F.pmod(F.xxhash64(*keys, k, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        return F.when(u >= rate, x / (1.0 - rate) if rate < 1 else F.lit(0.0)).otherwise(0.0)

    return F.transform(v, kept)


# Initial values and the optimizer, on arrays of the driver


def he(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    return rng.normal(0, np.sqrt(2 / rows), (rows, columns))


def xavier(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    return rng.normal(0, np.sqrt(2 / (rows + columns)), (rows, columns))


def clip_gradients(g: Params, most: float) -> Params:
    """All gradients scaled alike so that their common norm is `most` at the most."""
    norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
    return {k: x * (most / norm) for k, x in g.items()} if norm > most else g


@dataclass
class AdamW:
    """Adam with decoupled weight decay; t counts steps of all parameters together."""

    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    decay: float = 0.01
    eps: float = 1e-8
    t: int = 0
    m: Params = field(default_factory=dict)
    v: Params = field(default_factory=dict)

    def step(self, p: Params, g: Params) -> Params:
        self.t += 1
        out = dict(p)
        for k, x in g.items():
            self.m[k] = self.beta1 * self.m.get(k, 0.0) + (1 - self.beta1) * x
            self.v[k] = self.beta2 * self.v.get(k, 0.0) + (1 - self.beta2) * x * x
            ahead = self.m[k] / (1 - self.beta1**self.t) / (np.sqrt(self.v[k] / (1 - self.beta2**self.t)) + self.eps)
            out[k] = p[k] * (1 - self.rate * self.decay) - self.rate * ahead
        return out


# The model

#: Parts that are no parameters.
FIXED = ("heads", "place")


def init(features: int, width: int = 32, heads: int = 2, length: int = 10, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    at, k = np.arange(length)[:, None], np.arange(width)[None, :]
    angle = at / 10000 ** (2 * (k // 2) / width)
    p = {"w_in": he(rng, features, width), "b_in": np.zeros(width), "place": np.where(k % 2 == 0, np.sin(angle), np.cos(angle)), "heads": np.array(heads)}
    p |= {w: he(rng, width, width) for w in "qkvo"}
    p |= {"gain1": np.ones(width), "shift1": np.zeros(width), "gain2": np.ones(width), "shift2": np.zeros(width)}
    p |= {"w_up": he(rng, width, 4 * width), "b_up": np.zeros(4 * width), "w_down": he(rng, 4 * width, width), "b_down": np.zeros(width)}
    return p | {"w_red": he(rng, width, REDS), "b_red": np.zeros(REDS), "w_blue": he(rng, width, BLUES), "b_blue": np.zeros(BLUES)}


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _norm(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows and what they were divided by, inverted."""
    s = 1 / np.sqrt(r.var(-1, keepdims=True) + EPS)
    return (r - r.mean(-1, keepdims=True)) * s, s


def _norm_back(g: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    return s * (g - g.mean(-1, keepdims=True) - n * (g * n).mean(-1, keepdims=True))


_C, _CUBE = np.sqrt(2 / np.pi), 0.044715


def _gelu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives."""
    square = z * z
    t = np.tanh(_C * z * (1 + _CUBE * square))
    half = 0.5 * (1 + t)
    return z * half, half + 0.5 * z * (1 - t * t) * _C * (1 + 3 * _CUBE * square)


def _times(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """a @ m of a stack of matrices, as one product: NumPy takes a product of each matrix otherwise."""
    return (a.reshape(-1, a.shape[-1]) @ m).reshape(*a.shape[:-1], m.shape[-1])


def forward(p: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """Probabilities of reds and blues for sequences x (rows, length, features), and what backward needs;
    `a` are the attention weights (rows, heads, length, length)."""
    n, t, _ = x.shape
    heads = int(p["heads"])
    h = _times(x, p["w_in"]) + p["b_in"] + p["place"][:t]
    d = h.shape[-1] // heads
    split = lambda a: a.reshape(n, t, heads, d).transpose(0, 2, 1, 3)
    q, k, v = (split(_times(h, p[w])) for w in "qkv")
    a = _soft(q @ k.transpose(0, 1, 3, 2) / np.sqrt(d))
    mixed = (a @ v).transpose(0, 2, 1, 3).reshape(n, t, -1)
    n1, s1 = _norm(h + _times(mixed, p["o"]))
    y1 = n1 * p["gain1"] + p["shift1"]
    up, slope = _gelu(_times(y1, p["w_up"]) + p["b_up"])
    n2, s2 = _norm(y1 + _times(up, p["w_down"]) + p["b_down"])
    pooled = (n2 * p["gain2"] + p["shift2"]).mean(1)
    red, blue = _soft(pooled @ p["w_red"] + p["b_red"]), _soft(pooled @ p["w_blue"] + p["b_blue"])
    return red, blue, {"h": h, "q": q, "k": k, "v": v, "a": a, "mixed": mixed, "n1": n1, "s1": s1, "y1": y1, "up": up, "slope": slope, "n2": n2, "s2": s2, "pooled": pooled}


def loss(red: np.ndarray, blue: np.ndarray, reds: np.ndarray, blues: np.ndarray) -> float:
    """-sum ln p over drawn reds - 0.01 sum ln(1 - p) over the others, and the blue's -ln p."""
    rows = np.arange(len(blues))
    return float((-(reds * np.log(np.maximum(red, 1e-10))).sum(1) - 0.01 * ((1 - reds) * np.log(np.maximum(1 - red, 1e-10))).sum(1) - np.log(np.maximum(blue[rows, blues], 1e-10))).sum())


def gradients(p: Params, x: np.ndarray, reds: np.ndarray, blues: np.ndarray) -> tuple[float, Params]:
    """Loss and gradients, summed over rows. reds: rows x 33 of 0 and 1; blues: 0-based."""
    red, blue, c = forward(p, x)
    n, t, _ = x.shape
    heads = int(p["heads"])
    d = c["h"].shape[-1] // heads
    g_p = -reds / np.maximum(red, 1e-10) + 0.01 * (1 - reds) / np.maximum(1 - red, 1e-10)
    z_red = red * (g_p - (g_p * red).sum(1, keepdims=True))
    z_blue = blue.copy()
    z_blue[np.arange(n), blues] -= 1
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g: Params = {"w_red": c["pooled"].T @ z_red, "b_red": z_red.sum(0), "w_blue": c["pooled"].T @ z_blue, "b_blue": z_blue.sum(0)}
    g_2 = np.repeat(((z_red @ p["w_red"].T + z_blue @ p["w_blue"].T) / t)[:, None, :], t, 1)
    g["gain2"], g["shift2"] = flat(g_2 * c["n2"]).sum(0), flat(g_2).sum(0)
    g_down = _norm_back(g_2 * p["gain2"], c["n2"], c["s2"])
    g["w_down"], g["b_down"] = flat(c["up"]).T @ flat(g_down), flat(g_down).sum(0)
    g_up = _times(g_down, p["w_down"].T) * c["slope"]
    g["w_up"], g["b_up"] = flat(c["y1"]).T @ flat(g_up), flat(g_up).sum(0)
    g_1 = g_down + _times(g_up, p["w_up"].T)
    g["gain1"], g["shift1"] = flat(g_1 * c["n1"]).sum(0), flat(g_1).sum(0)
    g_r = _norm_back(g_1 * p["gain1"], c["n1"], c["s1"])
    g["o"] = flat(c["mixed"]).T @ flat(g_r)
    g_m = _times(g_r, p["o"].T).reshape(n, t, heads, d).transpose(0, 2, 1, 3)
    g_a, g_v = g_m @ c["v"].transpose(0, 1, 3, 2), c["a"].transpose(0, 1, 3, 2) @ g_m
    g_s = c["a"] * (g_a - (g_a * c["a"]).sum(-1, keepdims=True)) / np.sqrt(d)
    joined = lambda a: a.transpose(0, 2, 1, 3).reshape(n, t, -1)
    parts = {"q": joined(g_s @ c["k"]), "k": joined(g_s.transpose(0, 1, 3, 2) @ c["q"]), "v": joined(g_v)}
    g_h = g_r.copy()
    for w, part in parts.items():
        g[w] = flat(c["h"]).T @ flat(part)
        g_h += _times(part, p[w].T)
    g["w_in"], g["b_in"] = flat(x).T @ flat(g_h), flat(g_h).sum(0)
    return loss(red, blue, reds, blues), g


def sequences(d: DataFrame, features: list[Column], length: int = 10) -> DataFrame:
    """(idx, x array<array<double>>, reds, blue): features of the `length` draws before each one."""
    from .sequence import haloed, own_rows, past

    vector = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in features])
    h, size = haloed(d.select("idx", "reds", "blue", vector.alias("f")), length)
    return own_rows(h.select("idx", "block", F.collect_list("f").over(past(length)).alias("x"), "reds", "blue"), size).where(F.size("x") == length)


def stacked(x: pd.Series) -> np.ndarray:
    """Sequences of one length as one array (rows, length, features)."""
    flat = np.array([r for rows in x for r in rows], float)
    return flat.reshape(len(x), -1, flat.shape[-1]) if len(x) else np.zeros((0, 0, 0))


def arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = stacked(part["x"])
    reds = np.zeros((len(part), REDS))
    for k, own in enumerate(part["reds"]):
        reds[k, np.array(own) - 1] = 1
    return x, reds, part["blue"].to_numpy() - 1


#: Rows of gradients that come to the driver in a pass; those of all partitions are added up to so many
#: by tasks.
SUMS = 16


def _gradient(rows: DataFrame, p: Params, names: list[str]) -> tuple[float, int, Params]:
    """Loss, rows and gradients over all rows: each partition sums its own, SUMS tasks add these up."""
    shared = rows.sparkSession.sparkContext.broadcast(p)

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, count, sums = 0.0, 0, None
        for part in parts:
            for a in range(0, len(part), 512):
                one, g = gradients(shared.value, *arrays(part.iloc[a : a + 512]))
                whole, count = whole + one, count + min(512, len(part) - a)
                sums = g if sums is None else {k: sums[k] + g[k] for k in g}
        if count:
            yield pd.DataFrame({"loss": [whole], "n": [count], "g": [np.concatenate([sums[k].ravel() for k in names]).tobytes()]})

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, count, sums = 0.0, 0, None
        for part in parts:
            for one, n, g in zip(part["loss"], part["n"], part["g"]):
                whole, count = whole + one, count + n
                sums = np.frombuffer(g).copy() if sums is None else sums + np.frombuffer(g)
        if count:
            yield pd.DataFrame({"loss": [whole], "n": [count], "g": [sums.tobytes()]})

    schema = "loss double, n long, g binary"
    got = rows.select("x", "reds", "blue").mapInPandas(own, schema).repartition(SUMS).mapInPandas(added, schema).collect()
    flat = sum((np.frombuffer(r["g"]) for r in got), np.zeros(sum(p[k].size for k in names)))
    ends = np.cumsum([p[k].size for k in names])[:-1]
    return sum(r["loss"] for r in got), sum(r["n"] for r in got), {k: g.reshape(p[k].shape) for k, g in zip(names, np.split(flat, ends))}


def train(rows: DataFrame, p: Params, epochs: int = 5, rate: float = 0.01, decay: float = 0.01, clip: float = 5.0) -> tuple[Params, list[float]]:
    """AdamW with a falling rate over passes. The best parameters by mean loss are kept; it stops once two
    passes gain less than 0.001."""
    p = {k: v.copy() for k, v in p.items()}
    names = [k for k in p if k not in FIXED]
    adam = AdamW(decay=decay)
    losses, best, least, idle = [], p, np.inf, 0
    for t in range(epochs):
        whole, n, g = _gradient(rows, p, names)
        n = max(1, n)
        losses.append(whole / n)
        idle = 0 if losses[-1] < least - 1e-3 else idle + 1
        if losses[-1] < least:
            least, best = losses[-1], p
        if idle >= 2:
            break
        adam.rate = rate * 0.5 * (1 + np.cos(np.pi * t / epochs))
        p = adam.step(p, clip_gradients({k: x / n for k, x in g.items()}, clip))
    return best, losses


def predict(rows: DataFrame, p: Params) -> DataFrame:
    """(idx, red_p array<double>, blue_p array<double>, reds, blue, attention array<array<double>>):
    probabilities, the best balls, and the weights of attention, averaged over the heads."""
    shared = rows.sparkSession.sparkContext.broadcast(p)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            red, blue, c = forward(shared.value, stacked(part["x"]))
            top = np.sort(np.argsort(-red, axis=1, kind="stable")[:, :6] + 1, axis=1)
            yield pd.DataFrame({"idx": part["idx"], "red_p": list(red), "blue_p": list(blue), "reds": list(top.astype(np.int32)), "blue": (blue.argmax(1) + 1).astype(np.int32), "attention": [list(w) for w in c["a"].mean(1)]})

    return rows.select("idx", "x").mapInPandas(work, "idx long, red_p array<double>, blue_p array<double>, reds array<int>, blue int, attention array<array<double>>")


def evaluate(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(n, red_rate, blue_rate, share_3, avg_hits) of predictions joined with draws; zeros for none."""
    a = actual.select("idx", F.col("reds").alias("drawn"), F.col("blue").alias("blue_drawn"))
    j = predicted.join(a, "idx").select(F.size(F.array_intersect("reds", "drawn")).alias("h"), (F.col("blue") == F.col("blue_drawn")).cast("int").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.agg(F.count("*").alias("n"), zero(F.avg("h") / 6).alias("red_rate"), zero(F.avg("b")).alias("blue_rate"), zero(F.avg((F.col("h") >= 3).cast("double"))).alias("share_3"), zero(F.avg("h")).alias("avg_hits"))


def noisy(predicted: DataFrame, runs: int = 30, scale: float = 0.1, seed: int = 0) -> DataFrame:
    """(idx, colour, ball, mean, std, entropy): probabilities under multiplicative Gaussian noise, clipped
    to [0, 1] and made to sum to 1 in each run; entropy is that of the means of a colour."""
    both = F.array(F.struct(F.lit("red").alias("colour"), F.col("red_p").alias("p")), F.struct(F.lit("blue").alias("colour"), F.col("blue_p").alias("p")))
    each = predicted.select("idx", F.explode(both).alias("c")).select("idx", "c.colour", F.posexplode("c.p").alias("at", "p")).select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    u1, u2 = ((F.pmod(F.xxhash64("idx", "colour", "run", "at", F.lit(seed + k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1) for k in range(2))
    normal = F.sqrt(F.ln(u1) * -2.0) * F.cos(u2 * (2 * np.pi))
    w = Window.partitionBy("idx", "colour", "run")
    p = F.least(F.greatest(F.col("p") * (normal * scale + 1.0), F.lit(0.0)), F.lit(1.0))
    made = each.withColumn("p", p).withColumn("p", F.try_divide("p", F.sum("p").over(w)))
    out = made.groupBy("idx", "colour", (F.col("at") + 1).alias("ball")).agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))
    return out.withColumn("entropy", -F.sum(F.col("mean") * F.ln(F.greatest(F.col("mean"), F.lit(1e-10)))).over(Window.partitionBy("idx", "colour")))


def save(p: Params, spark, path: str) -> None:
    spark.createDataFrame([(k, list(map(int, v.shape)), [float(x) for x in v.ravel()]) for k, v in p.items()], "name string, shape array<int>, cells array<double>").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Params:
    return {r["name"]: np.array(r["cells"]).reshape(r["shape"]) if r["name"] != "heads" else np.array(int(r["cells"][0])) for r in spark.read.parquet(path).collect()}
