"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text, in which all that is no letter is one
space, fall into DIM hashed features (fewer for very many languages, so that the table of weights keeps
its bound). A feature's value is its share of the text's n-grams times its
inverse document frequency, so a class's score is a mean over the n-grams of the whole text. Document
frequencies are counted over all training documents; the weights are fitted by follow-the-regularised-
leader with an elastic-net penalty on a bounded sample of them, and a temperature, fitted on sampled
documents that the weights have not seen, makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import map_texts, slices, small_batches

DIM = 1 << 15
ORDERS = 3
#: Bounds of the fitting sample, which comes to the driver: documents of each language, the least by a hash
#: of id and text; characters taken of each, from a hashed place on; and bytes of all of them (an n-gram
#: takes six), so that many languages get fewer documents each.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARACTERS, SAMPLE_BYTES = 600, 2_000, 128 << 20
#: Weights of the table: features times languages.
WEIGHTS = 1 << 25
WORK = 400_000  # bytes of text whose n-grams are made at once
SHORT = 60  # characters of the stretch of each sampled text that is fitted beside the whole
UNDETERMINED = "und"
SCALE = 100.0

_SPREAD = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_letter = np.full(0x110000, -1, np.int8)


def _letters(codes: np.ndarray) -> np.ndarray:
    known = _letter[codes]
    if (known < 0).any():
        for c in np.unique(codes[known < 0]):
            _letter[c] = chr(c).isalpha()
        known = _letter[codes]
    return known.astype(bool)


def features_for(languages: int) -> int:
    """Hashed features that leave the table of so many languages within its bound."""
    return max(64, min(DIM, 1 << max(1, WEIGHTS // max(1, languages)).bit_length() - 1))


def grams(texts: list[str | None], dim: int = DIM) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(features of each place by order, first place of each text, places of each text).

    The first two places of a text stand before it; they have the feature `dim`, which weighs nothing.
    """
    low = ["  " + (t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0] + [len(t) for t in low[:-1]])
    codes = np.where(_letters(codes), codes, np.uint32(0))
    front = np.zeros(len(codes), bool)
    front[begins] = front[begins + 1] = True
    kept = (codes != 0) | front
    kept[1:] |= codes[:-1] != 0
    at = np.cumsum(kept)
    begins = at[begins] - 1
    codes, front = codes[kept], front[kept]
    out, mixed = [], np.zeros(len(codes), np.uint32)
    for k in range(ORDERS):
        mixed[k:] += codes[: len(codes) - k] * _SPREAD[k]
        h = mixed + np.uint32(k * 97 + 1)
        h = (h ^ h >> np.uint32(15)) * np.uint32(739982445)
        own = (h >> np.uint32(17)).astype(np.int32) & (dim - 1)
        own[front] = dim
        out.append(own)
    places = np.diff(np.append(begins, len(codes))) - 2
    return out, begins, places


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # a row a feature and one more, times the inverse document frequency; a column a language
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its calibrated probability; `und` and 0 for null or without a letter."""
        if not texts:
            return [], []
        features, begins, places = grams(texts, len(self.weights) - 1)
        sums = self.weights[features[0]]
        for f in features[1:]:
            sums += self.weights[f]
        logits = np.add.reduceat(sums, begins, axis=0, dtype=np.float64) / np.maximum(places * ORDERS, 1)[:, None] + self.bias
        p = _softmax(logits / self.temperature)
        best = p.argmax(1)
        real = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if r else UNDETERMINED for b, r in zip(best, real)], [float(p[k, b]) if r else 0.0 for k, (b, r) in enumerate(zip(best, real))]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _counts(features: list[np.ndarray], begins: np.ndarray, k: int, dim: int) -> np.ndarray:
    end = begins[k + 1] if k + 1 < len(begins) else None
    return sum(np.bincount(f[begins[k] : end], minlength=dim + 1) for f in features)[:dim]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> LanguageModel | None:
    """A model of all languages of df's rows with text and language; None if there are none.

    Statistics cover every row; `sample` bounds what is fitted. Null and repeated ids are drawn like any
    other, by their text.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # A row a language, of which the model has a column each.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    dim = features_for(len(languages))
    sample = min(sample, max(1, SAMPLE_BYTES // (len(languages) * 6 * min(dim, ORDERS * SAMPLE_CHARACTERS))))

    def frequencies(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(dim, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0), WORK):
                features, begins, _ = grams(batch.column(0).slice(a, b - a).to_pylist(), dim)
                ends = [*begins[1:], len(features[0])]
                for begin, end in zip(begins, ends):
                    seen = np.zeros(dim + 1, bool)
                    for f in features:
                        seen[f[begin:end]] = True
                    total += seen[:dim]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["feature", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n_rows = sum(sizes.values())
    frequency = np.zeros(dim)
    for r in counted:
        frequency[r["feature"]] = r["n"]
    idf = np.log((1 + n_rows) / (1 + frequency)) + 1

    # A bound on the hash, four times as wide as it need be, leaves tasks few rows to order; the order is
    # cut in the tasks first, so repeated rows, which share a hash, send no more than others.
    key = F.col("id").cast("string")
    draw = F.pmod(F.xxhash64(key, "text", F.lit("language sample")), F.lit(1 << 30))
    # A row a language, from the driver itself: broadcast, so that no text is dealt by language.
    shares = df.sparkSession.createDataFrame([(name, min(1.0, 4 * sample / n)) for name, n in sizes.items()], "lang string, share double")
    chosen = rows.withColumn("draw", draw).join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("share") * F.lit(float(1 << 30)))
    place = F.pmod(F.xxhash64("text", key), F.greatest(F.char_length("text") - SAMPLE_CHARACTERS, F.lit(0)) + 1)
    chosen = chosen.select("draw", "lang", F.substr("text", (place + 1).cast("int"), F.lit(SAMPLE_CHARACTERS)).alias("text"))
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("rank") <= sample)

    def vectors(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            draws, langs, texts = (batch.column(k).to_pylist() for k in range(3))
            out = []
            draws, langs = ([x for x in xs for _ in range(2)] for xs in (draws, langs))
            for t in (x for t in texts for x in (t, t[len(t) // 3 :][:SHORT])):
                features, begins, places = grams([t], dim)
                n = _counts(features, begins, 0, dim)
                at = np.flatnonzero(n)
                out.append((at.astype(np.uint16).tobytes(), (n[at] / max(1, places[0] * ORDERS)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), pa.array(langs), pa.array([a for a, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary())], names=["draw", "lang", "at", "value"])

    got = sorted(chosen.select("draw", "lang", "text").mapInArrow(vectors, "draw long, lang string, at binary, value binary").collect(), key=lambda r: (r["draw"], r["lang"], bytes(r["at"]), bytes(r["value"])))
    column, fit, held = {name: k for k, name in enumerate(languages)}, [], []
    for r in got:
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        x = np.frombuffer(r["value"], np.float32).astype(np.float64) * idf[at] * SCALE
        (held if r["draw"] % 4 == 0 else fit).append((at, x, column[r["lang"]]))
    weights, bias = _ftrl(fit, dim, len(languages), epochs, alpha, beta, l1, l2)
    held = held or fit
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    temperature = _temperature(logits, np.array([y for _, _, y in held], np.int64))
    table = np.zeros((dim + 1, len(languages)), np.float32)
    table[:dim] = weights * idf[:, None] * SCALE
    return LanguageModel(languages, table, bias, temperature)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after passes over the rows in an order seeded by the pass."""
    z, n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))

    def weights(at) -> np.ndarray:
        own, seen = z[at], n[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(seen)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, dim), np.append(x, 1.0)  # the last row is the bias
            w = weights(at)
            error = _softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            seen = n[at]
            z[at] += g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / alpha * w
            n[at] = seen + g * g
    w = weights(slice(None))
    return w[:dim], w[dim]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0

    def loss(u: float) -> float:
        return float(-np.log(_softmax(logits / np.exp(u))[np.arange(len(y)), y] + 1e-12).mean()) + 1e-4 * u * u

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) of every whole text; `und` and 0 for null, for texts without a
    letter and where no model could be trained. Rows stay rows, an empty table is empty, and no
    column but id and text is looked at."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(slices) -> Iterator[dict]:
        m = shared.value
        for _, texts in slices:
            langs, scores = m.predict(texts) if m else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield {"lang_pred": langs, "score": scores}

    return map_texts(df, id_col, text_col, "lang_pred string, score double", work, keep, WORK)


def held_out(id_col: str) -> Column:
    """Documents whose crc32 of the id as text leaves 2 modulo 4 take no part in training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Trains on df's documents that are not held out and predicts them all: (id, *keep, held_out,
    lang_pred, score). A null id is not held out."""
    with small_batches(df.sparkSession):
        model = train(df.where(~F.coalesce(held_out(id_col), F.lit(False))), id_col, text_col, lang_col)
    out = predict(df, model, id_col, text_col, keep)
    return out.select(id_col, *keep, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
