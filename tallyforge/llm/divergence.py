"""Divergence of the sources of a language: how far apart their smoothed shares of the language's terms are.

A term is a run of letters (A-Z in lower case) or of other than ASCII; a language keeps the terms that
enough of its documents hold. Counts become whole numbers, PARTS of a whole and one more, so all sums are
exact. With V kept terms, of which a source has N occurrences in all, a term of c has the share
p = 1 + floor(PARTS (c + PRIOR) / (N + PRIOR V)).

1. Each task adds up terms by language and source while it reads, and sends one row for each (of what it
   holds at once). Spark adds those up, and every kept term becomes a sparse vector of (source, count).
2. Terms of one vector have the same shares in every source, so each distinct vector stands for all of
   them, with their number. Distinct vectors are dealt in chunks; a chunk looks at every pair of sources
   once for each vector, in numpy, and sends one sum for each pair.
3. The terms themselves are ranked by how far their share in a source is above that in the language.

Sources of a language travel to its chunks as one row; what is written holds a row for each pair of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written
from .texts import slices

#: Documents of a language that hold a kept term, at least.
LEAST_DOCUMENTS = 30
PARTS, PRIOR = 1_000_000_000, 5
#: Terms reported for each source.
TOP = 50
#: Terms that a task adds up before it sends them, and bytes of a text that are cut into terms at once.
HELD, CUT = 300_000, 4_000_000
#: Entries of vectors in a chunk, and vectors and sources that are compared at once.
ENTRIES, ROWS, SOURCES = 500_000, 2_048, 128

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some megabytes of it at a time."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        to = text.find(b" ", at + CUT)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = {}
    documents: dict[tuple[str, str], Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            within = documents[lang, source]
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([within[t] for t in found], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            # A row without a term says that the source is there, whether it has terms or not.
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        documents.clear()

    held = 0
    for batch in batches:
        for a, b in slices(batch.column(0)):
            part = batch.slice(a, b - a)
            for text, lang, source in zip(*(part.column(k).to_pylist() for k in range(3))):
                found = counts.setdefault((lang, source), Counter())
                within = documents.setdefault((lang, source), Counter())
                own: set[bytes] = set()
                held -= len(found)
                for terms in _terms(text):
                    found.update(terms)
                    own.update(terms)
                within.update(own)
                held += len(found)
                if held >= HELD:
                    yield from sent()
                    held = 0
    yield from sent()


def vectors(df: DataFrame, least: int = LEAST_DOCUMENTS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, vector): the kept terms with the sources that have them, by name, and their counts.
    The row of a null term has all sources of the language, with counts of 0."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    rows = df.select(*named).withColumn("text", F.encode("text", "UTF-8")).mapInArrow(_added_up, "lang string, source string, term string, n long, docs long")
    sums = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.where(F.col("term").isNull() | (F.col("docs") >= least)).select("lang", "term", "vector")


def shares(counts: np.ndarray, wholes: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS (count + PRIOR) / whole), exactly, for counts + PRIOR up to their whole."""
    if wholes.size and wholes.max() > (1 << 63) // 1000:
        counts, wholes = counts.astype(object), wholes.astype(object)
    rest, found = counts + PRIOR, 0
    for _ in range(3):  # PARTS is the third power of 1000: long division, three digits at a time
        rest = rest * 1000
        found = found * 1000 + rest // wholes
        rest = rest % wholes
    return found + 1


def _share(count: str, whole: Column) -> Column:
    scaled = (F.col(count) + PRIOR).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.call_function("div", scaled, whole.cast("decimal(20,0)")) + 1


def pair_sums(offsets: np.ndarray, at: np.ndarray, counts: np.ndarray, copies: np.ndarray, wholes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of pairs of sources (i < j): i, j and the sum over vectors of copies |p_i - p_j|.
    Vector k has counts[offsets[k]:offsets[k + 1]] in the sources `at`."""
    n = len(wholes)
    row = np.repeat(np.arange(len(copies)), np.diff(offsets))
    blocks = [(a, min(a + SOURCES, n)) for a in range(0, n, SOURCES)]
    for (a, b), (c, d) in combinations_with_replacement(blocks, 2):
        sums = np.zeros((b - a, d - c), np.int64)
        for first in range(0, len(copies), ROWS):
            last = min(first + ROWS, len(copies))
            own = slice(offsets[first], offsets[last])
            sides = []
            for lo, hi in ((a, b), (c, d)):
                dense = np.zeros((last - first, hi - lo), np.int64)
                within = (at[own] >= lo) & (at[own] < hi)
                dense[row[own][within] - first, at[own][within] - lo] = counts[own][within]
                sides.append(shares(dense, wholes[None, lo:hi]))
            for i in range(b - a):
                sums[i] += copies[first:last] @ np.abs(sides[0][:, i : i + 1] - sides[1]).astype(np.int64)
        i, j = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
        later = i < j
        yield i[later], j[later], sums[later]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            lang, terms, sources, chunk = (batch.column(c)[k] for c in range(4))
            names, totals = sources.values.flatten()
            vector, copies = chunk.values.flatten() if chunk.is_valid else (pa.array([], batch.column(3).type.value_type[0].type), pa.array([], pa.int64()))
            place, counts = vector.flatten().flatten()
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(vector).to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = pc.index_in(place, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            wholes = totals.to_numpy(zero_copy_only=False) + PRIOR * terms.as_py()
            for i, j, sums in pair_sums(offsets, at, counts.to_numpy(zero_copy_only=False), copies.to_numpy(zero_copy_only=False), wholes):
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(sums)], names=["lang", "a", "b", "value"])


def audit(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, under `pair` the summed
    distance of shares to each other source, and under `term` the `top` kept terms whose share is most
    above the language's.

    Null texts, languages and sources are empty ones. A source without terms has pairs all the same;
    where a language keeps no term they are all 0, and a language of one source has no pairs. Ties go by
    the bytes of the item. Repeated rows are documents each. An empty table has no rows. Columns but the
    three named are not read. The tables on the way are deleted; the result is a written table.
    """
    with scratch(df.sparkSession, "divergence"):
        found = written(vectors(df, least, text_col, lang_col, source_col), "vectors")
        return written(_audited(found, top), "divergence", keep=True)


def _audited(found: DataFrame, top: int) -> DataFrame:
    terms = found.where("term IS NOT NULL")
    totals = written(found.select("lang", F.explode("vector").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total")), "totals")
    sizes = found.groupBy("lang").agg(F.count("term").alias("terms"), F.sum(F.size("vector")).alias("entries"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("total"), F.array_sort(F.collect_list(F.struct("source", F.col("total")))).alias("sources"))
    langs = written(langs.join(sizes, "lang"), "langs")

    # Grouped by the vector itself, so that what stands for terms of equal counts is exact.
    distinct = terms.groupBy("lang", "vector").agg(F.count("*").alias("copies"))
    chunk = F.pmod(F.xxhash64("vector"), F.ceil(F.col("entries") / ENTRIES))
    chunks = distinct.join(langs.select("lang", "entries"), "lang").groupBy("lang", chunk.alias("chunk")).agg(F.collect_list(F.struct("vector", "copies")).alias("chunk_vectors"))
    each = langs.join(chunks, "lang", "left").select("lang", "terms", "sources", "chunk_vectors").mapInArrow(_compared, "lang string, a string, b string, value long")
    pairs = each.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", sides.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    all_n = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    entry = terms.select("lang", F.col("term").alias("item"), all_n.alias("all_n"), F.explode("vector").alias("x")).select("lang", "item", "all_n", "x.source", "x.n")
    entry = entry.join(totals, ["lang", "source"]).join(langs.select("lang", "terms", F.col("total").alias("lang_total")), "lang")
    above = _share("n", F.col("total") + PRIOR * F.col("terms")) - _share("all_n", F.col("lang_total") + PRIOR * F.col("terms"))
    above = entry.select("lang", "source", F.lit("term").alias("part"), "item", above.cast("long").alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top))


UPPER = "".join(map(chr, range(65, 91)))
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM docs),
kept AS (SELECT lang, item FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
groups_ AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, item, count(*) AS n FROM words JOIN kept USING (lang, item) GROUP BY ALL),
dense AS (
  SELECT lang, source, item, coalesce(n, 0)::HUGEINT AS n FROM groups_ JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, item)),
shares AS (
  SELECT *, 1 + ({PARTS} * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang, source) + {PRIOR} * count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
whole AS (SELECT lang, item, sum(n) AS n FROM dense GROUP BY ALL),
whole_shares AS (
  SELECT lang, item, 1 + ({PARTS} * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang) + {PRIOR} * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shares a JOIN shares b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', item, (p - q)::BIGINT FROM shares JOIN whole_shares USING (lang, item) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
