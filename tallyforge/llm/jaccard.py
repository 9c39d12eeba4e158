"""N-gram Jaccard join by PartEnum signatures: links of similar texts, as components.

1. Every text becomes a set of word shingles (`shingles`). Equal sets are one node.
2. Each node's set gets PartEnum signatures. Nodes of one signature form a bucket; buckets of one node
   are dropped where they are met. A task brings its signatures together a chunk at a time and sends
   one row for each bucket of a chunk; the other rows of such a bucket are known to be shared and are
   dealt by node. So a bucket that holds a third of all nodes still sends few rows to one task.
3. Each node is first compared with one other of its buckets: the one that shares most buckets with
   any. Of a text and its edited copies that is the text itself, so a group, however large, is settled
   with a comparison a node. ROUNDS such rounds follow one another, over what is still open.
4. Links join nodes to components. Only nodes of one bucket but different components can hold links
   that matter still. Their join tests, before it gives out a pair, the sizes and a parity of SKETCH
   bits, whose differences bound from below in how many elements two sets differ: edited copies of one
   text that are too far apart meet in many buckets, but give no rows. Buckets of more than DEALT
   nodes are dealt to several tasks by salt.
5. A comparison then looks at longer sketches, of an eighth of a text or less, then at the two sets of
   hashes, and a link counts only if the words of the two whole texts themselves confirm it. No cap
   applies anywhere: a pair of similar texts is compared or lies in one component already.

Shingles are 64-bit hashes of keyed word hashes and equal sets are told by 127 bits, so n_shingles and
the equality of nodes rest on hashes of random bits; links between different sets do not.
Links within groups are not listed, but no component misses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import removed, scratch, written
from .shingles import forget, least_difference, parity_sketch, set_hash, shingle_sets, signatures, similar, similar_texts
from .texts import released, slices, small_batches

#: Bits of the parity that the join of a bucket's nodes tests, in 64-bit words.
SKETCH = 1024
#: Rounds in which a node is compared with one other.
ROUNDS = 2
#: Open nodes of a bucket that one task joins with the bucket's others.
DEALT = 2_000
#: Bytes of text whose shingles are made at once; some forty bytes of memory go with each.
WORK = 600_000
#: Sets that a task remembers in order not to repeat their sketches and signatures.
REMEMBERED = 300_000
#: Signatures that a task brings together before it sends them; some hundred bytes of memory go
#: with each.
CHUNK = 250_000


def _sets(batch_texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    if pa.types.is_large_string(batch_texts.type):
        batch_texts = batch_texts.cast(pa.string())
    for a, b in slices(batch_texts, WORK):
        yield a, b, shingle_sets(batch_texts.slice(a, b - a), size)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


NOTHING = np.zeros(0, np.uint64)


def _parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(20) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _idle() -> None:
    forget()
    released()


class _Met:
    """Sets that a task has met in rows with an id, by their 127 bits."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def first(self, halves: tuple[int, int]) -> bool:
        key = halves[0] << 64 | halves[1] & (1 << 64) - 1
        if key in self.seen:
            return False
        if len(self.seen) < REMEMBERED:
            self.seen.add(key)
        return True


def _described(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, node, check, sketch, parity): node and check are 127 bits of the set, 0 if empty;
    the sketches are there where the task meets a set first in a row with an id."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in rows:
            for a, b, sets in _sets(batch.column(1), size):
                ids = batch.column(0).slice(a, b - a)
                hashes = [set_hash(s) if len(s) else (0, 0) for s in sets]
                fresh = [known and len(s) > 0 and met.first(h) for s, h, known in zip(sets, hashes, ids.is_valid().to_pylist())]
                columns = [ids, pa.array([len(s) for s in sets], pa.int64()), *[pa.array([h[k] for h in hashes], pa.int64()) for k in range(2)]]
                columns += [pa.array([parity_sketch(s) if own else None for s, own in zip(sets, fresh)], pa.binary()), _lists([_parity(s) if own else NOTHING for s, own in zip(sets, fresh)])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "node", "check", "sketch", "parity"])
        _idle()

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T.StructType.fromDDL("n_shingles long, node long, check long, sketch binary, parity array<long>")])
    return docs.mapInArrow(work, schema)


def _dealt(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(value, key) of all signatures of texts with an id: bucket and node. Of the nodes that a chunk finds
    in one bucket, which is therefore known to be shared, each has a row of node + 1 and bucket instead,
    and one row more of bucket and node stands for them all. Buckets and nodes are even, so the two kinds
    of row are told apart without a column more, and no key has more than a row a chunk or a signature."""

    def chunk(buckets: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        bucket, node = np.concatenate(buckets).view(np.int64), np.concatenate(nodes)
        order = np.lexsort((node, bucket))
        bucket, node = bucket[order], node[order]
        fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))
        bucket, node, order = bucket[fresh], node[fresh], order[fresh]
        begins = np.append(True, bucket[1:] != bucket[:-1])
        many = np.diff(np.append(np.flatnonzero(begins), len(bucket)))
        sure = np.repeat(many > 1, many)
        stand = begins & sure
        key, value = np.where(sure, node + 1, bucket), np.where(sure, bucket, node)
        # A node's rows follow one another, so that the shuffle's compression finds it again and again.
        order = np.argsort(order)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([value[order], node[stand]])), pa.array(np.concatenate([key[order], bucket[stand]]))], names=["value", "key"])

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        buckets: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0
        for batch in rows:
            for _, _, sets in _sets(batch.column(0), size):
                for s in sets:
                    if len(s) and met.first(h := set_hash(s)) and len(own := signatures(s, percent)):
                        buckets.append(own)
                        nodes.append(np.full(len(own), h[0], np.int64))
                        held += len(own)
                if held >= CHUNK:
                    yield chunk(buckets, nodes)
                    buckets, nodes, held = [], [], 0
        if held:
            yield chunk(buckets, nodes)
        _idle()

    return docs.where(F.col("id").isNotNull()).select("text").mapInArrow(work, "value long, key long")


def _shared(dealt: DataFrame) -> DataFrame:
    """(bucket, node, component) of buckets that hold more than one node."""
    ends = (F.expr(f"{f}(value) OVER (PARTITION BY key)").alias(n) for f, n in (("min", "lo"), ("max", "hi")))
    sure = F.col("key").bitwiseAND(F.lit(1)) == 1
    rows = dealt.select("value", "key", *ends).where(sure | (F.col("lo") != F.col("hi")))
    node = F.when(sure, F.col("key") - 1).otherwise(F.col("value"))
    return rows.select(F.when(sure, F.col("value")).otherwise(F.col("key")).alias("bucket"), node.alias("node"), node.alias("component"))


def _compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, the links, exactly: by the words of the two whole texts."""
    names = ["a", "b", "check_a", "check_b", "id_a", "id_b"]
    ends = [nodes.select(F.col("node").alias(s), F.col("check").alias(f"check_{s}"), F.col("id").alias(f"id_{s}"), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab"]
    few = pairs.join(ends[0], "a").join(ends[1], "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def possible(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            most = ((batch["n_a"].to_numpy() + batch["n_b"].to_numpy()) * (100 - percent) // (100 + percent)).tolist()
            sketches = zip(batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist())
            kept = [k for k, (x, y) in enumerate(sketches) if least_difference(x, y) <= most[k]]
            yield batch.select(names).take(pa.array(kept, pa.int64()))

    few = few.select(*names, "n_a", "n_b", "sketch_a", "sketch_b")
    few = written(few.mapInArrow(possible, few.select(*names).schema), "pairs")
    # Written, the ids have a known size: Spark broadcasts them below its threshold and else shuffles.
    ids = written(few.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "ids")
    texts = docs.join(ids, "id", "left_semi")
    for s in "ab":
        few = few.join(texts.select(F.col("id").alias(f"id_{s}"), F.col("text").alias(f"text_{s}")), f"id_{s}")

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            a, b, check_a, check_b = (batch.column(k).to_pylist() for k in range(4))
            right = _sets(batch.column(5), size)
            found: list[int] = []
            at, to, held = 0, 0, []
            for x, y, sets in _sets(batch.column(4), size):
                for k in range(x, y):
                    if k >= to:
                        at, to, held = next(right)
                    s, t = sets[k - x], held[k - at]
                    # Two rows of one id with different texts: only the texts that were meant count.
                    if similar(s, t, percent) and set_hash(s) == (a[k], check_a[k]) and set_hash(t) == (b[k], check_b[k]) and similar_texts(batch.column(4)[k].as_py(), batch.column(5)[k].as_py(), size, percent):
                        found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in found], pa.int64()), pa.array([b[k] for k in found], pa.int64())], names=["a", "b"])
        _idle()

    made = few.select("a", "b", "check_a", "check_b", "text_a", "text_b").mapInArrow(work, "a long, b long")
    return written(made, "links")


def _unsettled(buckets: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component, with the number of nodes of the bucket."""
    sizes = buckets.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
    return buckets.join(sizes, "bucket")


def _with_leader(buckets: DataFrame) -> DataFrame:
    """Pairs (a < b): each node and one of another component, the leader of one of its buckets. A
    bucket's leader is its node in most buckets; of several leaders a node takes the one in most."""
    counts = buckets.groupBy("node").agg(F.count("*").alias("shared"))
    ranked = buckets.select("bucket", "node", "component").join(counts, "node").withColumn("rank", F.struct("shared", "node", "component"))
    leaders = ranked.groupBy("bucket").agg(F.max("rank").alias("leader"))
    met = ranked.join(leaders, "bucket").where(F.col("component") != F.col("leader.component"))
    best = met.groupBy("node").agg(F.max("leader").alias("leader"))
    return best.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def _open_pairs(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of nodes of one bucket and different components that may be similar by their sizes
    and parities. A bucket of n nodes has n / DEALT salts: every node meets those of each salt."""
    words = range(SKETCH // 64)
    own = nodes.select("node", F.col("n_shingles").cast("int").alias("size"), *[F.coalesce(F.get("parity", F.lit(k)), F.lit(0)).alias(f"w{k}") for k in words])
    salts = F.ceil(F.col("n") / DEALT).cast("int")
    rows = buckets.select("bucket", "node", "component", salts.alias("salts")).join(own, "node")
    rows = rows.withColumns({"own_salt": F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"), "salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1))}).repartition("bucket", "salt")
    names = ("node", "component", "size", *[f"w{k}" for k in words])
    x, y = (r.select("bucket", "salt", *[F.col(c).alias(f"{c}_{s}") for c in names]) for s, r in (("a", rows.where("salt = own_salt")), ("b", rows)))
    differ = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in words), F.lit(0))
    total = F.col("size_a") + F.col("size_b")
    close = (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent) & (differ * (100 + percent) <= total * (100 - percent))
    met = x.join(y, (x["bucket"] == y["bucket"]) & (x["salt"] == y["salt"]) & (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & close)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def join(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: shingles of `size` words, links at a Jaccard
    similarity of percent/100 or more, and the least id that can be reached by links.

    Null texts and texts without words have no shingles and are their own component. Rows of one id
    are one document for links; a row with a null id has no part in them and a null component. An
    empty table is empty; columns but the two named are not read. Texts may be of any length; a text is
    one value of its row. The tables on the way are deleted; the result is a written table.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(df.sparkSession, "jaccard"), small_batches(df.sparkSession):
        found = _joined(docs, size, percent)
        return written(found.select(F.col("id").alias(id_col), "n_shingles", "component_id"), "components", keep=True)


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    rows = written(_described(docs, size), "sets")
    docs = docs.where(F.col("id").isNotNull())
    nodes = written(rows.where("n_shingles > 0 AND id IS NOT NULL").groupBy("node", "check").agg(F.min("id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"), F.max("parity").alias("parity")), "nodes")

    open_ = written(_shared(_dealt(docs, size, percent)), "buckets")
    links = tried = None
    for _ in range(ROUNDS):
        first = _with_leader(open_)
        first = written(first if tried is None else first.join(tried, ["a", "b"], "left_anti"), "first")
        found = _compared(first, nodes, docs, size, percent)
        links, tried = (found, first) if links is None else (links.unionByName(found), tried.unionByName(first))
        settled = written(components(links), "settled")
        now = open_.select("bucket", "node").join(settled, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        open_, before = written(_unsettled(now.distinct()), "open"), open_
        removed(docs.sparkSession, before)
    pairs = _open_pairs(open_, nodes, percent)
    more = _compared(pairs.join(tried, ["a", "b"], "left_anti"), nodes, docs, size, percent)

    ids = nodes.select("node", "check", "id")
    names = nodes.select("node", F.col("id"))
    linked = links.unionByName(more)
    named = linked.join(names.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    # Rows of one id with different sets: the id is linked with the least id of each of its sets.
    same = rows.where("n_shingles > 0 AND id IS NOT NULL").join(ids.withColumnRenamed("id", "y"), ["node", "check"]).select(F.col("id").alias("a"), F.col("y").alias("b")).where("a <> b")
    found = written(components(named.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same)), "components")
    out = rows.select("id", "n_shingles").join(found.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def one_of_each(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: the one whose id the component has. Repeated rows of that id
    stay if they are all it has; a null id stays."""
    own = join(df.select(id_col, text_col), size, percent, id_col, text_col)
    # Written, the ids that go have a known size: below its threshold Spark broadcasts them, and the
    # texts are not shuffled.
    gone = written(own.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "gone", keep=True)
    return df.join(gone, id_col, "left_anti")
