"""What the operators on texts share: Arrow batches in small slices, and typed results beside an id."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters (for `slices`: bytes) of text that are in work at once, unless one text alone has more.
SLICE = 2_000_000
#: Bytes of rows that Spark hands to a worker at once. Its own bound is 64 MB, which a worker holds beside
#: its work, and each task of the JVM once more (while the buffer grows, twice) outside the heap.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within hand their rows to workers in batches of BATCH_BYTES; no row is cut."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id and text alone: whatever else the table has, of any name, stays outside."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges with at most so many bytes of text each, one row at least."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def released() -> None:
    """Gives memory that is free but held by the worker's allocators back to the system. Workers live on
    between tasks and jobs; what one has done at its peak shouldn't be held beside the next one's work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc has it
        trim(0)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, work: Callable[[Iterator[tuple[list, list]]], Iterator[dict]], keep: tuple[str, ...] = (), most: int = SLICE) -> DataFrame:
    """One row for each row of df: its id and what `work` makes of it.

    `work` gets (ids, texts) of slices and yields a dict of columns (lists or arrays) for each one.
    `keep` names more input columns, which are passed on under their names.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    kinds = {f.name: f.dataType for f in source.schema}
    out = T.StructType([T.StructField(id_col, kinds["id"])] + [T.StructField(c, kinds[f"kept_{k}"]) for k, c in enumerate(keep)] + list(T.StructType.fromDDL(schema)))
    arrow = to_arrow_schema(out)
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[tuple[list, list]]:
            for batch in rows:
                column = batch.column(1)
                if pa.types.is_large_string(column.type):
                    column = column.cast(pa.string())
                for a, b in slices(column, most):
                    held.append(batch.slice(a, b - a))
                    yield held[-1].column(0).to_pylist(), column.slice(a, b - a).to_pylist()

        for made in work(texts()):
            batch = held.pop()
            parts = [batch.column(0), *[batch.column(2 + k) for k in range(len(keep))], *[made[n] for n in names]]
            yield pa.RecordBatch.from_arrays([p.cast(f.type) if isinstance(p, pa.Array) else pa.array(p, f.type) for p, f in zip(parts, arrow)], schema=arrow)
        released()

    return source.mapInArrow(batches, out)
