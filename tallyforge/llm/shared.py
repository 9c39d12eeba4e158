"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_folder: ContextVar[str | None] = ContextVar("folder of the job", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder: spark.checkpoint.dir, or what setCheckpointDir was given. Where neither is
    set, a temporary folder serves a session whose tasks all run in the driver's process, as in tests;
    on a cluster that folder would not be shared, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet and read again: its lineage ends here, lost executors lose nothing of it,
    and joins see its true size. Within `scratch` it goes when that ends, unless it is to be kept."""
    path = place(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path for files of this name, as `written` takes it."""
    folder = (None if keep else _folder.get()) or f"{shared_dir(spark)}/tallyforge"
    return f"{folder}/{name}-{uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that `written` made and nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            _delete(spark, file.rsplit("/", 1)[0])


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written within are deleted at its end, whether it ends well or not."""
    path = f"{shared_dir(spark)}/tallyforge/{name}-{uuid4().hex}"
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        _delete(spark, path)
