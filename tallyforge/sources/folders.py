"""Folders that the driver and all executors share, and the files in them."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that isn't set, a temporary folder serves a
    session whose tasks all run in the driver's process; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tallyforge/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new shared path and read again, for what is read several times. Its readers
    come later, so it stays until the folder is cleared."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or uri, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def files(uri: str) -> list[pafs.FileInfo]:
    """What lies directly in a folder; nothing where it isn't there."""
    fs, path = opened(uri)
    return fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))


def removed(uri: str) -> None:
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
