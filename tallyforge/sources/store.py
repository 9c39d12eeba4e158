"""A store of raw records in versions: a data source that writes in two phases, and a manifest a version.

    data/<attempt>/part-*.json   records a line, under the fields of the history format, by falling id
    versions/<number>.json       the manifest: the files of the version, with records and range of ids

Tasks write files that no version names yet. When all are done, the commit makes the next version's
manifest under another name and gives it its own at once, if no other writer has taken that: the version
is there as a whole or not at all, and readers keep the files of the one they began with. A write that
fails deletes its files and leaves the newest version what it was. `append` names the files of the
version before beside its own, so that nothing is rewritten; `overwrite` names its own alone. Older
versions are the backups, and can be read or made the newest again.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .folders import files, opened

#: Records of a file, and how old (in seconds) a file that no version names must be to be deleted.
RECORDS, ABANDONED = 100_000, 86_400


class Taken(RuntimeError):
    """Another writer has made the version in the meantime."""


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: list[dict]


def manifests(folder: str) -> dict[int, str]:
    """Paths of the manifests by version."""
    found = (f.path for f in files(f"{folder.rstrip('/')}/versions"))
    return {int(name[:-5]): path for path in found if (name := os.path.basename(path)).endswith(".json") and name[:-5].isdecimal()}


def manifest(folder: str, version: int | None = None) -> dict | None:
    """The manifest of a version, the newest by default; None where there is none. A version that the
    store lacks is an error."""
    have = manifests(folder)
    if version is not None and version not in have:
        raise ValueError(f"{folder} has no version {version}")
    if not have:
        return None
    fs, _ = opened(folder)
    with fs.open_input_stream(have[version if version is not None else max(have)], compression=None) as f:
        return json.loads(f.read())


def _commit(folder: str, made: dict) -> None:
    """The manifest under its own name, at once, unless that is taken."""
    fs, path = opened(f"{folder.rstrip('/')}/versions")
    fs.create_dir(path, recursive=True)
    begun, done = f"{path}/.{uuid4().hex}", f"{path}/{made['version']:08d}.json"
    with fs.open_output_stream(begun, compression=None) as f:
        f.write(json.dumps(made, ensure_ascii=False).encode())
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            os.link(begun, done)  # fails if the name is taken
        elif fs.get_file_info(done).type != pafs.FileType.NotFound:
            raise FileExistsError(done)
        else:
            fs.copy_file(begun, done)
    except FileExistsError as e:
        raise Taken(f"version {made['version']} of {folder}") from e
    finally:
        fs.delete_file(begun)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, attempt: str, base: int, keep: bool, key: str, most: int):
        self.folder, self.attempt, self.base, self.keep, self.key, self.most = folder.rstrip("/"), attempt, base, keep, key, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = opened(f"{self.folder}/data/{self.attempt}")
        partition = TaskContext.get().partitionId()
        made: list[dict] = []
        out = None
        for batch in iterator:
            for record in batch.to_pylist():
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"part-{partition:06d}-{uuid4().hex}.json"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    made.append({"file": f"data/{self.attempt}/{name}", "records": 0, "newest": None, "oldest": None})
                out.write((json.dumps({k: v for k, v in record.items() if v is not None}, ensure_ascii=False) + "\n").encode())
                own, key = made[-1], record[self.key]
                own["records"] += 1
                if key is not None:
                    own["newest"], own["oldest"] = max(own["newest"] or key, key), min(own["oldest"] or key, key)
                if own["records"] >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(partition, made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        before = manifest(self.folder, self.base)["files"] if self.keep and self.base else []
        new = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        _commit(self.folder, {"version": self.base + 1, "attempt": self.attempt, "files": new + before})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(f"{self.folder}/data/{self.attempt}")
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


class VersionedRecords(DataSource):
    """`df.write.format("record_versions").mode("append" or "overwrite").save(folder)`. Options: `key`, the
    field of the id; `records`, the most that a file holds; `base`, the version that the new one is to
    follow (the newest by default): if another has followed it, the write fails."""

    @classmethod
    def name(cls) -> str:
        return "record_versions"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        folder = self.options["path"]
        base = self.options.get("base")
        base = int(base) if base is not None else max(manifests(folder), default=0)
        return _Writer(folder, self.options.get("attempt") or uuid4().hex, base, not overwrite, self.options["key"], int(self.options.get("records", RECORDS)))


def write(records: DataFrame, folder: str, key: str, mode: str = "overwrite", base: int | None = None, most: int = RECORDS) -> dict:
    """Writes records (as they are ordered) as the next version; its manifest."""
    records.sparkSession.dataSource.register(VersionedRecords)
    attempt = uuid4().hex
    options = {"key": key, "attempt": attempt, "records": str(most)} | ({} if base is None else {"base": str(base)})
    records.write.format("record_versions").mode(mode).options(**options).save(folder)
    # Found by its attempt: another writer may have made the version after it already.
    return next(m for v in sorted(manifests(folder), reverse=True) if (m := manifest(folder, v))["attempt"] == attempt)


def paths(folder: str, made: dict) -> list[str]:
    return [f"{folder.rstrip('/')}/{f['file']}" for f in made["files"]]


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, files, records, newest, oldest) of every version."""
    rows = []
    for v in sorted(manifests(folder)):
        own = manifest(folder, v)["files"]
        keys = [f[k] for f in own for k in ("newest", "oldest") if f[k] is not None]
        rows.append((v, len(own), sum(f["records"] for f in own), max(keys, default=None), min(keys, default=None)))
    return spark.createDataFrame(rows, "version long, files long, records long, newest string, oldest string")


def restore(folder: str, version: int) -> int:
    """Makes the files of an older version the newest one, whose number it returns."""
    made = manifest(folder, version) | {"version": max(manifests(folder)) + 1, "attempt": uuid4().hex}
    _commit(folder, made)
    return made["version"]


def vacuum(folder: str, keep: int, older_than: float = ABANDONED) -> tuple[int, int]:
    """Forgets all versions but the newest `keep` and deletes the files that no other names and that are
    old enough not to belong to a write under way; how many versions and files went."""
    if keep < 1:
        raise ValueError("the newest version must stay")
    fs, root = opened(folder.rstrip("/"))
    have = manifests(folder)
    gone = sorted(have)[:-keep]
    for v in gone:
        fs.delete_file(have[v])
    named = {f"{root}/{f['file']}" for v in manifests(folder) for f in manifest(folder, v)["files"]}
    lost = [f for f in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True, recursive=True)) if f.is_file and f.path not in named and time.time() - f.mtime.timestamp() >= older_than]
    for f in lost:
        fs.delete_file(f.path)
    return len(gone), len(lost)


def snapshot(spark: SparkSession, folder: str, schema, version: int | None = None, since: str | None = None, key: str | None = None) -> DataFrame:
    """The records of a version; with `since`, only of files whose ids reach it."""
    made = manifest(folder, version)
    kept = {"files": [f for f in made["files"] if since is None or f["newest"] is None or f["newest"] >= since]} if made else None
    if not kept or not kept["files"]:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).json(paths(folder, kept))
    return found if since is None else found.where(F.col(key) >= since)
