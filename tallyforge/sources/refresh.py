"""A full refresh from the API: paced, resumable, and seen by readers only when it is whole.

The ids are dealt to lanes, one task each, which ask for theirs in chunks. A lane keeps the pace of its
share of the whole, so that all together ask no faster than one lane alone may, however the tasks are
scheduled. A chunk that is done is a file of the progress folder, which appears at once; a refresh that
is begun again with the same folder asks only for what lacks. When all chunks are there, their records
become the store's next version, and the progress goes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, history
from .folders import files, opened, removed


@dataclass(frozen=True)
class Pace:
    """Seconds after each request, and after each `every` of them. Those of the survey."""

    delay: float = 0.25
    every: int = 100
    pause: float = 2.0

    def after(self, asked: int, lanes: int = 1) -> float:
        """What a lane waits after its own request number `asked` where `lanes` ask at once."""
        return (self.pause if asked % self.every == 0 else self.delay) * lanes


def _put(uri: str, name: str, text: str) -> None:
    """A file that is there as a whole or not at all."""
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)
    begun = f"{path}/.{uuid4().hex}"
    with fs.open_output_stream(begun, compression=None) as f:
        f.write(text.encode())
    fs.move(begun, f"{path}/{name}")


def _listed(transport: api.Transport, progress: str, count: int) -> list[str]:
    """The ids of this refresh, oldest first: those it began with, or the newest `count` now."""
    fs, path = opened(f"{progress}/ids.json")
    if fs.get_file_info(path).is_file:
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())
    ids = api.newest(transport, count)[::-1]
    if not ids:
        raise ValueError("no ids could be listed")
    _put(progress, "ids.json", json.dumps(ids))
    return ids


def refresh(spark: SparkSession, transport: api.Transport | str, folder: str, progress: str, count: int = 3500, lanes: int = 4, chunk: int = 50, pace: Pace = Pace(), wait: Callable[[float], None] = time.sleep, least: float = 0.0) -> DataFrame:
    """The newest `count` draws as the next version of the store in `folder`; (issue, fetched, stored) of
    each id: stored is false where nothing came or the draw has no balls yet.

    An error of a task ends the refresh, as does an answer to less than the share `least` of the ids; the
    store stays what it was, and `progress` keeps what was asked for. Ids that can't be fetched after
    their tries are answers without a draw, as in an update."""
    get = api.http(transport) if isinstance(transport, str) else transport
    progress = progress.rstrip("/")
    ids = _listed(get, progress, count)
    parts = [ids[k : k + chunk] for k in range(0, len(ids), chunk)]
    done = {f.base_name for f in files(f"{progress}/chunks")}
    todo = [k for k in range(len(parts)) if f"{k:06d}.json" not in done]

    def lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                asked = 0
                for k in todo[own::lanes]:
                    lines = []
                    for issue, body in api.details(get, parts[k]):
                        lines.append(json.dumps({"issue": issue, "body": body}, ensure_ascii=False))
                        asked += 1
                        wait(pace.after(asked, lanes))
                    _put(f"{progress}/chunks", f"{k:06d}.json", "\n".join(lines))
                yield pa.RecordBatch.from_pydict({"lane": [own], "asked": [asked]})

    if todo:
        # A task a lane; what it yields is a row, so collecting it only runs the job.
        spark.range(0, lanes, 1, lanes).mapInArrow(lane, "lane long, asked long").collect()
    bodies = spark.read.schema("issue string, body string").json([f"{progress}/chunks/{k:06d}.json" for k in range(len(parts))])
    came = bodies.where("body IS NOT NULL").count()
    if came < least * len(ids):
        raise ValueError(f"{came} of {len(ids)} ids were answered")
    history.save(history.parse_issue(api.objects(bodies)).dropDuplicates(["issue"]), folder)
    stored = history.load_history(spark, folder).select("issue", F.lit(True).alias("stored"))
    outcome = bodies.select("issue", F.col("body").isNotNull().alias("fetched")).join(stored, "issue", "left").select("issue", "fetched", F.coalesce("stored", F.lit(False)).alias("stored"))
    outcome = spark.createDataFrame(outcome.collect(), outcome.schema)  # a row an id of the list
    removed(progress)
    return outcome
