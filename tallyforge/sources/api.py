"""Draws from a paged HTTP API, as Python data sources of Spark: a batch one, and a polling stream.

The transport is a parameter (a function of parameters and a time limit that returns the decoded
object), so tests and mirrors need no network. It is part of the class that a session registers, never
of an option. Each partition of a batch fetches a run of ids.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .history import API

Transport = Callable[[dict, float], dict]
#: Result code of a good answer. Fixed value.
GOOD = "000000"
#: A poll looks at so many of the latest ids, on draw days from this time on. Fixed values.
LOOKBACK, DRAW_DAYS, FROM = 10, (1, 3, 6), (21, 30)


def http(url: str) -> Transport:
    from urllib.parse import urlencode
    from urllib.request import urlopen

    def get(params: dict, timeout: float) -> dict:
        with urlopen(f"{url}?{urlencode(params)}", timeout=timeout) as r:
            return json.loads(r.read())

    return get


def fetch(transport: Transport, params: dict, timeout: float = 15, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> dict | None:
    """The answer's data. Errors of transport or format are tried again after 1, 2, ... seconds; an
    answer with another result code than GOOD, or none, is final. None if nothing came."""
    for k in range(tries):
        try:
            answer = transport(params, timeout)
        except (OSError, ValueError):
            if k + 1 < tries:
                wait(2.0**k)
            continue
        return answer if isinstance(answer, dict) and answer.get("resCode") == GOOD else None
    return None


def newest(transport: Transport, count: int) -> list[str]:
    answer = fetch(transport, {"transactionType": "list", "count": str(count)})
    return [str(i) for i in (answer or {}).get("issue", [])]


def details(transport: Transport, ids: list[str]) -> Iterator[tuple[str, str | None]]:
    """(id, JSON text), null for an id that can't be fetched."""
    for i in ids:
        answer = fetch(transport, {"transactionType": "detail", "issue": i})
        yield i, json.dumps(answer, ensure_ascii=False) if answer else None


class _Ids(InputPartition):
    def __init__(self, ids: list[str]):
        super().__init__(None)
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, transport: Transport, options: dict):
        self.transport, self.options = transport, options

    def partitions(self) -> list[InputPartition]:
        ids, chunk = [i for i in self.options.get("ids", "").split(",") if i], int(self.options.get("chunk", "50"))
        return [_Ids(ids[k : k + chunk]) for k in range(0, len(ids), chunk)] or [_Ids([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.options.get("mode") == "list":
            yield from ((i,) for i in newest(self.transport, int(self.options.get("count", "100"))))
        else:
            yield from details(self.transport, partition.ids)


class _Poll(SimpleDataSourceStreamReader):
    """Offsets are the day of the last poll, so a day is polled once, whatever the trigger."""

    def __init__(self, transport: Transport, clock: Callable[[], datetime]):
        self.transport, self.clock = transport, clock

    def initialOffset(self) -> dict:
        return {"day": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.clock()
        day = now.strftime("%Y%m%d")
        if not due(now, start["day"]):
            return iter(()), start
        return iter(list(details(self.transport, newest(self.transport, LOOKBACK)))), {"day": day}  # LOOKBACK rows at most

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that is repeated asks again; what is stored already is dropped where it is merged."""
        return details(self.transport, newest(self.transport, LOOKBACK)) if end != start else iter(())


def due(now: datetime, last: str) -> bool:
    """On a draw day, after the draw, and not polled on this day."""
    return now.weekday() in DRAW_DAYS and (now.hour, now.minute) >= FROM and now.strftime("%Y%m%d") != last


def _source(name_: str, transport: Transport | str, clock: Callable[[], datetime] = datetime.now) -> type[DataSource]:
    get = http(transport) if isinstance(transport, str) else transport

    class Api(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return "issue string" if self.options.get("mode") == "list" else "issue string, body string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(get, dict(self.options))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Poll(get, clock)

    return Api


def issue_list(spark: SparkSession, transport: Transport | str, count: int = 100) -> DataFrame:
    """(issue): ids of the latest draws."""
    spark.dataSource.register(_source("draw_ids", transport))
    return spark.read.format("draw_ids").options(mode="list", count=str(count)).load()


def issue_bodies(spark: SparkSession, transport: Transport | str, ids: list[str], chunk: int = 50) -> DataFrame:
    """(issue, body) of the ids, a task for each `chunk`; body is null where nothing came."""
    spark.dataSource.register(_source("draw_details", transport))
    return spark.read.format("draw_details").options(ids=",".join(ids), chunk=str(chunk)).load()


def objects(bodies: DataFrame) -> DataFrame:
    """API objects of bodies that came."""
    return bodies.where(F.col("body").isNotNull()).select(F.from_json("body", API).alias("x")).select("x.*")


def issue_details(spark: SparkSession, transport: Transport | str, ids: list[str], chunk: int = 50) -> DataFrame:
    """API objects of the ids; ids that can't be fetched are left out."""
    return objects(issue_bodies(spark, transport, ids, chunk))


def poll(spark: SparkSession, transport: Transport | str, clock: Callable[[], datetime] = datetime.now) -> DataFrame:
    """(issue, body) as a stream: the latest ids, once on each draw day after the draw."""
    spark.dataSource.register(_source("draw_poll", transport, clock))
    return spark.readStream.format("draw_poll").load()
