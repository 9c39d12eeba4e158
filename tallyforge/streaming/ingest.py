"""Ingest as a stream: raw records arrive as files, ids are stored once, and member weights follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import api
from ..sources.history import parse, parse_issue

RECORD = "issue string, open_date string, weekday string, reds string, blue string, draw_order string, sales string, jackpot string, first_prize_count string, first_prize_money string"


#: How long the state of a stream remembers a record that arrived.
HORIZON = "2 days"


def stored_ids(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(store).select("draw_no") if there else None


def one_of_each(draws: DataFrame, key: str = "draw_no") -> DataFrame:
    """One row of each id, the same whatever the order they come in: that with the fewest nulls, of these
    the greatest by its columns."""
    columns = [c for c in draws.columns if c != key]
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    best = draws.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(known.alias("known"), *columns)).alias("best"))
    return best.select(*[F.col(key) if c == key else F.col(f"best.{c}").alias(c) for c in draws.columns])


def _merge(records: DataFrame, store: str) -> None:
    """Appends parsed draws of raw records, one of each id, without the ids that the store has already, so
    a repeated batch changes nothing. Late ids are taken like any other. Of the store only what lies
    between the batch's ids is looked at: parquet passes over the rest by its statistics."""
    new = one_of_each(parse(records)).persist()
    try:
        ends = new.agg(F.min("draw_no").alias("lo"), F.max("draw_no").alias("hi")).first()
        have = stored_ids(records.sparkSession, store)
        if have is not None and ends["lo"] is not None:
            near = have.where(F.col("draw_no").between(ends["lo"], ends["hi"]))
            new.join(near, "draw_no", "left_anti").write.mode("append").parquet(store)
        else:
            new.write.mode("append").parquet(store)
    finally:
        new.unpersist()


def arrivals(spark: SparkSession, source: str, horizon: str = HORIZON) -> DataFrame:
    """Raw records of new files as a stream, without those that arrived, as they are, within the horizon
    before. The time is that of the file, so no record is late by its draw's date; the state holds a hash
    for each record of the horizon and no more, however long the stream runs."""
    stream = spark.readStream.schema(RECORD).json(source)
    names = stream.columns
    rows = stream.select(*names, F.col("_metadata.file_modification_time").alias("arrived"), F.xxhash64(*names).alias("content"))
    return rows.withWatermark("arrived", horizon).dropDuplicatesWithinWatermark(["issue", "content"]).select(*names)


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, once: bool = True, horizon: str = HORIZON) -> StreamingQuery:
    """Appends draws of new files to the store, each id once: what came before within the horizon stops at
    the stream's state, the rest at the store."""
    writer = arrivals(spark, source, horizon).writeStream.foreachBatch(lambda batch, _: _merge(batch, store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def follow(spark: SparkSession, transport: api.Transport | str, store: str, checkpoint: str, clock: Callable[[], datetime] = datetime.now, every: str = "5 minutes") -> StreamingQuery:
    """Polls the API on draw days after the draw, once a day, and appends what the store lacks. The day of
    the last poll is the stream's offset, so it outlives a restart."""

    def merge(batch: DataFrame, _: int) -> None:
        _merge(parse_issue(api.objects(batch)), store)

    stream = api.poll(spark, transport, clock)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def full_refresh(spark: SparkSession, source: str, store: str) -> None:
    """The store anew from all files, by falling id."""
    rows = one_of_each(parse(spark.read.schema(RECORD).json(source)))
    rows.orderBy(F.desc("draw_no")).write.mode("overwrite").parquet(store)


def weight_stream(scores: DataFrame, beta: float = 0.9, last: int = 10) -> DataFrame:
    """(member, n, weight, recent) after each batch of a stream of (member, idx, score): w <- beta w +
    (1 - beta) score from 1, a batch's scores from the oldest (largest idx) on, and the sum of the `last`
    scores over their number when full. The state of a member is its count, weight and last scores."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, w, kept = state.get if state.exists else (0, 1.0, [])
        kept = list(kept)
        for score in pd.concat(list(parts)).sort_values("idx", ascending=False)["score"]:
            n, w = n + 1, beta * w + (1 - beta) * score
            kept = [*kept, float(score)][-last:]
        state.update((n, w, kept))
        yield pd.DataFrame({"member": [key[0]], "n": [n], "weight": [w], "recent": [sum(kept) / last]})

    return scores.groupBy("member").applyInPandasWithState(step, "member int, n long, weight double, recent double", "n long, weight double, last array<double>", "update", GroupStateTimeout.NoTimeout)
