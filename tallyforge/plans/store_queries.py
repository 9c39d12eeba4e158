"""Queries that go through the versioned store, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders, history, store
from ..sources.draws import SQL_DRAWS, date_text, draws


def versions_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws are saved; then, with their sales corrected (doubled), saved again, and the first
    version is made the newest once more. Each version, and the newest by default (0), is read back."""
    folder = folders.shared(spark, "history")
    d = draws(spark, sf_dir)
    history.save(history.raw(d), folder)
    history.save(history.raw(d.withColumn("sales", F.col("sales") * 2)), folder)
    store.restore(folder, 1)
    every = [history.parse(history.load_history(spark, folder, v)).select(F.lit(v or 0).alias("version"), "draw_no", date_text(F.col("draw_date")).alias("draw_date"), "weekday", F.array_join(F.transform("reds", lambda x: x.cast("string")), " ").alias("reds"), F.array_join(F.transform("draw_order", lambda x: x.cast("string")), " ").alias("draw_order"), "blue", "sales", "jackpot", "first_prize_count") for v in (1, 2, 3, None)]
    one, two, three, newest = every
    return one.unionByName(two).unionByName(three).unionByName(newest)


def version_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests say of a store that got all draws, then those of the newest year again,
    added as files of their own."""
    folder = folders.shared(spark, "history")
    d = draws(spark, sf_dir)
    history.save(history.raw(d), folder)
    newest = d.agg(F.max("draw_date").alias("last"))
    year = d.join(F.broadcast(newest), F.year("draw_date") == F.year("last")).drop("last")  # one row
    history.extend(history.raw(year), folder)
    return store.versions(spark, folder).select("version", "records", "newest", "oldest")


QUERIES = {"S7_versions": versions_read_back, "S7_manifest": version_table}
_COLUMNS = "draw_no, strftime(draw_date, '%Y-%m-%d') AS draw_date, weekday, array_to_string(reds, ' ') AS reds, array_to_string(draw_order, ' ') AS draw_order, blue"
SQL = {
    "S7_versions": SQL_DRAWS + f"SELECT v::INT AS version, {_COLUMNS}, CASE WHEN v = 2 THEN 2 * sales ELSE sales END AS sales, jackpot, first_prize_count FROM draws, range(4) t(v)",
    "S7_manifest": SQL_DRAWS + "SELECT 1::BIGINT AS version, count(*) AS records, max(draw_no::VARCHAR) AS newest, min(draw_no::VARCHAR) AS oldest FROM draws UNION ALL SELECT 2, count(*) + count(*) FILTER (year(draw_date) = (SELECT year(max(draw_date)) FROM draws)), max(draw_no::VARCHAR), min(draw_no::VARCHAR) FROM draws",
}
