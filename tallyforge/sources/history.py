"""History files and API objects: raw records of strings, their parsing, and versioned writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .draws import date_text

# The fields of a raw record and their columns here.
FIELDS = {"期号": "issue", "开奖日期": "open_date", "星期": "weekday", "红球": "reds", "蓝球": "blue", "红球顺序": "draw_order", "销售额": "sales", "奖池金额": "jackpot", "一等奖注数": "first_prize_count", "一等奖奖金": "first_prize_money"}
RAW = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
API = "issue string, openTime string, week string, frontWinningNum string, backWinningNum string, seqFrontWinningNum string, saleMoney string, prizePoolMoney string, winnerDetails array<struct<awardEtc: string, baseBetWinner: struct<awardNum: string, awardMoney: string>>>"


def _read(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], T.StructType([*RAW, T.StructField("corrupt", T.StringType())]))
    kept = T.StructType([*RAW, T.StructField("corrupt", T.StringType())])
    return spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def load_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Raw records under the columns of FIELDS: of a store that `save` wrote, those of a version (the
    newest by default), else those of a JSON array file or a folder of such. A missing path, or one that
    holds no list of objects, gives no rows; nothing is created. Fields of other types are read as text.
    What is no JSON is left out here and comes with `malformed`. A version of what is no store, or one
    it lacks, is an error."""
    if version is not None or store.manifests(path):
        return store.snapshot(spark, path, RAW, version).toDF(*FIELDS.values())
    read = _read(spark, path).where("corrupt IS NULL").drop("corrupt")
    return read.toDF(*FIELDS.values()).where(F.col("issue").isNotNull() | F.col("reds").isNotNull())


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of what `load_history` can't read: a file that is no JSON is one such text."""
    read = _read(spark, path)
    if "corrupt" not in read.columns or not read.inputFiles():
        return spark.createDataFrame([], "file string, text string")
    # Spark reads the corrupt column only beside another one.
    return read.where("corrupt IS NOT NULL AND (`期号` IS NULL OR length(`期号`) >= 0)").select(F.input_file_name().alias("file"), F.col("corrupt").alias("text"))


def _numbers(text: Column) -> Column:
    """Integers of a text apart by white space; what is no number is null."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("int"))


def parse(records: DataFrame) -> DataFrame:
    """Typed draws of raw records. An absent draw order is the reds as written; absent money is 0."""
    money = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).alias(c)
    return records.select(
        F.col("issue").try_cast("bigint").alias("draw_no"),
        F.when(F.col("open_date").rlike(r"^\d{4,7}-\d{2}-\d{2}$"), F.col("open_date")).try_cast("date").alias("draw_date"),
        F.coalesce("weekday", F.lit("")).alias("weekday"),
        F.array_sort(_numbers(F.col("reds"))).alias("reds"),
        _numbers(F.coalesce("draw_order", "reds")).alias("draw_order"),
        F.trim("blue").try_cast("int").alias("blue"),
        money("sales"),
        money("jackpot"),
        F.coalesce(F.col("first_prize_count").try_cast("int"), F.lit(0)).alias("first_prize_count"),
        money("first_prize_money"),
    )


def raw(draws: DataFrame) -> DataFrame:
    """Draws as raw records: text in every column, balls of two digits."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(x.cast("string"), 2, "0")), " ")
    return draws.select(F.col("draw_no").cast("string").alias("issue"), date_text(F.col("draw_date")).alias("open_date"), "weekday", text("reds").alias("reds"), F.lpad(F.col("blue").cast("string"), 2, "0").alias("blue"), text("draw_order").alias("draw_order"), F.col("sales").cast("string").alias("sales"), F.col("jackpot").cast("string").alias("jackpot"), F.col("first_prize_count").cast("string").alias("first_prize_count"), F.lit(None).cast("string").alias("first_prize_money"))


def prize(details: Column, level: str, field: str) -> Column:
    """A field of the first award of a level; "0" without one."""
    return F.coalesce(F.get(F.filter(details, lambda x: x["awardEtc"] == level), F.lit(0))["baseBetWinner"][field], F.lit("0"))


def parse_issue(objects: DataFrame, level: str = "1") -> DataFrame:
    """Raw records of API objects. One without reds or blue is rejected; balls get two digits."""
    padded = lambda c: F.array_join(F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), lambda x: F.lpad(x, 2, "0")), " ")
    given = objects.where((F.trim(F.coalesce("frontWinningNum", F.lit(""))) != "") & (F.trim(F.coalesce("backWinningNum", F.lit(""))) != ""))
    return given.select("issue", F.col("openTime").alias("open_date"), F.col("week").alias("weekday"), padded("frontWinningNum").alias("reds"), padded("backWinningNum").alias("blue"), padded(F.coalesce("seqFrontWinningNum", F.lit(""))).alias("draw_order"), F.coalesce("saleMoney", F.lit("0")).alias("sales"), F.coalesce("prizePoolMoney", F.lit("0")).alias("jackpot"), prize(F.col("winnerDetails"), level, "awardNum").alias("first_prize_count"), prize(F.col("winnerDetails"), level, "awardMoney").alias("first_prize_money"))


def api_objects(draws: DataFrame) -> DataFrame:
    """Draws in the shape of API objects, through JSON: unpadded balls, every seventh without balls,
    every fifth without details."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    details = F.when(F.col("draw_no") % 5 != 0, F.array(*[F.struct(F.lit(k).alias("awardEtc"), F.struct((F.col("first_prize_count") * m).cast("string").alias("awardNum"), (F.col("first_prize_count") * m * 1000).cast("string").alias("awardMoney")).alias("baseBetWinner")) for k, m in (("2", 9), ("1", 1))]))
    empty = F.col("draw_no") % 7 == 0
    made = draws.select(F.to_json(F.struct(F.col("draw_no").cast("string").alias("issue"), date_text(F.col("draw_date")).alias("openTime"), F.col("weekday").alias("week"), F.when(empty, "").otherwise(text("reds")).alias("frontWinningNum"), F.col("blue").cast("string").alias("backWinningNum"), text("draw_order").alias("seqFrontWinningNum"), F.col("sales").cast("string").alias("saleMoney"), F.col("jackpot").cast("string").alias("prizePoolMoney"), details.alias("winnerDetails"))).alias("body"))
    return made.select(F.from_json("body", API).alias("x")).select("x.*")


def missing_ids(offered: DataFrame, store: DataFrame, lookback: int, key: str = "draw_no") -> DataFrame:
    """Ids among the newest `lookback` offered that the store lacks, with their place, oldest first."""
    newest = offered.select(key).orderBy(F.desc(key)).limit(lookback)
    gone = newest.join(store.select(key), key, "left_anti")
    return gone.select(key, F.row_number().over(Window.orderBy(key)).alias("place"))  # lookback rows at most


def append(store: DataFrame, fetched: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are null."""
    return store.unionByName(fetched, allowMissingColumns=True)


def _written_form(records: DataFrame) -> DataFrame:
    """Records under the fields of RAW, by falling id."""
    names = {c: f for f, c in FIELDS.items()}
    rows = records.select(*[F.col(c).cast("string").alias(names[c]) for c in FIELDS.values() if c in records.columns])
    return rows.orderBy(F.desc(names["issue"]))


def save(records: DataFrame, folder: str, version: int | str | None = None) -> str:
    """Writes records by falling id (as text) as the next version of the store in `folder`, which
    `load_history` reads; the path of its files. Older versions stay as backups (`store.restore`). A
    `version` that is given must be the next one; a write that fails leaves the newest what it was."""
    base = None if version is None else int(version) - 1
    if base is not None and base != max(store.manifests(folder), default=0):
        raise store.Taken(f"version {version} isn't the next one of {folder}")
    made = store.write(_written_form(records), folder, RAW.fieldNames()[0], base=base)
    return f"{folder.rstrip('/')}/data/{made['attempt']}"


def extend(records: DataFrame, folder: str) -> int:
    """The next version of the store: its newest with these records added, as files of their own."""
    return store.write(_written_form(records), folder, RAW.fieldNames()[0], mode="append")["version"]


def status(draws: DataFrame, today: str) -> DataFrame:
    """Rows, days covered, days since the last draw and the estimate of draws missed: half of these, the
    fraction cut off (towards 0, so also for a day ahead of the last draw)."""
    since = F.datediff(F.lit(today).cast("date"), F.max("draw_date"))
    return draws.agg(F.count("*").alias("total"), F.max("draw_no").alias("latest"), F.datediff(F.max("draw_date"), F.min("draw_date")).alias("days_covered"), since.alias("days_since"), (since / 2).cast("bigint").alias("missed"))


def completed(spark: SparkSession, store: DataFrame, transport, lookback: int = 10) -> tuple[DataFrame, DataFrame]:
    """(store, outcome) after one update: the ids among the newest `lookback` offered that the store (of
    raw records) lacks are fetched and appended, oldest first; outcome has a row for each of them
    (issue, place, stored), stored being false where nothing came or the draw has no balls yet."""
    from . import api

    offered = api.issue_list(spark, transport, lookback).select(F.col("issue").cast("long").alias("draw_no"))
    gone = missing_ids(offered, store.select(F.col("issue").try_cast("bigint").alias("draw_no")), lookback)
    ids = [(str(r["draw_no"]), r["place"]) for r in gone.orderBy("place").collect()]  # lookback rows at most
    asked = spark.createDataFrame(ids, "issue string, place int")
    fetched = parse_issue(api.issue_details(spark, transport, [i for i, _ in ids]))
    # Fetched once: the rows are few, and the outcome is that of what is appended.
    fetched = spark.createDataFrame(fetched.collect(), fetched.schema)
    outcome = asked.join(fetched.select("issue", F.lit(True).alias("stored")), "issue", "left").select("issue", "place", F.coalesce("stored", F.lit(False)).alias("stored"))
    return append(store, fetched), outcome
