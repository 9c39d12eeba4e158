"""The canonical tables: draws (newest first, idx 0), their balls, and the ball dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import folders

REDS, BLUES, PICKED = 33, 16, 6
#: Keys that share a block when the dense index is made; only block sums are ordered globally.
BLOCK = 4096
WEEKDAYS = ("周日", "周二", "周四")


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """df with idx 0, 1, ... by falling (unique, integer) key, without sorting the table in one task:
    rows are numbered within blocks of keys, and blocks start at the number of rows above them."""
    block = F.floor(F.col(key) / BLOCK)
    sizes = df.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", above.alias("start"))
    rows = df.withColumn("block", block).join(starts, "block")
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.desc(key)))
    return rows.withColumn("idx", (F.col("start") + place - 1).cast("long")).drop("block", "start")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws without their place."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr("l_orderkey div 4").alias("draw_no"), (F.col("l_partkey") % REDS + 1).cast("int").alias("ball"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seen"), "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    # One shuffle by draw: a draw's lines meet in one row, whose arrays hold its few balls.
    lines = li.groupBy("draw_no").agg(
        F.collect_list(F.struct("seen", "ball")).alias("lines"),
        (F.sum(F.col("l_suppkey") + F.col("l_partkey")) % BLUES + 1).cast("int").alias("blue"),
        F.sum(F.floor("l_extendedprice").cast("long")).alias("sales"),
        (F.sum(F.floor("l_quantity").cast("long")) * 100000).alias("jackpot"),
        F.count_if(F.col("l_quantity") >= 49).cast("int").alias("first_prize_count"),
    )
    # Sorted by first sight, then ball: a ball's first struct is its earliest.
    ordered = F.array_distinct(F.transform(F.array_sort("lines"), lambda x: x["ball"]))
    kept = lines.withColumn("draw_order", F.slice(ordered, 1, PICKED)).where(F.size("draw_order") == PICKED).drop("lines")
    week = F.expr("cast(draw_no % 3 as int)")
    return kept.withColumns({"reds": F.array_sort("draw_order"), "draw_date": F.expr("date_add(date'2003-02-23', cast(draw_no div 3 * 7 + draw_no % 3 * 2 as int))"), "weekday": F.get(F.array(*map(F.lit, WEEKDAYS)), week)})


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws derived from lineitem by integer arithmetic: one for each four order keys with six balls."""
    return dense_index(_made(spark, sf_dir), "draw_no").select("idx", "draw_no", "draw_date", "weekday", "reds", "draw_order", "blue", "sales", "jackpot", "first_prize_count")


def written_draws(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """idx and these columns of `draws`, for queries that read them several times: lineitem is read once,
    also for the index, and the draws come from the shared folder."""
    columns = columns or ("reds", "blue")
    rows = _made(spark, sf_dir).select(*dict.fromkeys(("draw_no", *columns)))
    path = folders.shared(spark, "made")
    rows.write.parquet(path)
    try:
        return folders.written(dense_index(spark.read.schema(rows.schema).parquet(path), "draw_no").select("idx", *columns), "draws")
    finally:
        folders.removed(path)


def date_text(day: Column) -> Column:
    """A date as ISO text. Years of more than four digits have no sign, which Spark's pattern puts there."""
    return F.ltrim(F.date_format(day, "yyyy-MM-dd"), F.lit("+"))


def dim(spark: SparkSession, n: int) -> DataFrame:
    """ball 1..n."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("ball"))


def balls(d: DataFrame) -> DataFrame:
    """idx, ball: six rows a draw."""
    return d.select("idx", F.explode("reds").alias("ball"))


def grid(d: DataFrame) -> DataFrame:
    """idx, ball, hit: a row for each ball of the pool and draw, made within the draw's row."""
    return d.select("idx", F.explode(F.transform(F.sequence(F.lit(1), F.lit(REDS)), lambda b: F.struct(b.cast("int").alias("ball"), F.array_contains("reds", b).alias("hit")))).alias("x")).select("idx", "x.ball", "x.hit")


def weight(half_life: float) -> Column:
    """Weight of a draw by age idx: halves every half_life draws; 1 if that isn't positive."""
    import math

    return F.exp(F.col("idx") * F.lit(-math.log(2) / half_life)) if half_life > 0 else F.lit(1.0)


#: The same tables for DuckDB; every oracle begins with this.
SQL_DRAWS = """WITH li AS (SELECT l_orderkey // 4 AS dn, (l_partkey % 33 + 1)::INT AS ball, l_orderkey * 8 + l_linenumber AS seen FROM lineitem),
seen AS (SELECT dn, ball, min(seen) AS fs FROM li GROUP BY ALL),
placed AS (SELECT dn, ball, row_number() OVER (PARTITION BY dn ORDER BY fs, ball) AS ord FROM seen),
six AS (SELECT dn, list(ball ORDER BY ord) AS draw_order, list(ball ORDER BY ball) AS reds FROM placed WHERE ord <= 6 GROUP BY dn HAVING count(*) = 6),
money AS (SELECT l_orderkey // 4 AS dn, (sum(l_suppkey + l_partkey) % 16 + 1)::INT AS blue, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS sales, (sum(floor(l_quantity)::BIGINT) * 100000)::BIGINT AS jackpot, (count(*) FILTER (l_quantity >= 49))::INT AS first_prize_count FROM lineitem GROUP BY 1),
draws AS MATERIALIZED (SELECT (count(*) OVER () - row_number() OVER (ORDER BY dn))::BIGINT AS idx, dn AS draw_no, DATE '2003-02-23' + ((dn // 3) * 7 + (dn % 3) * 2)::INT AS draw_date, ['周日', '周二', '周四'][(dn % 3)::INT + 1] AS weekday, reds, draw_order, blue, sales, jackpot, first_prize_count FROM six JOIN money USING (dn)),
balls AS (SELECT idx, unnest(reds) AS ball FROM draws),
dim_red AS (SELECT i::INT AS ball FROM range(1, 34) t(i)), dim_blue AS (SELECT i::INT AS ball FROM range(1, 17) t(i)),
n_draws AS (SELECT count(*) AS n FROM draws)
"""
