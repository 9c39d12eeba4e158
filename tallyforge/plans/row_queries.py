"""Queries of the row features, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rows
from ..sources.draws import BLUES, REDS, SQL_DRAWS, date_text, draws

_BASIC_DOUBLES = {"red_mean", "red_median", "red_std", "red_odd_ratio", "red_mean_gap"}


def encode_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(spark, sf_dir).select("idx", *rows.rounded(rows.basic(), _BASIC_DOUBLES))


def encode_draw_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubles = {n for n in rows.advanced() if n.endswith(("ratio", "entropy", "third", "mean")) or n == "prime_ratio"}
    return draws(spark, sf_dir).select("idx", *rows.rounded(rows.advanced(), doubles))


def counted(d: DataFrame) -> DataFrame:
    """d with red_counts, blue_counts (arrays by ball) and total: 49 sums, broadcast as one row."""
    sums = d.agg(F.count("*").cast("int").alias("total"), *[F.count_if(F.array_contains("reds", b)).cast("int").alias(f"r{b}") for b in range(1, REDS + 1)], *[F.count_if(F.col("blue") == b).cast("int").alias(f"b{b}") for b in range(1, BLUES + 1)])
    one = sums.select("total", F.array(*[f"r{b}" for b in range(1, REDS + 1)]).alias("red_counts"), F.array(*[f"b{b}" for b in range(1, BLUES + 1)]).alias("blue_counts"))
    return d.crossJoin(F.broadcast(one))  # one row by construction


def frequency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(draws(spark, sf_dir)).select("idx", *rows.rounded({n: c for n, c in rows.frequency().items() if n != "red_prob_product"}, {"red_avg_freq", "blue_freq"}), F.round(rows.frequency()["red_prob_product"], 2).alias("red_prob_product"))


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 in long form: names asked for in order; one that a draw lacks is 0."""
    names = ("red_sum", "red_ac", "no_such_feature", "blue_zone")
    have = rows.basic()
    vector = F.array(*[F.coalesce(have.get(n, F.lit(None)).cast("double"), F.lit(0.0)) for n in names])
    return draws(spark, sf_dir).select("idx", F.posexplode(vector).alias("place", "value"))


def day_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(spark, sf_dir).select("idx", *rows.rounded(rows.day_of_week(), {"day_sin", "day_cos"}))


def draw_order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows.draw_order()
    return draws(spark, sf_dir).select("idx", *rows.rounded(f, {n for n in f if n.endswith("avg") or n == "order_mean_gap"}))


def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows.seasonal()
    return draws(spark, sf_dir).select("idx", *rows.rounded(f, {n for n in f if n.endswith(("sin", "cos"))}))


def draw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draws(spark, sf_dir)
    return d.select("idx", "draw_no", date_text(F.col("draw_date")).alias("draw_date"), "weekday", F.array_join(F.transform("reds", lambda x: x.cast("string")), " ").alias("reds"), F.array_join(F.transform("draw_order", lambda x: x.cast("string")), " ").alias("draw_order"), "blue", "sales", "jackpot", "first_prize_count")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(spark, sf_dir).agg(F.count("*").alias("total"), F.max_by("draw_no", F.col("draw_no")).alias("newest"), F.min_by("draw_no", F.col("draw_no")).alias("oldest"), date_text(F.min("draw_date")).alias("first_date"), date_text(F.max("draw_date")).alias("last_date"))


def split_by_date(spark: SparkSession, sf_dir: str, cutoff: str = "2010-01-01") -> DataFrame:
    d = draws(spark, sf_dir).where(F.col("draw_date").isNotNull())
    return d.select("idx", F.when(F.col("draw_date") > F.to_date(F.lit(cutoff)), "val").otherwise("train").alias("role"))


def last_n(spark: SparkSession, sf_dir: str, n: int = 25) -> DataFrame:
    return draws(spark, sf_dir).where(F.col("idx") < n).select("idx", "draw_no", "blue")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw days (Sunday, Tuesday, Thursday), seen from up to six days after each draw: whether that date
    is one, the last up to it, the next after it, and the seconds from a time of it (an hour and a minute
    more for each draw) to the draw at 21:15."""
    days = draws(spark, sf_dir).select(F.date_add("draw_date", (F.col("idx") % 7).cast("int")).alias("d"), F.col("idx").alias("id"))
    since = F.get(F.array(*map(F.lit, (1, 0, 1, 0, 1, 2, 0))), F.weekday("d"))
    nxt = F.least(*[F.next_day("d", x) for x in ("TU", "TH", "SU")])
    # A time of the day added to the date: text with a year of five digits is no time stamp.
    at = lambda hours, minutes: F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours, minutes)
    now, at_draw = at((F.col("id") % 24).cast("int"), (F.col("id") % 60).cast("int")), at(F.lit(21), F.lit(15))
    return days.select(F.col("id").alias("idx"), date_text(F.col("d")).alias("d"), F.weekday("d").isin(1, 3, 6).alias("is_draw_day"), date_text(F.date_sub("d", since)).alias("last_draw"), date_text(nxt).alias("next_draw"), F.timestamp_diff("SECOND", now, at_draw).alias("seconds_until"))


def draw_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store covers, seen from a fixed day."""
    from ..sources.history import status

    return status(draws(spark, sf_dir), "2100-01-01")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws as raw records of strings, parsed back."""
    from ..sources.history import parse, raw

    p = parse(raw(draws(spark, sf_dir)))
    return p.select("draw_no", date_text(F.col("draw_date")).alias("draw_date"), *[F.get("reds", F.lit(k)).alias(f"r{k + 1}") for k in range(6)], F.get("draw_order", F.lit(0)).alias("first_ball"), "blue", "sales", "jackpot", "first_prize_count", "first_prize_money")


def parsed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API objects made from the draws (unpadded balls), parsed to records."""
    from ..sources.history import api_objects, parse_issue

    return parse_issue(api_objects(draws(spark, sf_dir)))


def latest_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the newest 40 draws that a store lacking every third draw has not, oldest first,
    beside the store's latest id."""
    from ..sources.history import missing_ids

    d = draws(spark, sf_dir)
    store = d.where("idx % 3 <> 0")
    latest = store.agg(F.max("draw_no").alias("latest"))
    return missing_ids(d.where("idx < 40").select("draw_no"), store, 40).crossJoin(F.broadcast(latest))  # one row


_CNT = "len(list_filter(reds, lambda x: {}))"


def _cnt(test: str, name: str) -> str:
    return f"len(list_filter(reds, lambda x: {test}))::INT AS {name}"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


_GAPS = "[reds[2]-reds[1], reds[3]-reds[2], reds[4]-reds[3], reds[5]-reds[4], reds[6]-reds[5]]"
_AC = "(len(list_distinct([" + ", ".join(f"reds[{j}]-reds[{i}]" for i in range(1, 7) for j in range(i + 1, 7)) + "])) - 5)::INT"
_BASIC = ", ".join(
    [
        "list_sum(reds)::INT AS red_sum", _r("list_sum(reds) / 6.0::DOUBLE", "red_mean"), _r("(reds[3] + reds[4]) / 2.0::DOUBLE", "red_median"), "reds[1] AS red_min", "reds[6] AS red_max", "reds[6] - reds[1] AS red_span", _r("list_stddev_pop(reds)", "red_std"),
        _cnt("x % 2 = 1", "red_odd_count"), _cnt("x % 2 = 0", "red_even_count"), _r(_CNT.format("x % 2 = 1") + " / 6.0::DOUBLE", "red_odd_ratio"),
        _cnt("x <= 11", "red_zone_small"), _cnt("x BETWEEN 12 AND 22", "red_zone_mid"), _cnt("x >= 23", "red_zone_large"), *[_cnt(f"x % 3 = {k}", f"red_mod3_{k}") for k in range(3)],
        f"list_max({_GAPS}) AS red_max_gap", f"list_min({_GAPS}) AS red_min_gap", _r("(reds[6] - reds[1]) / 5.0::DOUBLE", "red_mean_gap"), f"list_max({_GAPS}) - list_min({_GAPS}) AS red_gap_range",
        f"{_AC} AS red_ac", *[f"reds[{k}] AS pos_{k}" for k in range(1, 7)], "blue", "blue % 2 AS blue_parity", "blue % 3 AS blue_mod3", "CASE WHEN blue <= 4 THEN 0 WHEN blue <= 8 THEN 1 WHEN blue <= 12 THEN 2 ELSE 3 END AS blue_zone",
    ]
)
_PRIME_LIST = "[" + ", ".join(map(str, rows.PRIMES)) + "]"
_TAILS = [_CNT.format(f"x % 10 = {t}") for t in range(10)]


def _entropy(m: int) -> str:
    terms = " + ".join(f"({_CNT.format(f'x % {m} = {k}')} / 6.0::DOUBLE * ln(greatest({_CNT.format(f'x % {m} = {k}')}, 0.001)::DOUBLE / 6.0))" for k in range(m))
    return _r(f"-({terms}) / ln({m}::DOUBLE)", f"mod{m}_entropy")


def _ratio(expr: str, name: str) -> str:
    return _r(f"CASE WHEN reds[6] = reds[1] THEN 0.0 ELSE ({expr})::DOUBLE / (reds[6] - reds[1]) END", name)


_ADVANCED = ", ".join(
    [
        "pairs::INT AS consecutive_pairs", "longest::INT AS max_consecutive_run", "(runs >= 2)::INT AS has_double_consecutive", "(longest >= 3)::INT AS triple_consecutive", "runs::INT AS consecutive_run_count",
        _cnt(f"x IN {rows.PRIMES}", "prime_count"), _r(_CNT.format(f"x IN {rows.PRIMES}") + " / 6.0::DOUBLE", "prime_ratio"), _cnt(f"x NOT IN {rows.PRIMES}", "nonprime_count"),
        "len(list_distinct(list_transform(reds, lambda x: x % 10)))::INT AS unique_tails", f"greatest({', '.join(_TAILS)})::INT AS max_tail_freq", f"(greatest({', '.join(_TAILS)}) >= 3)::INT AS has_tail_triple", *[f"{t}::INT AS tail_{k}" for k, t in enumerate(_TAILS)],
        *[_cnt(f"x % {m} = {k}", f"mod{m}_{k}") for m in (4, 5, 6) for k in range(m)], *[_entropy(m) for m in (4, 5, 6)],
        _cnt("x < 17", "symmetry_left"), _cnt("x > 17", "symmetry_right"), _cnt("x = 17", "symmetry_center"), f"abs({_CNT.format('x < 17')} - {_CNT.format('x > 17')})::INT AS symmetry_diff", f"(abs({_CNT.format('x < 17')} - {_CNT.format('x > 17')}) <= 1)::INT AS symmetry_balanced",
        _ratio("reds[3] - reds[1]", "span_first_third"), _ratio("reds[6] - reds[4]", "span_last_third"), _ratio("reds[4] - reds[3]", "span_middle_ratio"),
        f"list_sum(list_transform(reds, lambda x: list_min(list_transform({_PRIME_LIST}, lambda p: abs(x - p)))))::INT AS prime_distance_sum", _r(f"list_sum(list_transform(reds, lambda x: list_min(list_transform({_PRIME_LIST}, lambda p: abs(x - p))))) / 6.0::DOUBLE", "prime_distance_mean"),
    ]
)
#: Runs by islands: neighbours share ball minus place.
_ISLANDS = """, islands AS (SELECT idx, g, count(*) AS len FROM (SELECT idx, ball, ball - row_number() OVER (PARTITION BY idx ORDER BY ball) AS g FROM balls) GROUP BY idx, g),
runs AS (SELECT idx, max(len) AS longest, count(*) FILTER (len >= 2) AS runs, sum(len - 1) AS pairs FROM islands GROUP BY idx)
"""
_MONEY = "CAST(prize AS BIGINT)"

QUERIES = {
    "S0_draw_table": draw_table, "S3_parse_record": parsed, "S5_summary": summary, "S11_parse_issue": parsed_issues, "S15_missing_issues": latest_and_missing, "P1_feature_vector": feature_vector, "P3_split_by_date": split_by_date, "K6_last_n": last_n,
    "F11_encode_draw": encode_draw, "F9_frequency_features": frequency_features, "F19_encode_draw_advanced": encode_draw_advanced, "F20_day_of_week": day_of_week, "F22_draw_order": draw_order_features, "F23_seasonal": seasonal, "D1_calendar": calendar, "S17_status": draw_status,
}
_RANK = "coalesce(nullif(list_position(draw_order, reds[{k}]), 0), {k})::INT"


def _zone_avg(a: int, b: int, name: str) -> str:
    own = f"list_transform(list_filter(reds, lambda x: x BETWEEN {a} AND {b}), lambda x: list_position(draw_order, x))"
    return _r(f"coalesce(list_avg({own}), 0.0::DOUBLE)", name)


_STEPS = "[" + ", ".join(f"abs(draw_order[{k + 1}] - draw_order[{k}])" for k in range(1, 6)) + "]"
_WEEK = "(month(draw_date) * 4.33::DOUBLE + day(draw_date) / 7.0::DOUBLE)"
SQL = {
    "S0_draw_table": SQL_DRAWS + "SELECT idx, draw_no, strftime(draw_date, '%Y-%m-%d') AS draw_date, weekday, array_to_string(reds, ' ') AS reds, array_to_string(draw_order, ' ') AS draw_order, blue, sales, jackpot, first_prize_count FROM draws",
    "S3_parse_record": SQL_DRAWS + "SELECT draw_no, strftime(draw_date, '%Y-%m-%d') AS draw_date, " + ", ".join(f"reds[{k}] AS r{k}" for k in range(1, 7)) + ", draw_order[1] AS first_ball, blue, sales, jackpot, first_prize_count, 0::BIGINT AS first_prize_money FROM draws",
    "S5_summary": SQL_DRAWS + "SELECT count(*) AS total, max(draw_no) AS newest, min(draw_no) AS oldest, strftime(min(draw_date), '%Y-%m-%d') AS first_date, strftime(max(draw_date), '%Y-%m-%d') AS last_date FROM draws",
    "S11_parse_issue": SQL_DRAWS + "SELECT draw_no::VARCHAR AS issue, strftime(draw_date, '%Y-%m-%d') AS open_date, weekday, array_to_string(list_transform(reds, lambda x: lpad(x::VARCHAR, 2, '0')), ' ') AS reds, lpad(blue::VARCHAR, 2, '0') AS blue, array_to_string(list_transform(draw_order, lambda x: lpad(x::VARCHAR, 2, '0')), ' ') AS draw_order, sales::VARCHAR AS sales, jackpot::VARCHAR AS jackpot, CASE WHEN draw_no % 5 = 0 THEN '0' ELSE first_prize_count::VARCHAR END AS first_prize_count, CASE WHEN draw_no % 5 = 0 THEN '0' ELSE (first_prize_count * 1000)::VARCHAR END AS first_prize_money FROM draws WHERE draw_no % 7 <> 0",
    "S15_missing_issues": SQL_DRAWS + "SELECT d.draw_no, row_number() OVER (ORDER BY d.draw_no) AS place, l.latest FROM draws d, (SELECT max(draw_no) AS latest FROM draws WHERE idx % 3 <> 0) l WHERE idx < 40 AND idx % 3 = 0",
    "P1_feature_vector": SQL_DRAWS + f"SELECT idx, p::INT AS place, CASE p WHEN 0 THEN list_sum(reds)::DOUBLE WHEN 1 THEN {_AC}::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE (CASE WHEN blue <= 4 THEN 0 WHEN blue <= 8 THEN 1 WHEN blue <= 12 THEN 2 ELSE 3 END)::DOUBLE END AS value FROM draws, range(4) t(p)",
    "P3_split_by_date": SQL_DRAWS + "SELECT idx, CASE WHEN draw_date > DATE '2010-01-01' THEN 'val' ELSE 'train' END AS role FROM draws",
    "K6_last_n": SQL_DRAWS + "SELECT idx, draw_no, blue FROM draws WHERE idx < 25",
    "F11_encode_draw": SQL_DRAWS + f"SELECT idx, {_BASIC} FROM draws",
    "F9_frequency_features": SQL_DRAWS + """, f AS (SELECT ball, count(*)::INT AS c FROM balls GROUP BY ball), fb AS (SELECT blue, count(*)::INT AS c FROM draws GROUP BY blue),
p AS (SELECT idx, avg(c) AS a, max(c) AS mx, min(c) AS mn, exp(sum(ln(c::DOUBLE / (6 * n)))) * 1e15 AS prod FROM balls JOIN f USING (ball), n_draws GROUP BY idx)
SELECT idx, round(a, 6) + 0.0 AS red_avg_freq, mx AS red_max_freq, mn AS red_min_freq, mx - mn AS red_freq_range, round(prod, 2) AS red_prob_product, round(fb.c::DOUBLE / n, 6) + 0.0 AS blue_freq FROM p JOIN draws USING (idx) JOIN fb USING (blue), n_draws""",
    "F19_encode_draw_advanced": SQL_DRAWS + _ISLANDS + f"SELECT idx, {_ADVANCED} FROM draws JOIN runs USING (idx)",
    "F20_day_of_week": SQL_DRAWS + "SELECT idx, k AS day_index, (k = 0)::INT AS is_sunday, (k = 1)::INT AS is_tuesday, (k = 2)::INT AS is_thursday, round(sin(2 * pi() * k / 3), 6) + 0.0 AS day_sin, round(cos(2 * pi() * k / 3), 6) + 0.0 AS day_cos FROM (SELECT idx, CASE weekday WHEN '周二' THEN 1 WHEN '周四' THEN 2 ELSE 0 END AS k FROM draws)",
    "F22_draw_order": SQL_DRAWS + "SELECT idx, " + ", ".join([*[_RANK.format(k=k) + f" AS order_pos_{k}" for k in range(1, 7)], _zone_avg(1, 11, "order_small_avg"), _zone_avg(12, 22, "order_mid_avg"), _zone_avg(23, 33, "order_large_avg"), "draw_order[1] AS first_ball_drawn", "draw_order[6] AS last_ball_drawn", "CASE WHEN draw_order[1] <= 11 THEN 0 WHEN draw_order[1] <= 22 THEN 1 ELSE 2 END AS first_ball_zone", f"list_max({_STEPS}) AS order_max_gap", _r(f"list_sum({_STEPS}) / 5.0::DOUBLE", "order_mean_gap"), f"list_min({_STEPS}) AS order_min_gap", "1 AS has_draw_order"]) + " FROM draws",
    "F23_seasonal": SQL_DRAWS + "SELECT idx, " + ", ".join([_r(f"{f}(2 * pi() * {x} / {n})", f"{name}_{f}") for name, x, n in (("month", "month(draw_date)", 12), ("quarter", "quarter(draw_date)", 4), ("week", _WEEK, 52)) for f in ("sin", "cos")]) + ", month(draw_date)::INT AS month_raw, quarter(draw_date)::INT AS quarter_raw FROM draws",
    "S17_status": SQL_DRAWS + "SELECT count(*) AS total, max(draw_no) AS latest, (max(draw_date) - min(draw_date))::INT AS days_covered, (DATE '2100-01-01' - max(draw_date))::INT AS days_since, ((DATE '2100-01-01' - max(draw_date)) // 2)::BIGINT AS missed FROM draws",
    "D1_calendar": SQL_DRAWS + """, days AS (SELECT idx, (draw_date + (idx % 7)::INT)::DATE AS d FROM draws)
SELECT idx, strftime(d, '%Y-%m-%d') AS d, dayofweek(d) IN (0, 2, 4) AS is_draw_day, strftime(d - list_filter(range(7), lambda k: dayofweek(d - k::INT) IN (0, 2, 4))[1]::INT, '%Y-%m-%d') AS last_draw,
  strftime(d + list_filter(range(1, 8), lambda k: dayofweek(d + k::INT) IN (0, 2, 4))[1]::INT, '%Y-%m-%d') AS next_draw, (21 * 3600 + 15 * 60 - (idx % 24) * 3600 - (idx % 60) * 60)::BIGINT AS seconds_until FROM days""",
}
