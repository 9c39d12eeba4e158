"""Features of one draw as columns over `reds` (sorted), `blue` and the draw's other fields.

All are built-in expressions, so a wide select stays one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Primes up to 33.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)
# Weekday names and their index; any other name counts as 0.
DAY_INDEX = {"周日": 0, "周二": 1, "周四": 2, "Sunday": 0, "Tuesday": 1, "Thursday": 2, "星期日": 0, "星期二": 1, "星期四": 2}

Columns = dict[str, Column]


def _reds(reds: str | Column) -> Column:
    return F.col(reds) if isinstance(reds, str) else reds


def _count(reds: Column, test) -> Column:
    return F.size(F.filter(reds, test))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _int(test: Column) -> Column:
    return test.cast("int")


def _between(a: int, b: int):
    return lambda x: x.between(a, b)


def _residue(modulus: int, k: int):
    return lambda x: x % modulus == k


def gaps(reds: Column) -> Column:
    return F.zip_with(F.slice(reds, 2, 5), F.slice(reds, 1, 5), lambda a, b: a - b)


def numeric(reds: str | Column = "reds") -> Columns:
    r = _reds(reds)
    total = _sum(r)
    mean = total / 6.0
    at = [F.get(r, k) for k in range(6)]
    variance = sum(((x - mean) * (x - mean) for x in at[1:]), (at[0] - mean) * (at[0] - mean)) / 6.0
    return {"sum": total, "mean": mean, "median": (at[2] + at[3]) / 2.0, "min": at[0], "max": at[5], "span": at[5] - at[0], "std": F.sqrt(variance)}


def parity(reds: str | Column = "reds") -> Columns:
    odd = _count(_reds(reds), lambda x: x % 2 == 1)
    return {"odd_count": odd, "even_count": 6 - odd, "odd_ratio": odd / 6.0}


def zones(reds: str | Column = "reds") -> Columns:
    r = _reds(reds)
    return {n: _count(r, _between(a, b)) for n, a, b in (("zone_small", 1, 11), ("zone_mid", 12, 22), ("zone_large", 23, 33))}


def mod3(reds: str | Column = "reds") -> Columns:
    r = _reds(reds)
    return {f"mod3_{k}": _count(r, _residue(3, k)) for k in range(3)}


def gap_features(reds: str | Column = "reds") -> Columns:
    r = _reds(reds)
    g = gaps(r)
    return {"max_gap": F.array_max(g), "min_gap": F.array_min(g), "mean_gap": (F.get(r, 5) - F.get(r, 0)) / 5.0, "gap_range": F.array_max(g) - F.array_min(g)}


def ac_value(reds: str | Column = "reds") -> Column:
    """Distinct pairwise differences less five."""
    r = _reds(reds)
    at = [F.get(r, k) for k in range(6)]
    return F.size(F.array_distinct(F.array(*[at[j] - at[i] for i in range(6) for j in range(i + 1, 6)]))) - 5


def positional(reds: str | Column = "reds") -> Columns:
    r = _reds(reds)
    return {f"pos_{k + 1}": F.get(r, k) for k in range(6)}


def blue_features(blue: str = "blue") -> Columns:
    b = F.col(blue)
    return {"blue": b, "blue_parity": b % 2, "blue_mod3": b % 3, "blue_zone": F.when(b <= 4, 0).when(b <= 8, 1).when(b <= 12, 2).otherwise(3)}


def basic() -> Columns:
    """The 31 basic columns of a draw."""
    named = {f"red_{k}": v for part in (numeric(), parity(), zones(), mod3(), gap_features()) for k, v in part.items()}
    return {**named, "red_ac": ac_value(), **positional(), **blue_features()}


def frequency(red_counts: str = "red_counts", blue_counts: str = "blue_counts", total: str = "total") -> Columns:
    """Features over arrays of counts by ball (index 0: ball 1) and the number of draws."""
    own = F.transform("reds", lambda b: F.coalesce(F.get(F.col(red_counts), b - 1), F.lit(0)))
    most = F.greatest(F.col(total) * 6, F.lit(1)).cast("double")
    product = F.aggregate(own, F.lit(1.0), lambda a, x: a * (x / most)) * F.lit(1e15)
    return {
        "red_avg_freq": _sum(F.transform(own, lambda x: x.cast("int"))) / 6.0,
        "red_max_freq": F.array_max(own),
        "red_min_freq": F.array_min(own),
        "red_freq_range": F.array_max(own) - F.array_min(own),
        "red_prob_product": product,
        "blue_freq": F.coalesce(F.get(F.col(blue_counts), F.col("blue") - 1), F.lit(0)) / F.greatest(F.col(total), F.lit(1)).cast("double"),
    }


def consecutive(reds: str | Column = "reds") -> Columns:
    """Runs of neighbours, by a fold over the gaps that keeps the run at hand, the longest and the number."""
    g = gaps(_reds(reds))
    start = F.struct(F.lit(1).alias("run"), F.lit(1).alias("longest"), F.lit(0).alias("runs"), F.lit(0).alias("pairs"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == 1, a["run"] + 1).otherwise(1)
        return F.struct(run.alias("run"), F.greatest(a["longest"], run).alias("longest"), (a["runs"] + _int((x == 1) & (a["run"] == 1))).alias("runs"), (a["pairs"] + _int(x == 1)).alias("pairs"))

    f = F.aggregate(g, start, step)
    return {"consecutive_pairs": f["pairs"], "max_consecutive_run": f["longest"], "has_double_consecutive": _int(f["runs"] >= 2), "triple_consecutive": _int(f["longest"] >= 3), "consecutive_run_count": f["runs"]}


def prime(reds: str | Column = "reds") -> Columns:
    n = _count(_reds(reds), lambda x: x.isin(*PRIMES))
    return {"prime_count": n, "prime_ratio": n / 6.0, "nonprime_count": 6 - n}


def tail(reds: str | Column = "reds") -> Columns:
    r = _reds(reds)
    counts = {f"tail_{t}": _count(r, _residue(10, t)) for t in range(10)}
    most = F.greatest(*counts.values())
    return {"unique_tails": F.size(F.array_distinct(F.transform(r, lambda x: x % 10))), "max_tail_freq": most, "has_tail_triple": _int(most >= 3), **counts}


def mod_extended(reds: str | Column = "reds") -> Columns:
    """Residue counts for 4, 5 and 6 and their entropy over ln(modulus); empty residues add nothing."""
    r, out = _reds(reds), {}
    for m in (4, 5, 6):
        counts = [_count(r, _residue(m, k)) for k in range(m)]
        out |= {f"mod{m}_{k}": c for k, c in enumerate(counts)}
        terms = [c / 6.0 * F.ln(F.greatest(c.cast("double"), F.lit(0.001)) / 6.0) for c in counts]
        out[f"mod{m}_entropy"] = -sum(terms[1:], terms[0]) / math.log(m)
    return out


def symmetry(reds: str | Column = "reds", center: int = 17) -> Columns:
    r = _reds(reds)
    left, right = _count(r, lambda x: x < center), _count(r, lambda x: x > center)
    return {"symmetry_left": left, "symmetry_right": right, "symmetry_center": 6 - left - right, "symmetry_diff": F.abs(left - right), "symmetry_balanced": _int(F.abs(left - right) <= 1)}


def span_ratios(reds: str | Column = "reds") -> Columns:
    at = [F.get(_reds(reds), k) for k in range(6)]
    span = at[5] - at[0]
    parts = {"span_first_third": at[2] - at[0], "span_last_third": at[5] - at[3], "span_middle_ratio": at[3] - at[2]}
    return {n: F.when(span == 0, 0.0).otherwise(F.try_divide(p, span)) for n, p in parts.items()}


def prime_gaps(reds: str | Column = "reds") -> Columns:
    near = F.array(*[F.lit(min(abs(b - p) for p in PRIMES)) for b in range(1, 34)])  # by ball, from the primes
    total = _sum(F.transform(_reds(reds), lambda x: F.get(near, x - 1)))
    return {"prime_distance_sum": total, "prime_distance_mean": total / 6.0}


def advanced() -> Columns:
    return {k: v for part in (consecutive(), prime(), tail(), mod_extended(), symmetry(), span_ratios(), prime_gaps()) for k, v in part.items()}


def day_of_week(weekday: str = "weekday") -> Columns:
    known = F.create_map(*[F.lit(x) for kv in DAY_INDEX.items() for x in kv])
    k = F.coalesce(F.try_element_at(known, F.coalesce(F.col(weekday), F.lit(""))), F.lit(0))
    return {"day_index": k, "is_sunday": _int(k == 0), "is_tuesday": _int(k == 1), "is_thursday": _int(k == 2), "day_sin": F.sin(k * (2 * math.pi / 3)), "day_cos": F.cos(k * (2 * math.pi / 3))}


def financial() -> Columns:
    """Over sales, jackpot and the window's sales_mean, sales_std, jackpot_mean, jackpot_std (nullable)."""

    def score(x: str) -> Column:
        return F.when(F.col(f"{x}_std") > 0, (F.col(x) - F.col(f"{x}_mean")) / F.col(f"{x}_std")).otherwise(0.0)

    sales, jackpot = (F.coalesce(F.col(c), F.lit(0)) for c in ("sales", "jackpot"))
    return {"sales_raw": sales, "jackpot_raw": jackpot, "sales_zscore": F.coalesce(score("sales"), F.lit(0.0)), "jackpot_zscore": F.coalesce(score("jackpot"), F.lit(0.0)), "jackpot_sales_ratio": F.when(sales > 0, jackpot / sales).otherwise(0.0)}


def draw_order(order: str = "draw_order", reds: str = "reds") -> Columns:
    """Null but for has_draw_order = 0 where the order isn't six long."""
    o, r = F.col(order), F.col(reds)
    whole = F.coalesce(F.size(o) == 6, F.lit(False))
    rank = lambda b, k: F.coalesce(F.nullif(F.array_position(o, b).cast("int"), F.lit(0)), F.lit(k))
    out = {f"order_pos_{k + 1}": rank(F.get(r, k), k + 1) for k in range(6)}
    for name, a, b in (("small", 1, 11), ("mid", 12, 22), ("large", 23, 33)):
        own = F.filter(F.filter(r, _between(a, b)), lambda x: F.array_position(o, x) > 0)
        out[f"order_{name}_avg"] = F.when(F.size(own) > 0, F.aggregate(own, F.lit(0), lambda s, x: s + F.array_position(o, x).cast("int")) / F.size(own)).otherwise(0.0)
    first = F.get(o, 0)
    steps = F.zip_with(F.slice(o, 2, 5), F.slice(o, 1, 5), lambda a, b: F.abs(a - b))
    out |= {"first_ball_drawn": first, "last_ball_drawn": F.get(o, 5), "first_ball_zone": F.when(first <= 11, 0).when(first <= 22, 1).otherwise(2), "order_max_gap": F.array_max(steps), "order_mean_gap": _sum(steps) / 5.0, "order_min_gap": F.array_min(steps)}
    return {**{n: F.when(whole, c) for n, c in out.items()}, "has_draw_order": _int(whole)}


def seasonal(date: str = "draw_date") -> Columns:
    """Without a date: four zeros, the rest null."""
    d = F.col(date)
    month, quarter = F.month(d), F.quarter(d)
    week = month * F.lit(4.33) + F.dayofmonth(d) / 7.0
    turn = lambda x, n: x * (2 * math.pi / n)
    out = {"month_sin": F.sin(turn(month, 12)), "month_cos": F.cos(turn(month, 12)), "quarter_sin": F.sin(turn(quarter, 4)), "quarter_cos": F.cos(turn(quarter, 4))}
    return {**{n: F.coalesce(c, F.lit(0.0)) for n, c in out.items()}, "week_sin": F.sin(turn(week, 52)), "week_cos": F.cos(turn(week, 52)), "month_raw": month, "quarter_raw": quarter}


def simple() -> Columns:
    """What the sequence operators follow."""
    return {"sum": _sum(F.col("reds")), "span": F.get(F.col("reds"), 5) - F.get(F.col("reds"), 0), "odd_count": parity()["odd_count"], "ac": ac_value(), "blue": F.col("blue")}


def rounded(columns: Columns, doubles: set[str] | None = None) -> list[Column]:
    """Columns under their names, doubles to six places and without a negative zero."""
    return [(F.round(c, 6) + 0.0).alias(n) if doubles is None or n in doubles else c.alias(n) for n, c in columns.items()]
