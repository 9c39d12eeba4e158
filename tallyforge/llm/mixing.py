"""Mixing sources to target weights: budgets down a domain-language-source tree, then token prefixes.

Each node's budget is split among its children by weight. A child that has less than its share is
short; what it can't use goes to its siblings that have more, by weight, until none is left or all are
full, and only then to the node's own siblings (water filling, from the root down; a node's supply is
the sum below it, so what a subtree can't use is known before it is offered). A leaf's supply is its
tokens times the most epochs. A leaf then takes its documents in seeded orders, one for each epoch,
until its budget is spent: whole epochs first, then a prefix of the next.

Prefix sums don't gather a leaf in one task: documents fall into ranges of their seeded order, the
ranges' sums are added up first, and only the range in which the budget ends needs sorting by document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Ranges of a leaf's seeded order; the longest sort has a leaf's documents over RANGES rows. Their sums
#: are added up in groups of GROUP, then the groups' sums, so no window has more than GROUP rows.
RANGES, GROUP = 4096, 64
MAX_EPOCHS = 4
#: Target weights by level; a value that is not listed weighs 1.
WEIGHTS = {"domain": {"web": 3.0, "reference": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src0": 0.5}}
#: A budget of half the supply of one epoch.
SHARE = (1, 2)
SEED = 17
LEVELS = ("domain", "lang", "source")
REFERENCE_SOURCES = ("src1", "src2", "src3", "src4")


def n_words(text: Column) -> Column:
    """Words of a text; null has none: runs of other than white space, each left as one letter."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.char_length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def leaves(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, domain, lang, source, n_tokens and the document's place in the seeded order (pos, tie by id)."""
    source = F.coalesce(F.col(source_col), F.lit(""))
    domain = F.when(source.isin(*REFERENCE_SOURCES), F.lit("reference")).otherwise(F.lit("web"))
    return df.select(F.col(id_col).alias("id"), domain.alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), source.alias("source"), n_words(F.col(text_col)).alias("n_tokens"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    own = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        own = F.when(F.col(level) == name, F.lit(float(w))).otherwise(own)
    return own


def checked(weights: dict[str, dict[str, float]]) -> None:
    """Weights are finite and not negative; 0 leaves a node out, with all that lies below it."""
    for level, own in weights.items():
        for name, w in own.items():
            if level not in LEVELS or w is None or not 0 <= w < math.inf:
                raise ValueError(f"weight {w!r} of {level} {name!r}")


def _fill(df: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """Adds `budget` of each child from `given` of its parent, by water filling: in order of supply for
    its weight, a child is full if the level of water at its height needs no more than is given."""
    w = _weight(level, weights)
    rows = df.withColumn("w", w).withColumn("height", F.coalesce(F.try_divide("supply", "w"), F.lit(0.0)))
    order = Window.partitionBy(*parent).orderBy("height", level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"full_before": F.coalesce(F.sum("supply").over(before), F.lit(0)), "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("level_here", F.try_divide(F.col("given") - F.col("full_before"), "w_left"))
    full = (F.col("w") == 0) | (F.col("level_here") >= F.col("height"))
    # Of the children that are not full, the first one's level of water holds for all.
    rows = rows.withColumn("water", F.first(F.when(~full, F.col("level_here")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    budget = F.when(full, F.col("supply")).otherwise(F.least(F.floor(F.col("water") * F.col("w")).cast("long"), F.col("supply")))
    return rows.withColumn("budget", budget)


def budgets(docs: DataFrame, weights: dict, max_epochs: int, total: int | None, share: tuple[int, int]) -> DataFrame:
    """(domain, lang, source, n_tokens, budget): a row for each leaf."""
    leaf = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"))
    wanted = F.least(*[_weight(level, weights) for level in LEVELS]) > 0
    leaf = leaf.withColumn("supply", F.when(wanted, F.col("n_tokens") * F.lit(max_epochs).cast("long")).otherwise(F.lit(0).cast("long")))
    by_lang = leaf.groupBy("domain", "lang").agg(F.sum("supply").alias("supply"))
    by_domain = leaf.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("n_tokens").alias("n_tokens")).withColumn("root", F.lit(1))
    every = F.sum("n_tokens").over(Window.partitionBy("root"))
    given = F.lit(total).cast("long") if total is not None else F.floor(every * share[0] / share[1]).cast("long")
    top = _fill(by_domain.withColumn("given", given), ["root"], "domain", weights).select("domain", F.col("budget").alias("given"))
    mid = _fill(by_lang.join(top, "domain"), ["domain"], "lang", weights).select("domain", "lang", F.col("budget").alias("given"))
    return _fill(leaf.join(mid, ["domain", "lang"]), ["domain", "lang"], "source", weights).select(*LEVELS, "n_tokens", "budget")


def mix(df: DataFrame, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, total: int | None = None, share: tuple[int, int] = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, domain, lang, source, n_tokens, epochs, budget): every document and how often it is taken.

    A document is taken in an epoch if it begins before its leaf's budget ends, so a leaf ends within
    its last document and passes its budget by less than that. 0 epochs: not taken. Documents without
    words cost nothing and are taken as often as their place is reached. Null language or source is
    "", null text has no words; repeated rows follow one another; an empty table is empty.
    `total` tokens are shared out, or `share` of the supply of one epoch if it is null. A weight of 0
    leaves a node out, and its documents have 0 epochs; negative, null or infinite weights raise
    ValueError. The tree (leaves with their sums) is taken to be small beside the documents: siblings
    meet in one task, a row each. Texts may be of any length; further columns are not read.
    """
    checked(weights)
    docs = leaves(df, id_col, text_col, lang_col, source_col)
    plan = budgets(docs, weights, max_epochs, total, share)
    # Whole epochs, and what is left for the next one. Its order is that epoch's own.
    plan = plan.withColumn("whole", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("n_tokens")).withColumnRenamed("n_tokens", "leaf_tokens")
    # Written, the plan has a known size: Spark broadcasts it below its threshold and else shuffles.
    rows = docs.join(written(plan, "mixing-plan"), list(LEVELS))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("pos", key).withColumn("range", F.shiftright("pos", 48 - RANGES.bit_length() + 1).cast("int"))
    sums = rows.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("range_tokens"))
    sums = sums.withColumn("group", F.floor(F.col("range") / GROUP).cast("int"))

    def started(df: DataFrame, value: str, name: str, order: str, *keys: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))

    groups = started(sums.groupBy(*LEVELS, "group").agg(F.sum("range_tokens").alias("group_tokens")), "group_tokens", "group_start", "group", *LEVELS)
    sums = started(sums, "range_tokens", "within", "range", *LEVELS, "group").join(groups, [*LEVELS, "group"])
    rows = rows.join(sums.select(*LEVELS, "range", (F.col("group_start") + F.col("within")).alias("range_start")), [*LEVELS, "range"])
    own = Window.partitionBy(*LEVELS, "range").orderBy("pos", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("range_start") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    epochs = F.col("whole") + F.when(F.col("start") < F.col("rest"), F.lit(1)).otherwise(F.lit(0))
    return rows.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", epochs.cast("long").alias("epochs"), "budget")


def _case(level: str, weights: dict) -> str:
    return "CASE " + level + "".join(f" WHEN '{n}' THEN {w}::DOUBLE" for n, w in weights.get(level, {}).items()) + " ELSE 1.0::DOUBLE END" if weights.get(level) else "1.0::DOUBLE"


def _fill_sql(name: str, source: str, parent: str, level: str) -> str:
    return f"""
{name}_w AS (SELECT *, {_case(level, WEIGHTS)} AS w, supply / ({_case(level, WEIGHTS)}) AS height FROM {source}),
{name}_a AS (SELECT *, coalesce(sum(supply) OVER (PARTITION BY {parent} ORDER BY height, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(w) OVER (PARTITION BY {parent} ORDER BY height, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM {name}_w),
{name}_b AS (SELECT *, (given - full_before)::DOUBLE / w_left AS lv FROM {name}_a),
{name}_c AS (SELECT *, lv >= height AS is_full, first_value(CASE WHEN lv < height THEN lv END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY height, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS water FROM {name}_b),
{name} AS (SELECT *, CASE WHEN is_full THEN supply ELSE least(floor(water * w)::BIGINT, supply) END AS budget FROM {name}_c)"""


SQL = rf"""
WITH docs AS (
  SELECT doc_id AS id, CASE WHEN coalesce(source, '') IN {REFERENCE_SOURCES} THEN 'reference' ELSE 'web' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n_tokens, (sum(n_tokens) * {MAX_EPOCHS})::BIGINT AS supply FROM docs GROUP BY ALL),
dom AS (SELECT domain, 1 AS root, sum(supply)::BIGINT AS supply, floor(sum(sum(n_tokens)) OVER () * {SHARE[0]} / {SHARE[1]})::BIGINT AS given FROM leaf GROUP BY domain),
{_fill_sql("f1", "dom", "root", "domain")},
lng AS (SELECT l.domain, l.lang, sum(l.supply)::BIGINT AS supply, any_value(f1.budget) AS given FROM leaf l JOIN f1 USING (domain) GROUP BY ALL),
{_fill_sql("f2", "lng", "domain", "lang")},
lvs AS (SELECT l.*, f2.budget AS given FROM leaf l JOIN f2 USING (domain, lang)),
{_fill_sql("f3", "lvs", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, n_tokens AS leaf_tokens, budget, CASE WHEN n_tokens > 0 THEN floor(budget / n_tokens)::BIGINT ELSE 0 END AS whole FROM f3),
placed AS (SELECT d.*, p.budget, p.whole, p.budget - p.whole * p.leaf_tokens AS rest, substr(md5('{SEED}:' || p.whole || ':' || coalesce(d.id::VARCHAR, '')), 1, 12) AS pos FROM docs d JOIN plan p USING (domain, lang, source)),
started AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY pos, id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)
SELECT id AS doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN start < rest THEN 1 ELSE 0 END)::BIGINT AS epochs, budget::BIGINT AS budget FROM started
"""
