"""Quality rules as a ledger: every rule once per document, failures as bits beside the measurements.

Policies are versioned masks over the bits; a verdict is a bitwise test, and what a rule alone decides
(its ablation) is counted from the ledger by one aggregation, without measuring again. All of it is
built-in functions of one row, so nothing is shuffled but the sums of the ablation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8  # words


@dataclass(frozen=True)
class Rule:
    """A document fails if `when` holds; null counts as not failed. A rule's bit is its place in RULES."""

    name: str
    when: str


#: New rules go to the end, so that bits of stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("no_letters", "2 * n_letters < word_chars"),
)
#: Rules that a policy rejects by, by version; the base rules are the first two.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "no_letters"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def mask(policy: str, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    bits = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << bits[n] for n in policies[policy])


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text, the first time included.

    Windows are told apart by a 64-bit hash. Sorted with their places, equal ones are neighbours; the
    places of repeated windows, sorted again, cover words up to the next place or the window's end.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (window - 1))
    hashes = F.transform(starts, lambda k: F.xxhash64(F.slice(words, k, F.lit(window))))

    def covered(hs: Column) -> Column:
        tagged = F.array_sort(F.transform(hs, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def places(s: Column) -> Column:
            def marked(x: Column, k: Column) -> Column:
                same = (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
                return F.when(F.coalesce(same, F.lit(False)), x["k"])

            return F.array_sort(F.filter(F.transform(s, marked), lambda k: k.isNotNull()))

        def cover(ks: Column) -> Column:
            return F.aggregate(ks, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")), lambda a, k: F.struct((a["n"] + F.lit(window) - F.greatest(F.lit(0), a["end"] - k)).alias("n"), (k + window).alias("end")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_let(_let(tagged, places), cover))

    return F.when(n < window, F.lit(0)).otherwise(_let(hashes, covered)).cast("long")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *MEASURES) of every whole text; null counts as empty, which measures 0 everywhere."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).select(id_col, text.alias("text"))

    def without(pattern: str) -> Column:
        return F.char_length(F.regexp_replace("text", pattern, ""))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = bare.select(
        id_col,
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        without(SPACE).cast("long").alias("word_chars"),
        (F.char_length("text") - without(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.char_length("text") - without(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.char_length("text") - without(r"\p{L}")).cast("long").alias("n_letters"),
    )
    return split.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        "n_upper",
        "n_letters",
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *MEASURES, failed): bit k of `failed` is set if rule k of RULES fails. One row for each
    input row, repeated ids included; an empty table gives an empty ledger; other columns are not read."""
    bits = [F.when(F.expr(r.when), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(df, id_col, text_col).withColumn("failed", failed)


def verdicts(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy. `kept` is false where a base rule fails."""
    base, own = F.lit(mask("base")), F.lit(mask(policy) | mask("base"))
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0).withColumn("kept", F.col("failed").bitwiseAND(own) == 0)


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(policy, rule, n_failed, n_alone, n_kept, n_kept_without) for each rule of the policy: documents
    that fail it, that fail it alone, that the policy keeps, and that it would keep without the rule.
    One pass over the ledger; an empty ledger counts 0."""
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    names = POLICIES[policy]
    at = {r.name: 1 << k for k, r in enumerate(RULES)}
    sums = [F.count_if(own == 0).alias("kept")]
    for n in names:
        sums += [F.count_if(own.bitwiseAND(F.lit(at[n])) != 0).alias(f"failed_{n}"), F.count_if(own == F.lit(at[n])).alias(f"alone_{n}")]
    total = rows.agg(*sums)
    per = F.explode(F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("n_failed"), F.col(f"alone_{n}").alias("n_alone"), F.col("kept").alias("n_kept"), (F.col("kept") + F.col(f"alone_{n}")).alias("n_kept_without")) for n in names])).alias("x")
    return total.select(per).select("x.*")


_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LEDGER_SQL = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, r, t, {_WORDS} AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM texts),
windows AS (
  SELECT r, unnest(range(1, len(ws) - 6)) AS k, ws FROM split WHERE len(ws) >= 8),
hashed AS (SELECT r, k, array_to_string(ws[k:k+7], ' ') AS h FROM windows),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, h) AS n FROM hashed) WHERE n > 1),
covered AS (
  SELECT r, sum(least(8, coalesce(nxt - k, 8))) AS n
  FROM (SELECT r, k, lead(k) OVER (PARTITION BY r ORDER BY k) AS nxt FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
         (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::BIGINT AS n_letters
  FROM split LEFT JOIN covered c USING (r)),
ledger AS (
  SELECT *, ({" | ".join(f"(CASE WHEN {r.when} THEN {1 << k} ELSE 0 END)" for k, r in enumerate(RULES))})::BIGINT AS failed
  FROM measured)
"""
SQL = rf"""{_LEDGER_SQL}SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
       (failed & {mask("base")}) <> 0 AS base_failed, (failed & {mask(CURRENT) | mask("base")}) = 0 AS kept
FROM ledger
"""
#: Every rule left out in turn: the policy's mask without its bit, applied to the ledger anew.
ABLATIONS_SQL = rf"""{_LEDGER_SQL}SELECT '{CURRENT}' AS policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & {mask(CURRENT)} = bit) AS n_alone,
       count(*) FILTER (failed & {mask(CURRENT)} = 0) AS n_kept, count(*) FILTER (failed & ({mask(CURRENT)} - bit) = 0) AS n_kept_without
FROM ledger, (VALUES {", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(RULES) if r.name in POLICIES[CURRENT])}) AS rules(rule, bit) GROUP BY rule
"""
