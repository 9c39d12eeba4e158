"""URL rules: a blocked Bloom filter of the listed keys, then an exact hash join of its hits.

A rule's canonical key is its host and path. A url's possible keys are the suffixes of its host with
the beginnings of its path that are as long as some listed path. The filter is a row of 64-bit words;
a key sets BITS bits of one word. It is built by one bitwise aggregation, its size is BLOCKS words
whatever the list, and what it passes is joined with the list itself, so no verdict rests on a false
positive. Rules of one key are taken once (block before allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6
#: Words of 8 bytes that a filter may have as a literal.
LITERAL = 1 << 16
#: A list of at most so many bytes of keys is broadcast to the exact join; a longer one is shuffled.
BROADCAST_BYTES = 8 << 20

CONTRACT_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(rest, r"^[^/]*", 0)
    path = F.coalesce(F.substr(rest, F.char_length(host) + 1), F.lit(""))
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), path


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _bits(h: Column) -> Column:
    word = F.lit(0).cast("long")
    for k in range(BITS):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 8 + 9 * k).bitwiseAND(F.lit(63)).cast("int")))
    return word


def bloom(keys: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """(block, word) of the filter of all keys; words without a bit are left out."""
    h = _hash(F.col(key_col))
    return keys.select(_block(h, blocks).alias("block"), _bits(h).alias("w")).groupBy("block").agg(F.bit_or("w").alias("word"))


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; `rules` has host, path, action.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule
    wins (then the longest host). Without one, `rule` is null and `verdict` the default. Rules with a
    null in any column and null urls fit nothing; an empty list fits nothing. Rows stay rows, equal ones
    too; an empty table is empty; other columns are not read.
    """
    listed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
    listed = listed.groupBy(F.concat("host", F.lit("\n"), "path").alias("key")).agg(F.max("action").alias("action"))
    sizes = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.lit(64)), F.lit(0)).alias("bytes"), F.collect_set(F.char_length(F.split("key", "\n")[1])).alias("lengths")).first()
    blocks = max(1, sizes["n"])
    filled = bloom(listed, "key", blocks)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    lengths = F.array(*[F.lit(n) for n in sorted(sizes["lengths"])]).cast("array<int>")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    begins = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keys = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda p: F.concat(s, F.lit("\n"), p)))))

    def passes(word: Column, key: Column) -> Column:
        bits = _bits(_hash(key))
        return F.coalesce(word, F.lit(0)).bitwiseAND(bits) == bits

    exact = F.broadcast(listed) if sizes["bytes"] <= BROADCAST_BYTES else listed
    rank = F.when(F.col("action").isNotNull(), F.struct(F.char_length("key").alias("n"), F.char_length(F.split("key", "\n")[0]).alias("h"), "key", "action"))
    if blocks <= LITERAL:
        words = [0] * blocks
        for r in filled.collect():  # LITERAL rows at most
            words[r["block"]] = r["word"]
        # One text that the optimizer folds into one literal array.
        literal = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        sieved = rows.withColumn("hits", F.filter(keys, lambda key: passes(F.get(literal, _block(_hash(key), blocks)), key)))
        none, some = (sieved.where((F.coalesce(F.size("hits"), F.lit(0)) > 0) == hit) for hit in (False, True))
        met = some.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.explode("hits")).join(exact, "key", "left")
        out = met.groupBy("row", "id", "host", "path").agg(F.max(rank).alias("best"))
        out = out.select("id", "host", "path", "best").unionByName(none.select("id", "host", "path", F.lit(None).cast(out.schema["best"].dataType).alias("best")))
    else:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        asked = rows.select("row", F.explode(keys).alias("key")).withColumn("block", _block(_hash(F.col("key")), blocks))
        hit = asked.join(filled, "block").where(passes(F.col("word"), F.col("key"))).join(exact, "key")
        out = rows.join(hit.groupBy("row").agg(F.max(rank).alias("best")), "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.translate("best.key", "\n", "").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


SQL = r"""
WITH rules(rhost, rpath, action) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*', 0) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(r, length(regexp_extract(r, '^[^/]*', 0)) + 1) AS path FROM rest),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(action, length(rhost) + length(rpath)) AS action
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
"""
