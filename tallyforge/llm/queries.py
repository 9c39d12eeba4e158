"""Queries of this subpackage by name: (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, divergence, jaccard, langid, media, mixing, pii, piece_codec, quality, token_count, turns, urlfilter, warc

PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).drop("redacted")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(quality.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "base_failed", "kept")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy decides alone, counted from the ledger of op3."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(chat.with_hard_case(spark, _table(spark, sf_dir, "conversations")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("VALUES " + ", ".join(map(str, urlfilter.CONTRACT_RULES)) + " AS rules(host, path, action)")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.summaries(turns.damaged(_table(spark, sf_dir, "conversations")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_and_read(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_jaccard, op3_quality, op4_token_count, op5_chat, op6_mixing, op7_urls, op8_piece_codec, op9_media, op10_langid, op11_divergence, op12_turns, op13_warc, quality_ablations)}
SQL = {"op3_quality": quality.SQL, "quality_ablations": quality.ABLATIONS_SQL, "op5_chat": chat.SQL, "op6_mixing": mixing.SQL, "op7_urls": urlfilter.SQL, "op11_divergence": divergence.SQL, "op12_turns": turns.SQL, "op13_warc": warc.SQL}
