"""The corpus pipeline: five stages over documents, each over all that the one before it kept.

Every stage takes a table with the columns of documents, reads no others (they may have any name), takes
an empty table to an empty one, and treats rows with equal ids or equal texts as the rows they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import jaccard, langid, mixing, pii, piece_codec
from tallyforge.llm.shared import removed, written
from tallyforge.llm.texts import BATCH_BYTES, BATCH_SETTING

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its text has no language or its calibrated score is below this; of few languages
#: even the least certain one scores more, so what goes is what the model can't place at all.
LEAST_SCORE = 0.35
#: Weights of the tree are those of mixing.WEIGHTS; this many epochs of a source at most, and a budget
#: of the whole supply of one epoch.
EPOCHS, SHARE = 4, (1, 1)


def _bounded(spark: SparkSession) -> None:
    """Stages whose jobs run only when their result is read leave the session with small Arrow batches,
    unless it has a bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; `lang` becomes the prediction. A null text, an empty
    one and one without a letter have no language and go. A null `lang` teaches nothing; where all are
    null nothing can be identified and nothing stays."""
    _bounded(spark)
    found = langid.identify(docs, keep=("text", "lang", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links at five words and a similarity of 0.8: the one of the
    least id. Texts without words (null ones too) are groups of one; rows with a null id stay; repeated
    rows of the id that stays all stay."""
    return jaccard.one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the spans that are found; every document stays. A null text stays null, with null n_chars."""
    _bounded(spark)
    found = pii.find(docs, keep=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their weights: a row for each epoch. Rows of one
    id are taken as often as the one of them that is taken most; null `lang` or `source` is a leaf of
    its own, a null text costs nothing, a null id is one document like any other."""
    epochs = mixing.mix(docs, max_epochs=EPOCHS, share=SHARE).where("epochs > 0").groupBy("doc_id").agg(F.max("epochs").alias("epochs"))
    epochs = epochs.withColumnRenamed("doc_id", "taken")
    rows = docs.select(*COLUMNS).join(epochs, F.col("doc_id").eqNullSafe(F.col("taken")))
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("epoch")).drop("epoch")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each text that is taken; a null text has no ids."""
    _bounded(spark)
    found = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing to target weights", mixture), ("piece encoding", pieces)]

#: Language identification, the trees of the third stage and the encoder are not SQL; the tests hold
#: each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
            if k:
                removed(spark, before)
    return docs
