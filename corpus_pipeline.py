"""A corpus pipeline over ``documents``: language, near copies, benchmark leaks, secrets, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame; what one returns is written as Parquet and
read again as the docs of the next. All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import bpe_codec, decontam, lang_id, secrets, simhash
from gradelake.llm.common import small_batches, table, written
from gradelake.llm.queries import VOCABULARY

MASK = "[SECRET]"


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or not one letter) go; ``lang`` becomes what the text says.

    Profiles are learned from the rows themselves that name a language; of two languages as
    near, the first by name is taken. Nulls in other columns, repeated rows, long texts and
    columns of any name are kept as they are; an empty table, or one that names no language,
    gives no rows.
    """
    small_batches(spark)
    judged = lang_id.identify(docs, lang_id.language_profiles(docs))
    kept = judged.where(F.col("lang_pred") != lang_id.UNKNOWN).withColumn("lang", F.col("lang_pred"))
    return kept.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: proposed by SimHash, an exact Jaccard similarity of 0.8 in five words.

    Documents without an id stay; null and empty texts are equal to each other, so one of them
    stays. Of a group the smallest id stays; rows that repeat id and text stay once. Texts are
    compared over their whole length, an empty table gives none, and columns of any name stay.
    """
    small_batches(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in whatever order, go.

    Documents without a text or id stay; repeated rows share their fate; texts are looked through
    over their whole length; an empty table or benchmark takes nothing away, and columns of any
    name stay.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are masked, and ``n_chars`` follows.

    Null and empty texts stay as they are, repeated rows are masked alike, texts are masked over
    their whole length, and no row goes; columns of any name stay, an empty table gives none.
    """
    masked = secrets.masked(docs, MASK)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether decoding gives the text again.

    A null or empty text has no ids; repeated rows repeat theirs; texts of any length are encoded
    whole; an empty table gives none. Other columns than the language and source are left out.
    """
    small_batches(spark)
    coded = bpe_codec.encode_decode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language_id", languages), ("simhash_dedup", near_copies), ("decontamination", benchmark_leaks), ("secret_scans", secret_masks), ("bpe_codec", tokens)]
ORACLE_SQL = None  # SQL has no byte-pair merges; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
