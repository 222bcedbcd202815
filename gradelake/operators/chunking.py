"""Documents to chunks: the sentence-aware chunker, the ingest gate and extraction statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import text as T

LEAST_TEXT = 50


def chunk_documents(docs: DataFrame, id_col: str, content: Column, title: Column | None = None, size: int = 1100, overlap: int = 140) -> DataFrame:
    """(id, chunk_id, text, tokens, page, grounding_score, title): one row per chunk, no shuffle."""
    chunks = docs.select(F.col(id_col), (F.lit("") if title is None else title).alias("title"), F.posexplode(T.chunk_texts(content, size, overlap)).alias("chunk_id", "text"))
    return chunks.select(id_col, "chunk_id", "text", T.word_count(F.col("text")).alias("tokens"), (F.floor(F.col("chunk_id") / 3) + 1).cast("int").alias("page"), T.grounding_score(F.col("text")).alias("grounding_score"), "title")


def with_chunks(docs: DataFrame, content: Column, title: Column) -> DataFrame:
    """Documents with their chunks as one array column, as they are stored."""
    texts = T.chunk_texts(content)
    chunk = lambda t, i: F.struct(i.alias("id"), t.alias("text"), T.word_count(t).alias("tokens"), (F.floor(i / 3) + 1).cast("int").alias("page"), T.grounding_score(t).alias("grounding_score"), title.alias("title"))
    return docs.withColumn("chunks", F.transform(texts, chunk))


def valid_chunks(texts: Column) -> Column:
    """There are chunks, and each has more than 30 characters."""
    return (F.size(texts) > 0) & F.forall(texts, lambda t: F.length(t) > 30)


def ingest_gate(docs: DataFrame, content: Column) -> DataFrame:
    """Add accepted (enough text), n_tables, n_visuals, n_chunks and chunks_valid."""
    body, texts = F.coalesce(content, F.lit("")), F.col("_texts")
    cut = docs.withColumn("_texts", T.chunk_texts(body))  # cut once, used twice
    return cut.withColumns(
        {
            "accepted": F.length(T.strip(body)) >= LEAST_TEXT,
            "n_tables": T.occurrences(body, F.lit("[TABLE]")),
            "n_visuals": T.occurrences(body, F.lit("[VISUAL CONTENT")),
            "n_chunks": F.size(texts),
            "chunks_valid": valid_chunks(texts),
        }
    ).drop("_texts")


def accepted_and_rejected(docs: DataFrame, content: Column) -> tuple[DataFrame, DataFrame]:
    enough = F.length(T.strip(F.coalesce(content, F.lit("")))) >= LEAST_TEXT
    return docs.where(enough), docs.where(~enough)
