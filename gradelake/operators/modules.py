"""Modules: segments by headers or by width, their topics, and quotas of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradelake.functions import text as T
from gradelake.functions.grading import rounded
from gradelake.functions.text import spaced

HEADER = r"(?im)^(?:Module|MODULE|Unit|UNIT)\s+(?:\d+|[IVX]+)[:.\s]"

TOPICS = "array<struct<id:string,title:string,key_concepts:array<string>,learning_objectives:array<string>,chunk_indices:array<int>>>"


def module_segments(chunks: DataFrame, doc_col: str = "doc_id", dedupe_default: bool = False) -> DataFrame:
    """(doc, module_no, title, chunk_indices, topics): a header starts a module, chunks before one are 'General Content'.

    Topics are the first three phrases of chunks other than headers, each once. The default
    module's first chunk opens it: it gives no topics and is listed twice, as stored data has
    it; ``dedupe_default`` lists it once.
    """
    by_doc = Window.partitionBy(doc_col).orderBy("chunk_id")
    header = F.regexp_extract("text", spaced(HEADER), 0)
    rows = chunks.select(doc_col, "chunk_id", header.alias("_h"), F.slice(T.phrases(F.col("text")), 1, 3).alias("_p"))
    rows = rows.withColumn("_n", F.sum((F.col("_h") != "").cast("int")).over(by_doc))
    whole = Window.partitionBy(doc_col)
    first, opening = F.min(F.col("_n")).over(whole), F.col("chunk_id") == F.min("chunk_id").over(whole)
    rows = rows.withColumn("module_no", (F.col("_n") + F.when(first == 0, 1).otherwise(0)).cast("int")).withColumn("_default", F.col("_n") == 0).withColumn("_opens", (F.col("_h") != "") | opening)
    title = F.when(F.col("_default"), "General Content").otherwise(T.strip(F.regexp_replace("_h", r"[:.]$", "")))
    rows = rows.withColumn("_title", F.when((F.col("_h") != "") | F.col("_default"), title))
    listed = F.array_sort(F.collect_list(F.struct("chunk_id", F.when(~F.col("_opens"), F.col("_p")).otherwise(F.array().cast("array<string>")).alias("p"))))
    grouped = rows.groupBy(doc_col, "module_no").agg(F.min("_title").alias("title"), F.first("_default").alias("_default"), listed.alias("_l"))
    indices = F.transform("_l", lambda x: x["chunk_id"])
    twice = F.when(F.col("_default") & F.lit(not dedupe_default), F.concat(F.slice(indices, 1, 1), indices)).otherwise(indices)
    topics = F.array_distinct(F.flatten(F.transform("_l", lambda x: x["p"])))
    return grouped.select(doc_col, "module_no", "title", twice.alias("chunk_indices"), topics.alias("topics"))


def topic_tree(chunks: DataFrame, documents: DataFrame | None = None, doc_col: str = "doc_id") -> DataFrame:
    """``module_segments`` with topics as records (id, title, key_concepts, learning_objectives, chunk_indices).

    A topic belongs to the chunk that first names it in its module. With ``documents`` (doc,
    title), those without chunks get one module under their title, with the topic of core
    concepts and no chunks.
    """
    found = module_segments(chunks, doc_col)
    titled = found.select(doc_col, "module_no", F.posexplode("topics").alias("no", "topic"))
    phrases = chunks.select(doc_col, "chunk_id", F.regexp_extract("text", spaced(HEADER), 0).alias("_h"), F.slice(T.phrases(F.col("text")), 1, 3).alias("_p"))
    named = phrases.where("_h = ''").select(doc_col, "chunk_id", F.explode("_p").alias("topic"))
    # What opens a module names no topics: its header, or the default module's first chunk, which is listed twice.
    indices = F.col("chunk_indices")
    naming = F.when(F.get(indices, F.lit(0)) == F.get(indices, F.lit(1)), F.slice(indices, 3, 2**31 - 1)).otherwise(indices)
    of = found.select(doc_col, "module_no", F.explode(naming).alias("chunk_id"))
    first = named.join(of, [doc_col, "chunk_id"]).groupBy(doc_col, "module_no", "topic").agg(F.min("chunk_id").alias("chunk_id"))
    number = F.concat_ws(".", "module_no", F.col("no") + 1)
    record = F.struct(number.alias("id"), F.col("topic").alias("title"), F.array("topic").alias("key_concepts"), F.array(F.concat(F.lit("Understand "), "topic")).alias("learning_objectives"), F.array("chunk_id").alias("chunk_indices"))
    listed = titled.join(first, [doc_col, "module_no", "topic"]).groupBy(doc_col, "module_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", record.alias("r")))), lambda x: x["r"]).alias("topics"))
    out = found.drop("topics").join(listed, [doc_col, "module_no"], "left")
    out = out.withColumn("topics", F.coalesce("topics", F.array().cast(TOPICS)))
    if documents is None:
        return out
    bare = documents.join(found.select(doc_col).distinct(), doc_col, "left_anti")
    none = F.array().cast("array<int>")
    core = F.struct(F.lit("1.1").alias("id"), F.lit("Core Concepts").alias("title"), F.array(F.lit("Core Concepts")).alias("key_concepts"), F.array(F.lit("Understand the main concepts")).alias("learning_objectives"), none.alias("chunk_indices"))
    return out.unionByName(bare.select(doc_col, F.lit(1).alias("module_no"), "title", none.alias("chunk_indices"), F.array(core).cast(TOPICS).alias("topics")))


def module_groups(chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, module_no, title, first_chunk, last_chunk, n_chunks): modules of a quarter of the chunks each, at least one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(doc_col))
    width = F.greatest(F.lit(1), F.floor(n / 4))
    rows = chunks.select(doc_col, "chunk_id", (F.floor(F.col("chunk_id") / width) + 1).cast("int").alias("module_no"))
    out = rows.groupBy(doc_col, "module_no").agg(F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"), F.count(F.lit(1)).alias("n_chunks"))
    return out.withColumn("title", F.concat(F.lit("Module "), F.col("module_no").cast("string")))


def question_total(n_chunks: Column, halved: bool = False) -> Column:
    """Questions for a document: its chunks (or half of them), 6 at least and 20 at most."""
    n = F.floor(n_chunks / 2) if halved else n_chunks
    return F.least(F.greatest(n, F.lit(6)), F.lit(20)).cast("int")


def type_quota(total: Column) -> tuple[Column, Column, Column]:
    """(mcq, short, conceptual): 40 and 30 percent, halves up and one at least, and the rest."""
    mcq, short = F.greatest(F.lit(1), rounded(total * 0.4)), F.greatest(F.lit(1), rounded(total * 0.3))
    return mcq, short, total - mcq - short


def module_quota(modules: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Each module's questions by its share of the document's chunks, and their split by type.

    ``modules`` is (doc, module_no, chunk_indices); the document's size is what its distinct
    chunks are.
    """
    n = F.size("chunk_indices")
    all_chunks = F.sum(F.size(F.array_distinct("chunk_indices"))).over(Window.partitionBy(doc_col))
    total = question_total(all_chunks)
    mine = F.greatest(F.lit(1), rounded(total * (n / all_chunks)))
    out = modules.select(doc_col, "module_no", mine.alias("questions"))
    q = F.col("questions")
    return out.withColumns({"mcq": F.greatest(F.lit(1), rounded(q * 0.4)), "short": F.greatest(F.lit(1), rounded(q * 0.3)), "conceptual": F.greatest(F.lit(1), q - rounded(q * 0.4) - rounded(q * 0.3))})


def third_quota(total: Column) -> tuple[Column, Column, Column]:
    """(mcq, short, conceptual): whole thirds, one at least, and the rest."""
    third = F.greatest(F.lit(1), F.floor(total / 3)).cast("int")
    return third, third, total - 2 * third


def difficulty_quota(total: Column) -> tuple[Column, Column, Column]:
    """(easy, medium, hard): a quarter, a half and a quarter, whole, one at least of each."""
    part = lambda n: F.greatest(F.lit(1), F.floor(total / n)).cast("int")
    return part(4), part(2), part(4)
