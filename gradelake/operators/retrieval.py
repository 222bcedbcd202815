"""Lexical retrieval: overlap scores, top chunks, contexts and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradelake.functions import text as T
from gradelake.sources.tables import written


LEXICAL, GROUNDING = 0.7, 0.3
_SEEDS = 8  # best blocks of each term whose best chunk is scored first
_GROUP = 150_000  # rows of (query, chunk) or (query, term, block) that go to all tasks at once
_NEAR = 8  # words before a word that are compared with it one by one
_ROUNDING = 2e-6  # scores are rounded to six decimals


def indexed(chunks: DataFrame) -> DataFrame:
    """Chunks with ``terms``, ``n_chunk`` (their number) and ``block``, as the retrieval index stores them.

    A term is a word with the number of its occurrence, so that two texts share as many terms
    as their multisets of words do. A block holds chunks of about the same number of words (a
    quarter apart) and grounding score (0.025 apart), so that what a chunk can score is much the
    same in all of a block.
    """
    # In columns of their own, as a function over an array would work out the array anew for each element.
    rows = chunks.withColumn("_w", F.sort_array(T.words(F.col("text"))))
    rows = rows.withColumn("terms", F.transform("_w", lambda w, i: F.concat_ws(" ", w, _occurrence(F.col("_w"), w, i))))
    length = F.floor(F.log(F.size("_w") + 1) / F.log(F.lit(1.25)))
    return rows.withColumns({"n_chunk": F.size("_w"), "block": length * 1000 + F.floor(F.col("grounding_score") * 40)}).drop("_w")


def _occurrence(words: Column, w: Column, i: Column) -> Column:
    """How many of the sorted ``words`` before place ``i`` are ``w``, -1 more: as a text.

    Only a word that occurs often has its first place looked for, which passes all words before it.
    """
    out = F.when(~F.get(words, i - 1).eqNullSafe(w), "-1")
    for k in range(2, _NEAR + 1):
        out = out.when(~F.get(words, i - k).eqNullSafe(w), str(k - 2))
    return out.otherwise((i - F.array_position(words, w)).cast("string"))


def _score(overlap: Column) -> Column:
    norm = (F.col("n_query") + F.col("n_chunk")) / F.lit(2.0)
    return F.round(F.when(norm > 0, overlap / norm).otherwise(0.0) * LEXICAL + F.col("grounding_score") * GROUNDING, 6)


def _spared(n_chunk: Column, grounding: Column) -> Column:
    """How many terms a chunk may share with a query and still score below the query's ``threshold``."""
    return (F.col("threshold") - grounding * GROUNDING) * (F.col("n_query") + n_chunk) / (2 * LEXICAL)


def _in_groups(query_col: str, rows: DataFrame, asked: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """``rows`` and ``asked`` by groups of queries of some _GROUP of the rows, each to go to all tasks."""
    groups = 1 + rows.count() // _GROUP
    of = F.pmod(F.xxhash64(query_col), F.lit(groups))
    return [(F.broadcast(rows.where(of == g)), F.broadcast(asked.where(of == g))) for g in range(groups)]


def scored_chunks(queries: DataFrame, chunks: DataFrame, top_k: int, query_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """The ``top_k`` chunks of each query: (query, doc, chunk_id, overlap, score, rank).

    The score is 0.7 x the terms in common over the mean number of terms, and 0.3 x the chunk's
    grounding score; ties go by document and chunk. Chunks are not scored against all queries:

    1. For each term of a query and each block of chunks, the number of chunks and the one of
       largest impact are found. The best of a query's terms, and the ``top_k`` chunks by
       grounding alone (chunks without a common term can be nowhere else among the best), are
       scored: the last of the best ``top_k`` of these is the query's threshold.
    2. A query's terms stand from the most common to the rarest. In a block, the first so many
       of them cannot lift a chunk to the threshold, whatever else is in it: only the rarer
       terms are looked up there. Common words are thus not looked up but in chunks so short
       that they count.
    3. Chunks found so are scored exactly where they lie, and only those that reach the
       threshold are shuffled for the order.

    What steps 1 and 2 name goes to all tasks in groups of queries of a checked size, each reading
    the index once: the index is never shuffled. ``chunks`` are read several times: hand in a stored table, ``indexed`` best.
    """
    spark = chunks.sparkSession
    key = [doc_col, "chunk_id"]
    index = chunks if "terms" in chunks.columns else indexed(chunks)
    index = index.select(*key, "grounding_score", "terms", "n_chunk", "block")
    asked = written(indexed(queries.select(query_col, F.col("query").alias("text"), F.lit(0.0).alias("grounding_score"))).select(query_col, F.col("n_chunk").alias("n_query"), F.col("terms").alias("_q")), "asked")
    wanted = asked.select(query_col, "n_query", F.explode("_q").alias("term"))

    # 1. Blocks of each term, and thresholds.
    impact = 2 * LEXICAL / (F.lit(64) + F.col("n_chunk")) + F.col("grounding_score") * GROUNDING
    places = index.select(*key, "n_chunk", "grounding_score", "block", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    facts = places.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(impact.alias("impact"), *key)).alias("best"), F.min("n_chunk").alias("shortest"), F.max("n_chunk").alias("longest"), F.max("grounding_score").alias("grounded"))
    facts = written(facts, "term-blocks")
    by_term = Window.partitionBy("term")
    best = facts.withColumn("_r", F.row_number().over(by_term.orderBy(F.desc("best")))).where(F.col("_r") <= _SEEDS).select("term", "best.*").drop("impact")
    first = index.select(*key, "grounding_score").orderBy(F.desc("grounding_score"), *key).limit(top_k).select(*key)
    first = spark.createDataFrame(first.collect(), first.schema)  # top_k rows
    every = asked.select(query_col).withColumn("_k", F.lit(1)).join(first.withColumn("_k", F.lit(1)), "_k").drop("_k")
    seeds = written(wanted.join(best, "term").select(query_col, *key).unionByName(every).distinct(), "seeds")
    overlap = F.size(F.array_intersect("terms", "_q"))
    scored = [index.join(some, key).join(mine, query_col).select(query_col, *key, overlap.alias("overlap"), _score(overlap).alias("score")) for some, mine in _in_groups(query_col, seeds, asked)]
    scored = written(reduce(DataFrame.unionByName, scored), "scored-seeds")
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), *key)
    last = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == top_k).select(query_col, (F.col("score") - _ROUNDING).alias("threshold"))

    # 2. The terms that have to be looked up, by block.
    common = facts.groupBy("term").agg(F.sum("n").alias("n"))
    by_query = Window.partitionBy(query_col).orderBy(F.desc("n"), "term")
    ranked = wanted.join(common, "term").withColumn("place", F.row_number().over(by_query)).join(last, query_col, "left")
    ranked = ranked.withColumn("threshold", F.coalesce("threshold", F.lit(-1.0))).drop("n")
    looked_up = ranked.join(facts.drop("best", "n"), "term").where(F.col("place") > _spared(F.col("shortest"), F.col("grounded")))
    most = 2 * LEXICAL * F.col("longest") / (F.col("n_query") + F.col("longest")) + F.col("grounded") * GROUNDING
    looked_up = looked_up.where(most >= F.col("threshold")).select(query_col, "term", "block", "place", "threshold")
    looked_up = written(looked_up, "looked-up")

    # 3. Exact scores where chunks lie.
    found = []
    for some, mine in _in_groups(query_col, looked_up, asked):
        met = index.withColumn("term", F.explode("terms")).join(some, ["term", "block"]).join(mine, query_col)
        met = met.where(F.col("place") > _spared(F.col("n_chunk"), F.col("grounding_score")))
        found.append(met.select(query_col, *key, overlap.alias("overlap"), _score(overlap).alias("score"), "threshold").where("score >= threshold").drop("threshold"))
    once = reduce(DataFrame.unionByName, [scored, *found]).groupBy(query_col, *key).agg(F.max("overlap").alias("overlap"), F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(query_col, *key, "overlap", "score", "rank")


def contexts(ranked: DataFrame, chunks: DataFrame, limit: int = 5, query_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """(query, context): the chunks of each query in rank order as labelled lines."""
    label = F.concat(F.lit("[Chunk "), (F.col("chunk_id") + 1).cast("string"), F.lit(" | p"), F.col("page").cast("string"), F.lit(" | "), F.col("tokens").cast("string"), F.lit(" tok | g="), F.col("grounding_score").cast("string"), F.lit("]: "), F.col("text"))
    lines = ranked.where(F.col("rank") <= limit).join(chunks, [doc_col, "chunk_id"]).select(query_col, "rank", label.alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return lines.groupBy(query_col).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("context"))
