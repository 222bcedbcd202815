"""Near copies of whole documents: every pair of a candidate group by exact Jaccard of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.bpe import Remembered, load
from gradelake.llm.common import split_hot, whole_tasks, written
from gradelake.llm.decontam import rolling
from gradelake.llm.paragraph_dedup import near_pairs
from gradelake.llm.shared_keys import five

_KEY = np.uint64(24)  # shingles travel as their upper 40 bits


def token_numbers(_: bytes) -> Remembered:
    """The numbers of tokens seen, one table per Python worker."""
    return Remembered(lambda token: xxhash.xxh64_intdigest(token) | 1, 60_000)


def shingles(tokens: list[bytes], number, words: int) -> np.ndarray:
    """Hashes of the ``words``-word shingles; a text of fewer words is one, and so is one without words."""
    if not tokens:
        return np.zeros(1, np.uint64)
    return rolling(np.fromiter(map(number.__getitem__, tokens), np.uint64, len(tokens)), min(words, len(tokens)))


def similar_documents(source: DataFrame, proposed: DataFrame, words: int, similarity: float, block_rows: int = 512) -> DataFrame:
    """Links (a, b) of pids that connect all documents of a group with enough exact Jaccard similarity.

    ``source`` is (id, th, text), ``proposed`` (pid, least, key): one document (its id and th)
    of each pid, and its candidate group. Groups of one document go no further; the others'
    shingles are cut once, and each block pair of a group is one bounded task, which gives no
    more links than it has rows.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = load(b"", token_numbers)
        for batch in batches:
            found = [five((shingles(t.encode("utf-8", "replace").lower().split(), number, words) >> _KEY).astype(np.int64)).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"pid": batch["pid"], "key": batch["key"], "shingles": found})

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(batches, 2 * block_rows):
            yield near_pairs(rows, similarity)

    several = proposed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    asked = proposed.join(several, "key").select("pid", "key", F.col("least.id").alias("id"), F.col("least.th").alias("th"))
    cuts = source.join(asked, ["id", "th"]).select("pid", "key", "text").mapInPandas(cut, "pid long, key long, shingles binary")
    cuts = written(cuts, "documents").groupBy("pid", "key").agg(F.first("shingles").alias("shingles"))  # repeated rows
    tasks = split_hot(cuts, ["key"], F.col("pid"), block_rows).withColumn("task", F.xxhash64("key", "blk_i", "blk_j"))
    tasks = tasks.select("task", "pid", "shingles", "blk", "blk_i", "blk_j")
    return tasks.repartition("task").sortWithinPartitions("task").mapInPandas(verified, "a long, b long")
