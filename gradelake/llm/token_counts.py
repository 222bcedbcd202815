"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.bpe import SHIFT, ByPiece, Vocabulary, load

_POS = 40  # bits of a heap entry that hold the position


def merged_length(symbols: list[int], merge: dict[int, int]) -> int:
    """How many symbols are left when the lowest-ranked adjacent pair is merged until none is left.

    Equal ranks go leftmost first. ``symbols`` is used up. Heap entries whose pair has
    changed meanwhile are skipped. O(n log n) for n symbols.
    """
    n = len(symbols)
    get, low = merge.get, (1 << _POS) - 1
    heap = [m << _POS | i for i in range(n - 1) if (m := get(symbols[i] << SHIFT | symbols[i + 1])) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        entry = heappop(heap)
        i, whole = entry & low, entry >> _POS
        j = after[i]
        if symbols[i] < 0 or j >= n or get(symbols[i] << SHIFT | symbols[j]) != whole:
            continue
        symbols[i], symbols[j] = whole, -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (m := get(whole << SHIFT | symbols[k])) is not None:
                heappush(heap, m << _POS | i)
        h = before[i]
        if h >= 0 and (m := get(symbols[h] << SHIFT | whole)) is not None:
            heappush(heap, m << _POS | h)
    return n - merges


class Counter:
    """Counts of whole texts; pieces seen before are remembered in bounded tables."""

    def __init__(self, data: bytes):
        self.vocabulary = load(data, Vocabulary)
        merge = self.vocabulary.merge
        self.pieces = ByPiece(lambda word: merged_length(list(word.encode()), merge), sum)

    def count(self, text: str | None) -> int:
        parts = self.vocabulary.segments(text or "")
        return sum(1 if special else sum(self.pieces(part)) for part, special in parts)


def token_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", limit: int = 512, out: str = "n_tokens") -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``out`` (tokens) and ``over_limit`` (tokens > limit) to each row.

    One narrow pass, no shuffle. A null or empty text has 0 bytes and 0 tokens; texts of any
    length are counted whole, in tables and caches of bounded size; ranks do not tie, and equal
    pairs merge leftmost first. Rows repeat as they come, an empty table gives none; other
    columns pass through, and a column of a result's name is replaced.
    The vocabulary file (a few MB) is read once on the driver and broadcast.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_bytes())

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load(file.value, Counter)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), out: counted(text)}).withColumn("over_limit", F.col(out) > limit)
