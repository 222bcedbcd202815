"""Benchmark decontamination by greedy string tiling over shared token seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import union_all, written
from gradelake.llm.words import words

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIEVE = 20  # bits of the table that is asked before the seeds
_PAIRS = 1_000_000  # pairs of places of a text and an item made at a time
_MATCHES = 100_000  # matches of a text and an item held at a time


def tokens_of(texts: list[str]) -> list[np.ndarray]:
    """The token numbers of each text: its white-space-separated words by letters and digits in lower case, those without any left out."""
    found = words(texts)
    number, row = found.number[~found.empty], found.row[~found.empty]
    return np.split(number, np.searchsorted(row, np.arange(1, len(texts)))) if len(texts) else []


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + tokens[k : k + n]
    return out ^ (out >> np.uint64(29))


def matches(blocks: Iterable[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[np.ndarray]:
    """Rows (length, text, item) of the maximal matches of seeds, from blocks of seeds in order of the text's places.

    Neighbouring seeds of a diagonal are one match. What reaches a block's last place stays
    open until the next block is seen, so that blocks do not show in the result.
    """
    held = np.empty((3, 0), np.int64)
    for p, q in blocks:
        if not len(p):
            continue
        end = p.max() + 1
        n, a, b = np.concatenate([held, [np.ones(len(p), np.int64), p, q]], axis=1)
        order = np.lexsort((a, a - b))
        n, a, b = n[order], a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1] + n[:-1]) | (np.diff(a - b) != 0)]))
        n, a, b = np.add.reduceat(n, first), a[first], b[first]
        still = a + n == end
        held = np.stack([n[still], a[still], b[still]])
        yield np.stack([n[~still] + width - 1, a[~still], b[~still]])
    yield held + np.array([[width - 1], [0], [0]])


def greedy_tiles(seeds: Callable[[np.ndarray, np.ndarray], Iterable[tuple[np.ndarray, np.ndarray]]], n_text: int, n_item: int, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a text and a test item: (text, item, length) of each tile.

    ``seeds`` gives blocks of seeds (p, q): the ``width`` tokens from p in the text are those
    from q in the item, for the places whose ``width`` tokens are unmarked (two masks). The
    longest match whose tokens are all unmarked is marked first (ties: the first in the text,
    then in the item); one that is partly marked by then is cut to its unmarked stretches of
    ``width`` tokens or more and waits again.

    The first ``_MATCHES`` matches in that order are held at a time. Where there are more, these
    are taken down to the last of them, and what is then unmarked is matched again: the result
    is that of all at once. Each turn marks a match, so it ends.
    """
    in_text, in_item, out = np.zeros(n_text, bool), np.zeros(n_item, bool), []

    def clean(marked: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(marked)])
        return upto[width:] == upto[:-width]

    def best(found: np.ndarray) -> np.ndarray:
        return found[:, np.lexsort((found[2], found[1], -found[0]))[:_MATCHES]]

    while True:
        found, cut = np.empty((3, 0), np.int64), False
        for more in matches(seeds(clean(in_text), clean(in_item)), width):
            found = np.concatenate([found, more], axis=1)
            cut |= found.shape[1] > _MATCHES
            if found.shape[1] > 2 * _MATCHES:
                found = best(found)
        heap = [(-n, a, b) for n, a, b in best(found).T.tolist()]  # in order, so it is a heap
        last = heap[-1] if cut else None
        while heap:
            n, a, b = heappop(heap)
            free = ~(in_text[a : a - n] | in_item[b : b - n])
            if free.all():
                out.append((a, b, -n))
                in_text[a : a - n] = in_item[b : b - n] = True
                continue
            edges = np.flatnonzero(np.diff(free, prepend=False, append=False)).tolist()
            for x, y in zip(edges[::2], edges[1::2], strict=True):
                piece = (x - y, a + x, b + x)
                if y - x >= width and (last is None or piece <= last):
                    heappush(heap, piece)
        if not cut:
            return sorted(out)


def tiles(p: np.ndarray, q: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The tiles of all seeds (p, q) of a text and an item (see ``greedy_tiles``)."""
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]

    def seeds(text: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        free = text[p] & item[q]
        yield p[free], q[free]

    return greedy_tiles(seeds, int(p.max()) + width, int(q.max()) + width, width)


class Seeds:
    """The seeds of some benchmark items: hashes in order, with the item, place and tokens behind each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int):
        self.ids, self.tokens, self.width = [i for i, _ in items], [t for _, t in items], width
        hashes = [rolling(t, width) for t in self.tokens]
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        which = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in hashes)])
        order = np.argsort(h, kind="stable")
        self.which, self.place = which[order], place[order]
        self.distinct, self.start = np.unique(h[order], return_index=True)
        self.end = np.append(self.start[1:], len(h)).astype(np.int64)
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[(self.distinct >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True

    def met(self, tokens: np.ndarray, coverage: float) -> Iterator[tuple[int, Callable]]:
        """(item, seeds for ``greedy_tiles``) of the items of which a text may cover that share.

        An item's places that the text meets are counted first, by hashes alone: no tiling
        covers more than the tokens these reach. Pairs of places are made for the items left.
        """
        h = rolling(tokens, self.width)
        p = np.flatnonzero(self.sieve[(h >> np.uint64(64 - _SIEVE)).astype(np.int64)])
        if not len(p) or not len(self.distinct):
            return
        at = np.minimum(np.searchsorted(self.distinct, h[p]), len(self.distinct) - 1)
        hit = self.distinct[at] == h[p]
        p, at = p[hit], at[hit]
        slot = np.unique(at)
        times = self.end[slot] - self.start[slot]
        k = np.repeat(self.start[slot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        slot = np.repeat(slot, times)
        order = np.argsort(self.which[k], kind="stable")
        k, slot = k[order], slot[order]
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(self.which[k])) + 1):
            if len(part):
                item = self.which[k[part[0]]]
                if len(part) * self.width >= len(self.tokens[item]) * coverage:
                    yield item, partial(self.seeds, tokens, self.tokens[item], p, at, slot[part], self.place[k[part]])

    def seeds(self, tokens: np.ndarray, other: np.ndarray, p: np.ndarray, at: np.ndarray, slot: np.ndarray, place: np.ndarray, text: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of about ``_PAIRS`` (p, q), of the unmarked places of a text and an item that share ``width`` tokens.

        Equal Karp-Rabin hashes (``at`` and ``slot``) are candidates; the tokens themselves decide.
        """
        p, at = p[text[p]], at[text[p]]
        slot, place = slot[item[place]], place[item[place]]
        low, times = np.searchsorted(slot, at, "left"), np.searchsorted(slot, at, "right")
        times -= low
        p, low, times = p[times > 0], low[times > 0], times[times > 0]
        upto, first = np.append(0, np.cumsum(times)), 0
        while first < len(p):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + _PAIRS, "right")) - 1)
            n = times[first:last]
            ps = np.repeat(p[first:last], n)
            qs = place[np.repeat(low[first:last] - (upto[first:last] - upto[first]), n) + np.arange(len(ps))]
            same = np.ones(len(ps), bool)
            for i in range(self.width):
                same &= tokens[ps + i] == other[qs + i]
            yield ps[same], qs[same]
            first = last


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, coverage: float = 0.5, tokens_at_once: int = 1_000_000) -> DataFrame:
    """(id, item, n_tiles, longest, covered, coverage) of each text and benchmark item with enough in common.

    Tokens are white-space-separated words reduced to letters and digits in lower case.
    ``coverage`` is the share of the item's tokens that tiles of ``width`` tokens or more
    cover in whatever order; runs of 4 shared tokens and fewer are chance. Items of fewer than
    ``width`` tokens, null and empty texts match nothing, and neither do items without an id;
    rows without an id are judged as one. Ids may be of any kind. Rows with equal ids and texts repeat their result
    once; equal ids with different texts are judged as rows of their own and the best coverage
    is given. Of tiles of equal length the first in the text, then in the item, is marked
    first. Texts of any length are taken whole; a text and an item that repeat the same words
    meet in bounded memory, in a time that grows with the product of these places at worst; an empty table on either side gives no rows,
    and of other columns, whatever their names, nothing is read.

    Each task meets its texts with the items in one pass, and nothing but results is shuffled.
    Items go to the tasks in parts of about ``tokens_at_once`` tokens (by a hash of the item),
    one pass over the texts for each part, so that what is broadcast is bounded (8 MB of
    tokens, 40 MB with their tables) however large the benchmark is.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-size // tokens_at_once))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def judged(part: int) -> DataFrame:
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(Seeds([(r["item"], t) for r in some.toLocalIterator() if len(t := tokens_of([r["text"]])[0]) >= width], width))

        def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seeds = shared.value
            for batch in batches:
                out = []
                for doc, tokens in zip(batch["id"], tokens_of(batch["text"].to_list()), strict=True):
                    for item, pairs in seeds.met(tokens, coverage):
                        n = len(seeds.tokens[item])
                        found = [x for _, _, x in greedy_tiles(pairs, len(tokens), n, width)]
                        if found:
                            out.append((doc, seeds.ids[item], len(found), max(found), sum(found), sum(found) / n))
                yield pd.DataFrame([x for x in out if x[-1] >= coverage], columns=["id", "item", "n_tiles", "longest", "covered", "coverage"])

        return rows.mapInPandas(met, "id string, item string, n_tiles int, longest int, covered int, coverage double")

    found = union_all([judged(part) for part in range(parts)])
    best = found.groupBy("id", "item").agg(F.max(F.struct("coverage", "covered", "n_tiles", "longest")).alias("b"))
    return best.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("item").cast(benchmark.schema[item_col].dataType).alias(item_col), "b.n_tiles", "b.longest", "b.covered", "b.coverage")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows that no benchmark item covers; their columns are unchanged, rows without an id or text stay.

    The ids found are written to the shared folder first, so that the join knows their size:
    where they are few, Spark sends them to the rows, and the texts are not shuffled.
    """
    found = contamination(docs, benchmark, text_col, id_col, **options).select(F.col(id_col).alias("_found")).distinct()
    found = written(found, "contaminated")
    return docs.join(found, F.col(id_col) == F.col("_found"), "left_anti")
