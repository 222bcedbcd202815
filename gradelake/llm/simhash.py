"""SimHash near-duplicates: fingerprints linked by a self-join over binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import checkpoint, components, forest, kept_rows, split_hot, whole_tasks
from gradelake.llm.near_documents import similar_documents

SEED = 42
_LEAF = 64  # node pairs of up to so many value pairs are compared at once
_CHUNK = 200_000  # node pairs, value pairs or rows handled in one step


def split_words(text: str | None) -> list[bytes]:
    """The runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, words: int) -> int:
    """64 bits; bit b is 1 if set in over half the XXH64 hashes of the word shingles, repeats included."""
    return print_of(split_words(text), words)


def print_of(tokens: list[bytes], words: int) -> int:
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def simhash(text: Column, words: int) -> Column:
    """The fingerprint of a text column as a (signed) long; a null text is an empty one."""

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return made(F.coalesce(text, F.lit("")))


class Layout:
    """The tables of the trie join: 64 bits cut into blocks, and an order of bits for each pair of blocks.

    With ``max_bits`` + 2 blocks, two fingerprints of at most ``max_bits`` differing bits agree
    on two blocks at least. Each table puts two blocks first: its trie's upper levels are
    walked without an error, the rest with the whole budget.
    """

    def __init__(self, max_bits: int):
        edges = np.linspace(0, 64, max_bits + 3).round().astype(int)
        blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
        self.orders, self.prefix = [], []
        for pair in combinations(range(len(blocks)), 2):
            first = [b for k in pair for b in blocks[k]]
            self.prefix.append(len(first))
            self.orders.append(first + [b for k, block in enumerate(blocks) if k not in pair for b in block])

    @staticmethod
    def _move(values: np.ndarray, order: list[int]) -> np.ndarray:
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        return np.packbits(bits[:, order], axis=1).reshape(-1).view(">u8").astype(np.uint64)

    def permute(self, values: np.ndarray, t: int) -> np.ndarray:
        return self._move(values, self.orders[t])

    def restore(self, values: np.ndarray, t: int) -> np.ndarray:
        return self._move(values, np.argsort(self.orders[t]).tolist())


def trie_links(v: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values of at most ``max_bits`` differing bits, below the given pairs of trie nodes.

    A node at a depth is a range [lo, hi) of the values, sorted within it, that agree on their
    first ``depth`` bits; ``a`` and ``b`` are (n, 2) arrays of ranges, equal ones for a node
    with itself. Both nodes go down together: to equal bits at no cost, to different bits at
    one of the budget, which prunes.
    """
    stack = [(depth, a, b, np.zeros(len(a), np.int64))]
    while stack:
        depth, a, b, used = stack.pop()
        if len(a) > _CHUNK:
            half = len(a) // 2
            stack += [(depth, a[:half], b[:half], used[:half]), (depth, a[half:], b[half:], used[half:])]
            continue
        na, nb = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        leaf = (na * nb <= _LEAF) | (depth >= 64)
        if leaf.any():
            la, lb, sizes = a[leaf], b[leaf], (na * nb)[leaf]
            for at in range(0, len(sizes), _CHUNK // _LEAF):
                s = slice(at, at + _CHUNK // _LEAF)
                each = np.repeat(np.arange(len(sizes[s])), sizes[s])
                r = np.arange(len(each)) - np.repeat(np.cumsum(sizes[s]) - sizes[s], sizes[s])
                wide = (lb[s][:, 1] - lb[s][:, 0])[each]
                i, j = la[s][each, 0] + r // wide, lb[s][each, 0] + r % wide
                near = (np.bitwise_count(v[i] ^ v[j]) <= max_bits) & ((la[s][each, 0] != lb[s][each, 0]) | (i < j))
                if near.any():
                    yield i[near], j[near]
        a, b, used = a[~leaf], b[~leaf], used[~leaf]
        if not len(a):
            continue
        ones = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        cut = lambda x: x[:, 1] - (ones[x[:, 1]] - ones[x[:, 0]])
        ca, cb, itself = cut(a), cut(b), a[:, 0] == b[:, 0]
        a0, a1 = np.stack([a[:, 0], ca], 1), np.stack([ca, a[:, 1]], 1)
        b0, b1 = np.stack([b[:, 0], cb], 1), np.stack([cb, b[:, 1]], 1)
        na, nb = np.concatenate([a0, a1, a0, a1[~itself]]), np.concatenate([b0, b1, b1, b0[~itself]])
        spent = np.concatenate([used, used, used + 1, used[~itself] + 1])
        keep = (spent <= max_bits) & (na[:, 0] < na[:, 1]) & (nb[:, 0] < nb[:, 1])
        stack.append((depth + 1, na[keep], nb[keep], spent[keep]))


def _joined(layout: Layout, max_bits: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Links among the rows of whole tasks, as a spanning forest of each table's rows."""
    out = []
    for t, part in rows.groupby("t"):
        v = part["v"].to_numpy().view(np.uint64)
        task, other = part["task"].to_numpy(), (part["blk"] != part["blk_i"]).to_numpy()
        order = np.lexsort((v, other, task))
        v, task, other = v[order], task[order], other[order]
        start = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (other[1:] != other[:-1])]))
        ranges = np.stack([start, np.append(start[1:], len(v))], 1)
        own, second = task[start], other[start]
        same = (part["blk_i"] == part["blk_j"]).to_numpy()[order][start]
        cross = np.flatnonzero(second[1:] & ~second[:-1] & (own[1:] == own[:-1])) if len(own) > 1 else np.empty(0, int)
        a = np.concatenate([ranges[same], ranges[cross]])
        b = np.concatenate([ranges[same], ranges[cross + 1]])
        parent = np.arange(len(v))
        for i, j in trie_links(v, a, b, layout.prefix[t], max_bits):
            parent = forest(i, j, len(v), parent)
        linked = np.flatnonzero(parent != np.arange(len(v)))
        if len(linked):
            values = layout.restore(v, t).view(np.int64)
            out.append(pd.DataFrame({"a": values[linked], "b": values[parent[linked]]}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def hamming_links(fingerprints: DataFrame, col: str, max_bits: int, block_rows: int = 2048) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``max_bits`` of each other.

    The links span the same components as all pairs, of which each task keeps a forest. Each
    distinct fingerprint goes to every table under its two first blocks; tables' nodes of one
    row are left out and large ones are cut into pairs of bounded blocks.
    """
    layout = Layout(max_bits)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["f"].to_numpy().view(np.uint64)
            for t, bits in enumerate(layout.prefix):
                v = layout.permute(values, t)
                key = (np.int64(t) << 48) | (v >> np.uint64(64 - bits)).astype(np.int64)
                yield pd.DataFrame({"key": key, "v": v.view(np.int64)})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(batches, _CHUNK):
            yield _joined(layout, max_bits, rows)

    rows = fingerprints.select(F.col(col).alias("f")).where("f is not null").distinct().mapInPandas(dealt, "key long, v long")
    tasks = split_hot(rows, ["key"], F.col("v"), block_rows).withColumn("task", F.xxhash64("key", "blk_i", "blk_j"))
    tasks = tasks.select("task", F.shiftright("key", 48).cast("int").alias("t"), "v", "blk", "blk_i", "blk_j")
    return tasks.repartition("task").sortWithinPartitions("task").mapInPandas(joined, "a long, b long")


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id is the smallest id reachable by links.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than
    ``words`` words is one shingle, one without words (null, empty, blank) has fingerprint 0
    and is linked like any other. Equal fingerprints are linked. Repeated rows stay; a null id
    is nobody's smallest unless a component has no other. A bit that half the shingles set is 0.
    Texts of any length are taken whole, an empty table gives no rows, and of other columns,
    whatever their names, nothing is read; ids may be of any kind that has an order.

    Exact copies are one fingerprint before anything is joined, and the joins by fingerprint
    and by component are plain equi-joins whose hot keys Spark can split.
    """
    prints = checkpoint(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), words).alias("fingerprint")))
    distinct = checkpoint(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    reached = components(hamming_links(distinct, "fingerprint", max_bits), "a", "b")
    label = distinct.join(reached, distinct["fingerprint"] == reached["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("label"))
    label = checkpoint(label)
    least = label.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(label.join(least, "label").select("fingerprint", "component_id"), "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8, print_words: int = 2, max_bits: int = 10) -> DataFrame:
    """The rows of one document, the smallest by id, of each group of near copies; their columns are unchanged.

    Two documents are linked if their sets of ``words``-word shingles have an exact Jaccard
    similarity of at least ``similarity``; groups are the connected ones. SimHash proposes: the
    fingerprints of ``print_words``-word shingles within ``max_bits`` of each other (directly or
    by others) are a candidate group, and all of a group's texts are compared by their shingles.
    Fingerprints are of shorter shingles than the decision because an altered word alters as
    many shingles as these have words: at a similarity of 0.8 in five words, fingerprints of
    five words differ in 10 bits of 64 on average, those of two words in 6.

    Rows without an id are kept, a null text is an empty one, texts equal in their words are
    linked, and rows that repeat both id and text are kept once (the first in the order of their
    columns); rows of one id and different texts are judged apart. Texts of any length are
    taken whole; an empty table gives none; clashing column names pass through.

    Texts equal in their words are one before anything is joined; shingles are cut only of
    documents in a candidate group, and a large group is compared in pairs of bounded blocks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("th", F.xxhash64("text"))

    def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [split_words(t) for t in batch["text"]]
            pid = np.array([xxhash.xxh64_intdigest(b" ".join(t)) for t in tokens], np.uint64).view(np.int64)
            bits = np.array([print_of(t, print_words) for t in tokens], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], "pid": pid, "fingerprint": bits})

    prints = source.mapInPandas(printed, f"id {kind}, th long, pid long, fingerprint long")
    distinct = checkpoint(prints.groupBy("pid").agg(F.min(F.struct("id", "th")).alias("least"), F.first("fingerprint").alias("fingerprint")))
    reached = components(hamming_links(distinct, "fingerprint", max_bits), "a", "b")
    proposed = distinct.join(reached, distinct["fingerprint"] == reached["node"], "left").select("pid", "least", F.coalesce("component", "fingerprint").alias("key"))
    links = similar_documents(source, proposed, words, similarity)
    linked = components(links, "a", "b")
    label = distinct.join(linked, distinct["pid"] == linked["node"], "left").select("least", F.coalesce("component", "pid").alias("label"))
    kept = label.groupBy("label").agg(F.min("least").alias("least")).select("least.id", "least.th")
    return kept_rows(docs, kept, text_col, id_col)
