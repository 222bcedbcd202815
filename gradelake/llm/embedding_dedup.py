"""Embedding near-duplicates by spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import checkpoint, components, forest, split_hot, whole_tasks, written
from gradelake.llm.shared_keys import runs

_MOST_WORDS = 16_384  # code words a block: 268 million filters
_PAIRS = 200_000  # pairs compared in one step
_SKETCH = 256  # sign bits


def sketch_bits(cosine: float, size: int = _SKETCH) -> int:
    """How many of the sign bits may differ: the mean at the bound and six deviations more."""
    p = float(np.arccos(np.clip(cosine, -1, 1))) / np.pi
    return min(size, int(np.ceil(size * p + 6 * np.sqrt(size * p * (1 - p)))))


def code_words(rows: int, filters: float, per_filter: float = 8) -> int:
    """Code words a block so that a filter is passed by about ``per_filter`` of ``rows`` vectors, whatever their number."""
    return int(min(_MOST_WORDS, max(64, np.ceil(np.sqrt(rows * filters / per_filter)))))


class CapFilters:
    """Filter directions of one dimension: sums of one code word from each of two blocks.

    The space is turned at random and halved; each half has ``words`` random unit code words,
    and each pair of words is a filter. A vector passes the filters whose direction it meets at
    a cosine above ``cap``, set so that a random vector passes ``filters`` on average; one
    that lies far from the code words takes its best ``least`` filters all the same, as its
    neighbours do.
    """

    def __init__(self, dim: int, words: int, filters: float, least: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half, self.least = (dim + 1) // 2, least
        words = self.words = min(words, 8 * 4 ** (self.half - 1))  # few dimensions have few directions
        self.codes = []
        for size in (self.half, dim - self.half):
            code = rng.standard_normal((words, size))
            self.codes.append(code / np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12))
        probe = rng.standard_normal((2000, dim))
        a, b = self._scores(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        pick = rng.integers(0, words, (2, 2000))
        self.cap = float(np.quantile(a[:, pick[0]] + b[:, pick[1]], max(0.0, 1 - filters / words**2)))
        self.planes = rng.standard_normal((dim, _SKETCH))

    def recall(self, cosine: float, pairs: int = 400) -> float:
        """The share of random pairs at ``cosine`` that pass a common filter."""
        rng = np.random.default_rng(5)
        dim = len(self.turn)
        x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in rng.standard_normal((2, pairs, dim)))
        y -= (x * y).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        (i, f), (j, g) = self.passed(x), self.passed(y)
        shared = np.intersect1d(i * self.words**2 + f, j * self.words**2 + g)
        return len(np.unique(shared // self.words**2)) / pairs

    def _scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x @ self.turn
        return x[:, : self.half] @ self.codes[0].T, x[:, self.half :] @ self.codes[1].T

    def passed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters passed.

        The second block's scores are sorted, so that for each word of the first block the
        passing words of the second are a prefix. Where too few pass, the cap is lowered by
        halving until ``least`` do.
        """
        a, b = self._scores(x)
        order = np.argsort(-b, axis=1)
        rows, filters = [], []
        for i in range(len(x)):
            down = -b[i, order[i]]
            take = np.searchsorted(down, a[i] - self.cap + 1e-12)
            if take.sum() < self.least:
                low, high = self.cap - 1.0, self.cap
                for _ in range(12):
                    cap = (low + high) / 2
                    take = np.searchsorted(down, a[i] - cap + 1e-12)
                    low, high = (cap, high) if take.sum() >= self.least else (low, cap)
                take = np.searchsorted(down, a[i] - low + 1e-12)
            each = np.repeat(np.arange(self.words), take)
            second = order[i, np.arange(len(each)) - np.repeat(np.cumsum(take) - take, take)]
            rows.append(np.full(len(each), i))
            filters.append(each * self.words + second)
        return np.concatenate(rows), np.concatenate(filters)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """The signs of rows, packed."""
        return np.packbits(x @ self.planes > 0, axis=1)


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _units(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = np.stack(vectors.to_list()).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def calibrated(dim: int, cosine: float, words: int, filters: float, seed: int, recall: float) -> CapFilters | None:
    """Filters of which a pair at ``cosine`` shares one with a probability of ``recall``, or none if that takes too many.

    The number of filters a vector passes is doubled from ``filters`` up to 16 times. The seed
    is fixed, so that all tasks make the same.
    """
    for times in (1, 2, 4, 8, 16) if dim > 1 else ():
        made = CapFilters(dim, words, filters * times, int(filters * times) // 2, seed)
        if made.recall(cosine) >= recall:
            return made
    return None


def close_rows(rows: pd.DataFrame, bits: int) -> np.ndarray:
    """Which rows of tasks (sorted by task) have another one in their task whose sketch differs in at most ``bits`` bits.

    A task of one block is compared with itself, one of two blocks across them. Pairs of all
    tasks are numbered through and compared some at a time.
    """
    s = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    across = (rows["blk_i"] != rows["blk_j"]).to_numpy()
    other = (rows["blk"] != rows["blk_i"]).to_numpy()
    task = rows["task"].to_numpy()
    end = np.append(np.flatnonzero(task[1:] != task[:-1]) + 1, len(task))
    after = np.repeat(end, np.diff(end, prepend=0)) - np.arange(len(task)) - 1  # rows of the task after each
    total, at, close = np.cumsum(after), 0, np.zeros(len(task), bool)
    while at < len(task):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
        n = after[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        pairs = ~across[i] | (other[i] != other[j])
        differ = np.zeros(len(i), np.int64)
        for k in range(s.shape[1]):
            differ += np.bitwise_count(s[i, k] ^ s[j, k])
        near = pairs & (differ <= bits)
        close[i[near]] = close[j[near]] = True
        at = stop
    return close


def close_in_filters(reps: DataFrame, cosine: float, filters: float = 48, words: int | None = None, recall: float = 0.998, seed: int = 11, block_rows: int = 2048) -> DataFrame:
    """(task, rep, other, across): the rows of ``reps`` (rep, label, vector of doubles) that share a filter with one close by sketch.

    The number of filters follows the number of rows (``code_words``), so that a filter holds
    about as many at every size; a filter of many rows is many tasks. Where no affordable
    number of filters a vector reaches ``recall`` at ``cosine`` (low cosines, one dimension),
    all vectors of a label share one. Vectors stay where they are: filters and sketches meet.
    """
    words = words or code_words(reps.count(), filters)
    bits = sketch_bits(cosine)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple[CapFilters | None, CapFilters]] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                if dim not in made:
                    found = calibrated(dim, cosine, words, filters, seed, recall)
                    made[dim] = found, found or CapFilters(dim, 1, 1, 1, seed)
                caps, sketches = made[dim]
                x = _units(part["vector"])
                step = max(1, min(1000, 8_000_000 // words))
                for at in range(0, len(x), step):
                    some = x[at : at + step]
                    rows, passed = caps.passed(some) if caps else (np.arange(len(some)), np.full(len(some), -1))
                    packed = np.array([r.tobytes() for r in sketches.sketch(some)], object)
                    yield pd.DataFrame({"rep": part["rep"].to_numpy()[rows + at], "kind": part["kind"].to_numpy()[rows + at], "filter": passed, "sketch": packed[rows]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(batches, 8 * block_rows):
            rows = rows.sort_values("task", kind="stable")
            near = rows[close_rows(rows, bits)]
            yield pd.DataFrame({"task": near["task"], "rep": near["rep"], "other": near["blk"] != near["blk_i"], "across": near["blk_i"] != near["blk_j"]})

    kind = F.xxhash64("label", F.size("vector"))
    passed = reps.select("rep", "vector", kind.alias("kind")).repartition("rep").mapInPandas(dealt, "rep long, kind long, filter long, sketch binary")
    rows = passed.select(F.xxhash64("kind", "filter").alias("key"), "rep", "sketch")
    tasks = split_hot(rows, ["key"], F.col("rep"), block_rows).withColumn("task", F.xxhash64("key", "blk_i", "blk_j"))
    return tasks.select("task", "rep", "sketch", "blk", "blk_i", "blk_j").repartition("task").sortWithinPartitions("task").mapInPandas(met, "task long, rep long, other boolean, across boolean")


def filter_links(reps: DataFrame, close: DataFrame, cosine: float, block_rows: int = 512) -> DataFrame:
    """Links (rep, parent) within ``cosine``, in double precision, among the rows that met in a task of ``close``: a spanning forest of each task's."""

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(batches, 4 * block_rows):
            rep, parents = rows["rep"].to_numpy(), rows["rep"].to_numpy().copy()
            for a, b in zip(*runs(rows["task"].to_numpy()), strict=True):
                unit, other = _units(rows["vector"].iloc[a:b]), rows["other"].to_numpy()[a:b]
                across, parent = rows["across"].iat[a], np.arange(b - a)
                first = np.flatnonzero(~other) if across else np.arange(b - a)
                second = np.flatnonzero(other) if across else first
                for at in range(0, len(first), block_rows):
                    some = first[at : at + block_rows]
                    i, j = np.nonzero(unit[some] @ unit[second].T >= cosine)
                    i, j = some[i], second[j]
                    apart = i != j
                    parent = forest(i[apart], j[apart], b - a, parent)
                parents[a:b] = rep[a + parent]
            linked = rep != parents
            yield pd.DataFrame({"rep": rep[linked], "parent": parents[linked]})

    rows = close.join(reps.select("rep", "vector"), "rep").select("task", "rep", "other", "across", "vector")
    return rows.repartition("task").sortWithinPartitions("task").mapInPandas(verified, "rep long, parent long").distinct()


def link_counts(reps: DataFrame, groups: DataFrame, cosine: float, block_rows: int = 512) -> DataFrame:
    """(rep, others): how many vectors of its component a row is linked with.

    ``reps`` is (rep, label, vector, n), n rows being equal to each; ``groups`` is (node,
    component), components of links: all that a row is linked with is in its own. The vectors
    of a component are compared in double precision by products of blocks; a large one is many
    bounded tasks, and no pair leaves its task. A row comes once from each task it is in.
    """

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_tasks(batches, 4 * block_rows):
            rep, n, x, other = rows["rep"].to_numpy(), rows["n"].to_numpy(), rows["vector"], (rows["blk"] != rows["blk_i"]).to_numpy()
            others = np.zeros(len(rows), np.int64)
            for a, b in zip(*runs(rows["task"].to_numpy()), strict=True):
                unit, own = _units(x.iloc[a:b]), np.flatnonzero(~other[a:b])
                across = rows["blk_i"].iat[a] != rows["blk_j"].iat[a]
                second = np.flatnonzero(other[a:b]) if across else own
                near = unit[own] @ unit[second].T >= cosine
                if not across:
                    np.fill_diagonal(near, False)
                others[a + own] += near @ n[a + second]
                if across:
                    others[a + second] += near.T @ n[a + own]
            yield pd.DataFrame({"rep": rep, "others": others})

    rows = reps.join(groups, reps["rep"] == groups["node"])
    tasks = split_hot(rows, ["component"], F.col("rep"), block_rows).withColumn("task", F.xxhash64("component", "blk_i", "blk_j"))
    return tasks.select("task", "rep", "n", "vector", "blk", "blk_i", "blk_j").repartition("task").sortWithinPartitions("task").mapInPandas(compared, "rep long, others long")


def embedding_classes(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", cosine: float = 0.98, **options) -> DataFrame:
    """(id, n_links, component_id, kept) of each vector.

    Vectors are compared only with equal, non-null labels and equal length; one that is null,
    all zero, or holds a null or non-finite component links with nothing. ``n_links`` counts
    the other rows within ``cosine`` (in double precision), ``component_id`` is the smallest id
    reachable, ``kept`` says that it is the row's own. Rows that repeat an id and vector count
    as vectors of their own, one that repeats with other vectors takes the links of all of
    them; rows with a null id are left out.

    Vectors of any length are taken whole; an empty table gives none; of other columns, whatever
    their names, nothing is read. Among links there are no ties to break, and equal cosines are
    links alike.

    Equal vectors are one representative with a count before anything is joined, so a vector
    that a third of all rows hold costs no more than another; its rows meet again only in an
    equi-join on the vector, which Spark can split. Pairs are verified only where both pass a
    filter and their sketches are close, and only verified links are closed to components; the
    links of a row are then counted in its component, where they all are. Filters miss a pair
    only if none of the filters of the one (``filters`` on average) is passed by the other: the
    number is raised until simulated pairs at the bound share one with a probability of
    ``recall``. Sketches of 256 bits drop pairs that are six deviations and more from what the
    bound lets expect.
    """
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(_usable(vector, F.col(label_col)), vector).alias("vector"), F.col(label_col).alias("label"))
    usable = rows.where("vector is not null")
    reps = checkpoint(usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    close = written(close_in_filters(reps.select("rep", "label", "vector"), cosine, **options), "close-vectors")
    groups = components(filter_links(reps, close, cosine), "rep", "parent")
    linked = link_counts(reps, groups, cosine).groupBy(F.col("rep").alias("a")).agg(F.sum("others").alias("others"))
    known = reps.join(linked, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = usable.join(known, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", "n_links", "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
