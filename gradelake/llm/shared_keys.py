"""Which of a text's keys occur elsewhere too: packed by bucket, met in bounded tasks, told by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_ROW = 23  # bits below a key of 40
_PACKED = ["bucket", "kind", "id", "hs", "ids"]


def over_runs(x: np.ndarray, n: int, join) -> np.ndarray:
    """``join`` over every run of n values, by doubling: join(left, right, size of right)."""
    out, size, held = None, 1, x
    whole = 0
    while True:
        if n & size:
            if out is None:
                out, whole = held, size
            else:
                m = min(len(held) - whole, len(out))
                # out covers ``whole`` values; held covers ``size`` values after them
                out = join(out[: len(held) - whole], held[whole:], size) if m > 0 else out[:0]
                whole += size
        if whole == n:
            return out
        held = join(held[: max(0, len(held) - size)], held[size:], size)
        size *= 2


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal values."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return start, np.append(start[1:], len(values))


def five(h: np.ndarray) -> np.ndarray:
    """The five bytes of each key."""
    return np.ascontiguousarray(h.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5])


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """The keys of blobs of five bytes each, end to end."""
    low = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    h = np.zeros((len(low), 8), np.uint8)
    h[:, :5] = low
    return h.view("<i8").reshape(-1).astype(np.int64)


def by_id(h: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    """(id, hs): keys packed by the id that has them."""
    if not len(d):
        return pd.DataFrame({"id": np.empty(0, np.int64), "hs": []})
    order = np.argsort(d, kind="stable")
    d, low = d[order], five(h[order])
    a, b = runs(d)
    return pd.DataFrame({"id": d[a], "hs": [low[x:y].tobytes() for x, y in zip(a, b, strict=True)]})


def shared_keys(texts: DataFrame, keys_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], buckets: int | None = None) -> DataFrame:
    """(id, hs): for each document of ``texts`` (id, text) its keys that a second holder has, packed (see ``unpacked``).

    ``keys_of`` gives (key, index of the text) for a list of texts, keys below 2^40. Two
    holders are two documents, or one that gives a key twice.

    Keys travel in blobs by bucket, 5 bytes each and those of the id that differ, not as rows.
    A key with two holders in one batch is known there: all but one of them are told without
    a meeting, so a bucket gets one entry per batch of a key that a third of all documents
    hold. ``buckets`` (16 times the shuffle partitions by default) bounds what is held at a time.
    """
    return together(repeated_keys(texts, keys_of, buckets))


def together(repeated: DataFrame) -> DataFrame:
    """(id, hs): the blobs of each document of ``repeated_keys`` in one row."""
    return repeated.groupBy("id").agg(F.collect_list("hs").alias("hs"))


def repeated_keys(texts: DataFrame, keys_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], buckets: int | None = None) -> DataFrame:
    """(id, hs): as ``shared_keys``, a document's keys in several rows."""
    buckets = buckets or 16 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("id")
            h, row = keys_of(batch["text"].to_list())
            if not len(h):
                continue
            both = np.sort(h << _ROW | row)  # a batch has far fewer than 2^23 texts
            h, d = both >> _ROW, batch["id"].to_numpy()[both & ((1 << _ROW) - 1)]
            start, end = runs(h)
            known = np.repeat(end - start > 1, end - start)
            if known.any():
                yield by_id(h[known], d[known]).assign(bucket=lambda x: x["id"] % buckets, kind=1, ids=b"")[_PACKED]
            h, d = h[start], d[start]  # one of each key, to meet those of other batches
            bucket = h * buckets >> 40
            a, b = runs(bucket)
            low, wide = five(h), d.astype("<i8").view(np.uint8).reshape(-1, 8)
            # Byte by byte, so that the upper bytes of ids, which are alike, compress to nothing.
            yield pd.DataFrame({"bucket": bucket[a], "kind": 0, "id": 0, "hs": [low[x:y].tobytes() for x, y in zip(a, b, strict=True)], "ids": [wide[x:y].T.tobytes() for x, y in zip(a, b, strict=True)]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, hs, ids = None, [], []

        def close() -> pd.DataFrame:
            h = unpacked(hs)
            d = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1) for x in ids]).astype(np.int64)
            order = np.argsort(h, kind="stable")  # sorted stretches are merged
            h, d = h[order], d[order]
            start, end = runs(h)
            several = np.repeat(np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start), end - start)
            return by_id(h[several], d[several])

        for batch in batches:
            told = batch[batch["kind"] == 1]
            if len(told):
                yield told[["id", "hs"]]
            for b, h, d in zip(batch["bucket"], batch["hs"], batch["ids"], strict=True):
                if not len(d):
                    continue
                if b != bucket and hs:
                    yield close()
                    hs, ids = [], []
                bucket = b
                hs.append(h), ids.append(d)
        if hs:
            yield close()

    packed = texts.mapInPandas(dealt, "bucket int, kind int, id long, hs binary, ids binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(met, "id long, hs binary")
