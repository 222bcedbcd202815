"""Substring dedup: bytes covered by strings that also start in an earlier document.

Every window of ``length`` bytes belongs to its least hash of ``GRAM``-byte grams, so equal
windows of different documents belong to the same hash. Hashes that a single document holds
are left out first; what is left is cut into fragments (maximal runs of windows of one hash),
equal fragments become one, and a suffix array over the fragments of each shard tells which
windows are equal. Exact copies of whole texts are set aside before all that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import checkpoint
from gradelake.llm.shared_keys import over_runs, runs, shared_keys, unpacked
from gradelake.llm.suffix_array import common_prefixes, suffix_array

GRAM = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOGETHER = 200_000  # bytes of texts hashed in one call
_SHARD = 2_000_000  # bytes of fragments in one suffix array
_FRAGMENT = ["key", "id", "start", "end", "fragment"]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the least hash (40 bits) of the grams in it."""
    if len(data) < length:
        return np.empty(0, np.int64)
    x = data.astype(np.uint64) + np.uint64(1)
    gram = min(GRAM, length)
    h = over_runs(x, gram, lambda a, b, n: a * _power(n) + b)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = (h >> np.uint64(24)).astype(np.int64)
    return over_runs(h, length - gram + 1, lambda a, b, n: np.minimum(a, b))


def windows(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, text, start) of the runs of windows of one key, some texts at a time."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < _TOGETHER):
            size += len(texts[last])
            last += 1
        sizes = np.array([len(t) for t in texts[first:last]])
        keys = window_keys(np.frombuffer(b"".join(texts[first:last]), np.uint8), length)
        row, end = np.repeat(np.arange(first, last), sizes)[: len(keys)], np.repeat(np.cumsum(sizes), sizes)[: len(keys)]
        at = np.flatnonzero(np.arange(len(keys)) + length <= end)  # no window reaches into the next text
        if len(at):
            keys, row = keys[at], row[at]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]))
            yield keys[new], row[new], at[new] - (np.cumsum(sizes) - sizes)[row[new] - first]
        first = last


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of byte ranges, touching ones joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(ends)) - 1]


def shard_repeats(texts: list[bytes], keys: np.ndarray, least: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(fragment, start, end) of the maximal runs of windows that a fragment with a smaller ``least`` id has too.

    ``keys`` are the fragments' hashes; fragments whose hash no other fragment has cannot
    share a window and stay out of the suffix array.
    """
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    picked = np.flatnonzero(counts[inverse] > 1)
    if not len(picked):
        return
    n = np.array([len(texts[i]) for i in picked])
    begin = np.cumsum(n + 1) - (n + 1)
    owner = np.repeat(np.arange(len(n)), n + 1)
    t = np.frombuffer(b"\0".join([*(texts[i] for i in picked), b""]), np.uint8).astype(np.int64) + 2
    t[begin + n] = 1  # parts fragments; bytes are 2 and more
    t = np.append(t, 0)
    sa = suffix_array(t, 258)
    shared = common_prefixes(t, sa)
    left = np.append((begin + n)[owner], 0) - np.arange(len(t))  # bytes of the fragment from here on
    order = sa[left[sa] >= length]
    # A suffix without a whole window never stands between two equal windows, with which it
    # would have to share ``length`` symbols; so equal windows are neighbours in this order.
    new = shared[order] < length
    new[:1] = True
    ids = least[picked][owner[order]]
    first = np.minimum.reduceat(ids, np.flatnonzero(new))
    earlier = first[np.cumsum(new) - 1] < ids
    flag = np.zeros(len(t) + 1, np.int8)
    flag[order[earlier]] = 1
    edges = np.diff(flag, prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for k, a, b in zip(owner[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
        yield int(picked[k]), a - int(begin[k]), b - int(begin[k]) + length - 1


def repeated_ranges(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = 50, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, starts, ends) of the byte ranges to remove, the texts by id they were found in)."""

    def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)), *((k, r) for k, r, _ in windows([t.encode("utf-8", "replace") for t in texts], length))]
        keys, row = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((row, keys))
        keys, row = keys[order], row[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])[: len(keys)]
        return keys[new], row[new]

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fragments by hash, one of each kind in a batch, its least id; what else holds it in the batch loses it (kind 1)."""
        for batch in batches:
            least: dict[bytes, tuple[int, int, list[int]]] = {}
            lost: list[tuple[int, int, int]] = []
            batch = batch.sort_values("id")
            ids, texts = batch["id"].to_list(), [t.encode("utf-8", "replace") for t in batch["text"]]
            wanted = [np.unique(unpacked(packed)) for packed in batch["hs"]]
            for keys, row, start in windows(texts, length):
                stop = np.append(start[1:], 0)
                last = np.append(row[1:] != row[:-1], True)
                stop[last] = [len(texts[r]) - length + 1 for r in row[last]]
                for a, b in zip(*runs(row), strict=True):
                    r = int(row[a])
                    at = np.minimum(np.searchsorted(wanted[r], keys[a:b]), len(wanted[r]) - 1)
                    hit = a + np.flatnonzero(wanted[r][at] == keys[a:b])
                    doc, data = ids[r], texts[r]
                    for x, y, h in zip(start[hit].tolist(), (stop[hit] + length - 1).tolist(), keys[hit].tolist(), strict=True):
                        fragment = data[x:y]
                        first = least.setdefault(fragment, (doc, h, []))
                        if first[0] < doc:
                            lost.append((doc, x, y))
                        else:
                            first[2].append(x)  # equal ones in one document say nothing of each other
            out = [(h, doc, x, 0, fragment) for fragment, (doc, h, xs) in least.items() for x in xs]
            yield pd.DataFrame(out, columns=["key", "id", "start", "end", "fragment"])
            if lost:
                ids, starts, ends = zip(*lost, strict=True)
                yield pd.DataFrame({"key": ids, "id": ids, "start": starts, "end": ends, "fragment": b""})

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ranges to remove (with an end), told by whole keys at a time, and of a key too large for that its windows (without)."""
        held, size, over = [], 0, None

        def joined() -> pd.DataFrame:
            return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)

        for batch in batches:
            known = (batch["end"] > 0).to_numpy()
            if known.any():
                yield gone(batch["id"][known], batch["start"][known], batch["end"][known])
                batch = batch[~known]
            if over is not None:
                same = (batch["key"] == over).to_numpy()
                yield from windowed(batch[same])
                batch = batch[~same]
            if not len(batch):
                continue
            held.append(batch)
            size += int(batch["fragment"].map(len).sum())
            if size < _SHARD:
                continue
            rows = joined()
            whole = (rows["key"] != rows["key"].iat[-1]).to_numpy()
            if whole.any():
                yield told(rows[whole])
                rows = rows[~whole]
            # What is left is one key: of equal fragments the earliest document's stay, the others have lost them.
            rows, later = collapsed(rows)
            yield gone(later["id"], later["start"], later["start"] + later["fragment"].map(len))
            held, size = [rows], int(rows["fragment"].map(len).sum())
            if size >= 2 * _SHARD and rows["fragment"].map(len).max() > length:
                yield from windowed(rows)
                held, size, over = [], 0, rows["key"].iat[0]
        if held:
            yield told(joined())

    def gone(ids, starts, ends) -> pd.DataFrame:
        rows = pd.DataFrame({"id": np.asarray(ids, np.int64), "start": np.asarray(starts, np.int64), "end": np.asarray(ends, np.int64)})
        return rows.assign(key=rows["id"], fragment=b"")[_FRAGMENT]

    def windowed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for at in range(0, len(rows), 2000):
            out = [(xxhash.xxh64_intdigest(w := x[k : k + length]) >> 24, doc, start + k, 0, w) for doc, start, x in rows[["id", "start", "fragment"]].iloc[at : at + 2000].itertuples(index=False) for k in range(len(x) - length + 1)]
            yield pd.DataFrame(out, columns=_FRAGMENT)

    def collapsed(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        rows = rows.sort_values(["fragment", "id"], kind="stable").reset_index(drop=True)
        one = ~rows.duplicated("fragment").to_numpy()
        least = rows["id"].to_numpy()[one][np.cumsum(one) - 1]
        later = rows["id"].to_numpy() > least
        return rows[~later], rows[later]

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        """The ranges that the occurrences of a shard lose."""
        rows, later = collapsed(rows)  # an earlier document has all of it
        one = ~rows.duplicated("fragment").to_numpy()
        distinct = rows[one]
        ids, starts = rows["id"].to_numpy(), rows["start"].to_numpy()
        out = [np.stack([later["id"], later["start"], later["start"] + later["fragment"].map(len)], 1).astype(np.int64)]
        of = np.append(np.flatnonzero(one), len(rows))
        for k, a, b in shard_repeats(distinct["fragment"].to_list(), distinct["key"].to_numpy(), distinct["id"].to_numpy(), length):
            out += [[(ids[r], starts[r] + a, starts[r] + b)] for r in range(of[k], of[k + 1])]
        return gone(*np.concatenate(out).T)

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for starts, ends in zip(batch["starts"], batch["ends"], strict=True):
                x, y = _covered(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
                a.append(x), b.append(y)
            yield pd.DataFrame({"id": batch["id"], "starts": a, "ends": b})

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # All three uses below read this one exchange.
    texts = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    # Exact copies first: one with an earlier equal text loses all that is long enough.
    digests = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n"))
    least = digests.groupBy("digest").agg(F.min("id").alias("first"))
    copies = checkpoint(digests.join(least, "digest").where("id > first").select("id", "n").distinct())
    # An anti join would be moved below the exchange and shuffle the texts on its own.
    firsts = texts.join(copies.select("id", F.lit(1).alias("copy")), "id", "left").where("copy is null").select("id", "text")
    wanted = shared_keys(firsts, keys_of, buckets)
    cut = texts.join(wanted, "id").mapInPandas(fragments, "key long, id long, start int, end int, fragment binary")
    kinds = "key long, id long, start int, end int, fragment binary"
    # A key with too many different contexts comes back as single windows, dealt by what they are;
    # ranges pass the second time as they are. All is one query, which reads the texts' exchange.
    first = cut.repartition("key").sortWithinPartitions("key").mapInPandas(shards, kinds)
    second = first.repartition("key").sortWithinPartitions("key").mapInPandas(shards, kinds)
    found = second.select("id", "start", "end").unionByName(copies.where(F.col("n") >= length).select("id", F.lit(0).alias("start"), F.col("n").alias("end")))
    ranges = found.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return ranges.mapInPandas(united, "id long, starts array<int>, ends array<int>"), texts


def suffix_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = 50, buckets: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, starts, ends, kept) per row: the text less each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    Texts are UTF-8 bytes, matches never cross documents, overlaps count and strings are judged
    on the input. ``starts`` and ``ends`` are the maximal removed runs, ``kept`` the other bytes
    end to end (binary). A null or empty text has no bytes; rows with a null id lose nothing and
    take nothing from others. Rows that repeat an id are one document: they take nothing from
    each other, and each loses the byte ranges that any of them loses, cut to its own length
    (with equal texts, these are its own).

    Of a hash or fragment that many documents hold, a batch sends one. ``buckets`` (see
    ``shared_keys``) bounds what a task holds. A hash with so many different contexts that they
    fill two shards is dealt out again, window by window. Texts of any length are taken whole,
    an empty table gives none, and of other columns, whatever their names, nothing is read; ids
    are whole numbers.
    """
    ranges, texts = repeated_ranges(docs, text_col, id_col, length, buckets)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, starts, ends in zip(batch["id"], batch["text"], batch["starts"], batch["ends"], strict=True):
                data = (text or "").encode("utf-8", "replace")
                starts, ends = ([], []) if starts is None else ([a for a in starts if a < len(data)], [min(b, len(data)) for a, b in zip(starts, ends, strict=True) if a < len(data)])
                left = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
                out.append((doc, len(data), len(data) - len(left), starts, ends, left))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "starts", "ends", "kept"]).astype({"id": "Int64"})

    kinds = "id long, n_bytes long, n_removed long, starts array<int>, ends array<int>, kept binary"
    rest = docs.where(F.col(id_col).isNull() | F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    none = F.lit(None).cast("array<int>")
    rest = rest.withColumns({"starts": none, "ends": none}).mapInPandas(kept, kinds)
    # United only after the map: a union below would give the texts' exchange a plan of its own.
    return texts.join(ranges, "id", "left").mapInPandas(kept, kinds).unionByName(rest).withColumnRenamed("id", id_col)
