"""A Katz backoff language model: counted, stored and looked up in slices of its tables.

Words are known by 48 bits of a hash. Pairs of words live in slices by the first of the two
(the history), each a bounded share of the text; what a task finds is sorted and packed into
one row for each slice, so that shuffles move arrays and not a row for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import setting, written

MOST = 5  # counts up to this are discounted
HOT = 1 << 22  # at most so many words can have a share of 1 / HOT of the text: these go to all tasks
SLICE = 4_000_000  # words of the text for each slice of the tables
_FLUSH = 2_000_000  # words of one task held before they are sorted and passed on
_BYTES = 6
_MASK = np.uint64((1 << 8 * _BYTES) - 1)
#: No word is empty or holds a blank, so these hashes stand for the borders of a text.
START, END = (xxhash.xxh64_intdigest(x) & int(_MASK) for x in (b"", b" "))


def pack(x: np.ndarray, width: int = _BYTES) -> bytes:
    """Numbers of 48 bits, 6 bytes each, or of less."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, width: int = _BYTES) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their steps, in as few bytes each as the largest step needs (the first byte tells)."""
    steps = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + pack(steps, width)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data[1:], data[0]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pair_code(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h) + w) >> np.uint64(16)


def _runs(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in runs of at most 1,000 texts and, but for longer ones, _FLUSH words: a word and what parts it off are two bytes at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        before = size[begin - 1] if begin else 0
        end = min(max(int(np.searchsorted(size, before + 2 * _FLUSH, "right")), begin + 1), begin + 1000)
        yield column.slice(begin, end - begin)
        begin = end


class Gathered:
    """The words of some texts, numbered by first appearance from 2: numbers 0 and 1 are the borders.

    A word is what ASCII white space parts, with A to Z in lower case.
    """

    def __init__(self):
        self.words: list[pa.Array] = []
        self.tokens: list[np.ndarray] = []
        self.texts = self.size = 0

    def add(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text: its words and one end."""
        parted = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        words = parted.flatten()
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at the ends part off empty ones
        places = np.concatenate([[0], np.cumsum(parted.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        tokens = np.diff(np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[places]) + 1
        self.words.append(words if real.all() else words.filter(pa.array(real)))
        self.tokens.append(tokens)
        self.texts += len(texts)
        self.size += int(tokens.sum())
        return tokens

    @property
    def full(self) -> bool:
        return self.size >= _FLUSH or self.texts >= 60_000

    @cached_property
    def _encoded(self) -> pa.DictionaryArray:
        words = pa.concat_arrays(self.words)
        self.words.clear()
        return words.dictionary_encode()

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each token, in order, and the place after each text's last one."""
        ends = np.cumsum(np.concatenate(self.tokens))
        x = np.ones(self.size, np.uint64)
        inside = np.ones(self.size, bool)
        inside[ends - 1] = False
        x[inside] = self._encoded.indices.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(2)
        return x, ends

    def hashes(self) -> np.ndarray:
        words = self._encoded.dictionary.cast(pa.large_binary())
        _, places, data = words.buffers()
        at = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
        word = (data.to_pybytes() if data else b"").__getitem__
        found = np.fromiter(map(xxhash.xxh64_intdigest, map(word, map(slice, at, at[1:]))), np.uint64, len(words)) & _MASK
        return np.concatenate([np.array([START, END], np.uint64), found])

    def triples(self) -> np.ndarray:
        """history << 40 | word << 16 | text, one for each word and end, in order."""
        x, ends = self.numbered()
        history = np.concatenate([np.zeros(1, np.uint64), x[:-1]])
        history[ends[:-1]] = 0
        of = np.repeat(np.arange(self.texts, dtype=np.uint64), np.concatenate(self.tokens))
        return np.sort(history << np.uint64(40) | x << np.uint64(16) | of)


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c): how often each word occurs in ``texts`` (text), the end of a text counted as one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()

        def out() -> pa.RecordBatch:
            hashes = held.hashes()
            n = np.bincount(held.numbered()[0].astype(np.int64), minlength=len(hashes))
            return pa.RecordBatch.from_arrays([pa.array(hashes[1:].astype(np.int64)), pa.array(n[1:])], ["w", "c"])

        for batch in batches:
            for some in _runs(batch.column("text")):
                held.add(some)
                if held.full:
                    yield out()
                    held = Gathered()
        if held.texts:
            yield out()

    found = texts.select("text").mapInArrow(counted, "w long, c long")
    return found.groupBy("w").agg(F.sum("c").alias("c"))


def discounts(seen: list[int]) -> list[float]:
    """Katz's factors for counts 1 to MOST, from the numbers of grams seen 1 to MOST + 1 times (Good-Turing).

    Where these do not fall as they should (small tables), fewer counts are discounted; at worst none.
    """
    for k in range(MOST, 0, -1):
        n = [0, *seen]
        if min(n[1 : k + 2]) <= 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return d + [1.0] * (MOST - k)
    return [1.0] * MOST


@dataclass
class Words:
    """What all tasks know of single words: totals, factors, and the words that are not rare."""

    total: int
    distinct: int
    ends: int
    factors: list[float]
    seen_once: int
    slices: int
    hot: np.ndarray
    counts: np.ndarray

    @property
    def left(self) -> float:
        """The probability of a word that was never seen: what discounting took from the others, and not nothing."""
        discounted = sum(1 - d for d in self.factors)
        return self.seen_once / self.total if discounted and self.total else 1 / (self.total + 1)

    def probability(self, c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.factors, 1.0])[np.minimum(c, MOST + 1)]
        return d * c / (self.total if any(x < 1 for x in self.factors) else self.total + 1)

    def probability_column(self, c: Column) -> Column:
        d = F.element_at(F.array(*map(F.lit, [*self.factors, 1.0])), F.least(c, F.lit(MOST + 1)).cast("int"))
        return d * c / F.lit(float(self.total if any(x < 1 for x in self.factors) else self.total + 1))

    def index(self, w: np.ndarray) -> np.ndarray:
        """The places of words among the hot, from 1; 0 for others."""
        if not len(self.hot):
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
        return np.where(self.hot[at] == w, at + 1, 0)

    def look_up(self, w: np.ndarray) -> np.ndarray:
        """The counts of words, 0 for those not among the hot."""
        return np.concatenate([[0], self.counts])[self.index(w)]

    def pack(self, index: np.ndarray, w: np.ndarray) -> bytes:
        """Words by their place among the hot, 3 bytes each, then the hashes of the others."""
        return pack(index, 3) + pack(w[index == 0])

    def unpack(self, data: bytes, n: int) -> np.ndarray:
        index = unpack(data[: 3 * n], 3).astype(np.int64)
        w = np.concatenate([np.zeros(1, np.uint64), self.hot])[index]
        w[index == 0] = unpack(data[3 * n :])
        return w

    def spread(self, h: np.ndarray) -> np.ndarray:
        """Over how many slices a history's pairs are dealt: one, but for words that would fill several."""
        c = np.where(h == START, self.ends, self.look_up(h))
        return np.minimum(1 + c // SLICE, self.slices).astype(np.uint64)

    def slice_of(self, h: np.ndarray, w: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return ((mix(h) >> np.uint64(20)) + (mix(w) >> np.uint64(20)) % spread) % np.uint64(self.slices)


def _in_slices(held: Gathered, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """For each slice: histories and how many words follow each; words, packed, and how many places each has; the texts of the places."""
    x = held.triples()
    hashes = held.hashes()
    first = np.flatnonzero(np.concatenate([[True], x[1:] >> np.uint64(16) != x[:-1] >> np.uint64(16)]))
    places = np.diff(np.append(first, len(x)))
    pair = x[first] >> np.uint64(16)
    hn, wn = (pair >> np.uint64(24)).astype(np.int64), (pair & np.uint64(0xFFFFFF)).astype(np.int64)
    h, w, index = hashes[hn], hashes[wn], words.index(hashes)[wn]
    which = words.slice_of(h, w, words.spread(hashes)[hn]).astype(np.int64)
    order = np.argsort(which, kind="stable")
    which = which[order]
    ends = np.flatnonzero(np.concatenate([which[1:] != which[:-1], [True]])) + 1
    texts = (x & np.uint64(0xFFFF)).astype(np.uint16)
    begin = 0
    for end in ends:
        some = order[begin:end]
        new = np.flatnonzero(np.concatenate([[True], hn[some][1:] != hn[some][:-1]]))
        n = places[some]
        at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield int(which[begin]), h[some][new], np.diff(np.append(new, len(some))), words.pack(index[some], w[some]), n, texts[at]
        begin = end


PACKED = "slice int, h binary, n binary, w binary, c binary"


def packed_counts(texts: DataFrame, shared) -> DataFrame:
    """The pairs of ``texts`` (text) counted in each task, packed by slice."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = shared.value, Gathered()

        def out(held: Gathered) -> Iterator[pa.RecordBatch]:
            for s, h, n, w, places, _ in _in_slices(held, words):
                row = [[s], [pack(h)], [n.astype("<u4").tobytes()], [w], [places.astype("<u4").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], ["slice", "h", "n", "w", "c"])

        for batch in batches:
            for some in _runs(batch.column("text")):
                held.add(some)
                if held.full:
                    yield from out(held)
                    held = Gathered()
        if held.texts:
            yield from out(held)

    return texts.select("text").mapInArrow(counted, PACKED)


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of several parts put together by code: (code, h, w, c). The parts are used up."""
    h, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    code = pair_code(h, w)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    c = np.add.reduceat(c[order], first, dtype=np.int64)
    order = order[first]
    return code[first], h[order], w[order], c


HISTOGRAM = [f"n{r}" for r in range(1, MOST + 2)]
TABLES = f"slice int, code binary, r binary, h long, {', '.join(f'{n} long' for n in HISTOGRAM)}, more long, p double, w long, places long"


def pair_tables(packed: DataFrame, shared) -> DataFrame:
    """The stored tables of pairs, three kinds of rows in one.

    (slice, code, r, places): a slice's pairs by code with their counts, packed, and their sum. (h, n1.., more, p): of
    a history how many words follow it so many times, the total of more frequent ones, and the
    probability of the hot ones among them. (h, w): the rare words that follow it, whose
    probability has to be looked up.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        names = ["slice", "code", "r", "h", *HISTOGRAM, "more", "p", "w", "places"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), *[pa.int64()] * (MOST + 2), pa.float64(), pa.int64(), pa.int64()]

        def rows(n: int, **given) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

        def out(s: int, code: np.ndarray, h: np.ndarray, w: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield rows(1, slice=[s], code=[pack_sorted(code)], r=[np.minimum(c, 2**32 - 1).astype("<u4").tobytes()], places=[int(c.sum())])
            own, of = np.unique(h, return_inverse=True)
            known = words.look_up(w)
            columns = {f"n{r}": np.bincount(of[c == r], minlength=len(own)) for r in range(1, MOST + 2)}
            columns["more"] = np.bincount(of, np.where(c > MOST + 1, c, 0), minlength=len(own)).astype(np.int64)
            columns["p"] = np.bincount(of, words.probability(known), minlength=len(own))
            for a in range(0, len(own), 50_000):
                part = slice(a, a + 50_000)
                yield rows(len(own[part]), h=own[part].astype(np.int64), **{k: v[part] for k, v in columns.items()})
            rare = np.flatnonzero(known == 0)
            for a in range(0, len(rare), 50_000):
                part = rare[a : a + 50_000]
                yield rows(len(part), h=h[part].astype(np.int64), w=w[part].astype(np.int64))

        now, held, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {x: batch.column(x)[i].as_py() for x in ("slice", "h", "n", "w", "c")}
                if now is not None and r["slice"] != now:
                    yield from out(now, *_merged(held))
                    held, size = [], 0
                now = r["slice"]
                h = np.repeat(unpack(r["h"]), np.frombuffer(r["n"], "<u4"))
                held.append((h, words.unpack(r["w"], len(h)), np.frombuffer(r["c"], "<u4")))
                size += len(h)
                if len(held) > 1 and size > 1.5 * len(held[0][0]) + SLICE / 8:
                    held = [_merged(held)[1:]]
                    size = len(held[0][0])
        if held:
            yield from out(now, *_merged(held))

    return packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(merged, TABLES)


def histories(tables: DataFrame, counts: DataFrame, words: Words) -> tuple[DataFrame, list[float]]:
    """(h, c, more, log_left) of every history, and the factors of pairs.

    ``c`` is how many words follow it. Of these its followers have what their discounted counts
    leave; ``log_left`` is the weight of the lower order: what is left over the lower order's
    probability of all words that do not follow. Where no follower is discounted, one place
    ``more`` than there are is assumed, so that something is left.
    """
    sums = tables.where("n1 is not null").groupBy("h").agg(*[F.sum(c).alias(c) for c in (*HISTOGRAM, "more", "p")])
    rare = tables.where("w is not null").select("h", "w").join(counts, "w").groupBy("h").agg(F.sum(words.probability_column(F.col("c"))).alias("q"))
    sums = written(sums.join(rare, "h", "left"), "katz-histories")
    seen = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in HISTOGRAM]).first()
    factors = discounts([int(x) for x in seen])
    total = sum((r * F.col(f"n{r}") for r in range(1, MOST + 2)), F.col("more")).cast("double")
    kept = sum((d * r * F.col(f"n{r}") for r, d in enumerate([*factors, 1.0], 1)), F.col("more")).cast("double")
    taken = sum((F.col(f"n{r}") for r, d in enumerate(factors, 1) if d < 1), F.lit(0)) > 0
    unseen = F.greatest(1 - F.col("p") - F.coalesce("q", F.lit(0.0)), F.lit(words.left))
    left = F.when(taken, 1 - kept / total).otherwise(1 / (total + 1))
    return sums.select("h", total.cast("long").alias("c"), F.when(taken, 0).otherwise(1).alias("more"), F.log10(left / unseen).alias("log_left")), factors


def _by_slice(known: DataFrame, shared, parts) -> DataFrame:
    """Histories packed by slice and part in each task; a word that is dealt out is in all its slices."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, several = shared.value, parts.value
        names = ["slice", "part", "h", "c", "more", "log_left"]

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, c, more, log_left = (np.concatenate([b.column(x).to_numpy(zero_copy_only=False) for b in held]) for x in names[2:])
            h = h.astype(np.uint64)
            spread = words.spread(h).astype(np.int64)
            row = np.repeat(np.arange(len(h)), spread)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(spread) - spread, spread)
            of = (((mix(h) >> np.uint64(20))[row] + nth.astype(np.uint64)) % np.uint64(words.slices)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                at, s = row[some], int(of[some[0]])
                blobs = [pa.array([x], pa.binary()) for x in (pack(h[at]), pack(c[at]), more[at].astype("u1").tobytes(), log_left[at].astype("<f8").tobytes())]
                for part in range(several[s]):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int32()), *blobs], names)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 200_000:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    return known.select("h", "c", "more", "log_left").mapInArrow(dealt, "slice int, part int, h binary, c binary, more binary, log_left binary")


def _requests(rows: DataFrame, shared, parts) -> DataFrame:
    """The pairs of all texts packed by slice with the texts they stand in, and a row (key, id, n_tokens) for each text."""
    names = ["slice", "part", "h", "n", "w", "places", "texts", "keys", "key", "id", "n_tokens"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, several, held, keys = shared.value, parts.value, Gathered(), []
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64(), None, pa.int64()]

        def row(many: int, id_type: pa.DataType, **given) -> pa.RecordBatch:
            of = dict(zip(names, kinds, strict=True)) | {"id": id_type}
            return pa.RecordBatch.from_arrays([pa.array(given[c], of[c]) if c in given else pa.nulls(many, of[c]) for c in names], names)

        def out(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            all_keys = np.array(keys, "<i8")
            for s, h, n, w, places, texts in _in_slices(held, words):
                of, at = np.unique(texts, return_inverse=True)
                blobs = {"h": pack(h), "n": n.astype("<u4").tobytes(), "w": w, "places": places.astype("<u4").tobytes(), "texts": at.astype("<u2").tobytes(), "keys": all_keys[of].tobytes()}
                yield row(1, id_type, slice=[s], part=[keys[0] % int(several[s])], **{k: [v] for k, v in blobs.items()})

        for batch in batches:
            id_type, own, n_tokens = batch.column("id").type, batch.column("key").to_pylist(), []
            for some in _runs(batch.column("text")):
                keys += own[len(n_tokens) : len(n_tokens) + len(some)]
                n_tokens += held.add(some).tolist()
                if held.full:
                    yield from out(id_type)
                    held, keys = Gathered(), []
            yield row(len(own), id_type, key=own, id=batch.column("id"), n_tokens=n_tokens, part=[k % 2**31 for k in own])
        if held.texts:
            yield from out(id_type)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select(F.monotonically_increasing_id().alias("key"), "id", "text").mapInArrow(asked, f"slice int, part int, h binary, n binary, w binary, places binary, texts binary, keys binary, key long, id {kind}, n_tokens long")


class _Slice:
    """The tables of one slice, as its rows bring them."""

    def __init__(self):
        self.code, self.count = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.uint64), *[np.empty(0)] * 3)]

    def take_histories(self, h: bytes, c: bytes, more: bytes, log_left: bytes) -> None:
        self.parts.append((unpack(h), unpack(c).astype(float), np.frombuffer(more, "u1").astype(float), np.frombuffer(log_left, "<f8")))

    def take_pairs(self, code: bytes, count: bytes) -> None:
        self.code, self.count = unpack_sorted(code), np.frombuffer(count, "<u4")

    def history(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """c, more and log_left of histories, 0 for those never seen."""
        if len(self.parts) > 1:
            own = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            order = np.argsort(own[0])
            self.parts = [tuple(x[order] for x in own)]
        own, *values = self.parts[0]
        if not len(own):
            return tuple(np.zeros(len(h)) for _ in values)
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        met = own[at] == h
        return tuple(np.where(met, v[at], 0.0) for v in values)

    def counts(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(w), np.int64)
        asked = pair_code(h, w)
        at = np.minimum(np.searchsorted(self.code, asked), len(self.code) - 1)
        return np.where(self.code[at] == asked, self.count[at], 0).astype(np.int64)


def _evaluated(rows: DataFrame, shared, factors: list[float]) -> DataFrame:
    """(key, score, base, known) by text and slice; (key, w): places whose pair was not seen and whose word is rare, still to be looked up; the texts' own rows.

    A slice's tables come before what is asked of it, row by row: a task holds the tables of
    one slice and the questions of one task of texts.
    """
    id_kind = rows.schema["id"].dataType.simpleString()
    names = ["key", "score", "base", "known", "w", "id", "n_tokens"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        factor = np.array([1.0, *factors, 1.0])
        add_one = np.log10(words.total + words.distinct + 1)
        now, held = None, _Slice()

        def out(id_type: pa.DataType, **given) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), id_type, pa.int64()]
            n = len(given["key"])
            return pa.RecordBatch.from_arrays([pa.array(given[x], k) if x in given else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            column, id_type = batch.column, batch.column("id").type
            kinds = column("kind").to_numpy()
            if (kinds == 3).any():
                own = batch.filter(pa.array(kinds == 3))
                yield out(id_type, **{x: own.column(x) for x in ("key", "id", "n_tokens")})
            for i in np.flatnonzero(kinds != 3):
                get = lambda name, i=int(i), column=column: column(name)[i].as_py()
                if (get("slice"), get("part")) != now:
                    now, held = (get("slice"), get("part")), _Slice()
                if kinds[i] == 0:
                    held.take_histories(*map(get, ("h", "c", "more", "log_left")))
                elif kinds[i] == 1:
                    held.take_pairs(get("code"), get("r"))
                else:
                    h = unpack(get("h"))
                    places = np.frombuffer(get("places"), "<u4")
                    texts, keys = np.frombuffer(get("texts"), "<u2"), np.frombuffer(get("keys"), "<i8")
                    of = np.repeat(np.arange(len(h)), np.frombuffer(get("n"), "<u4"))
                    w = words.unpack(get("w"), len(of))
                    c, more, log_left = held.history(h)
                    # A word is counted where it is the history of the next: each once, but for the end.
                    word = h != START
                    base = np.where(word, np.log10(c + 1) - add_one, 0.0)
                    known = (word & (c > 0)).astype(float)
                    r = held.counts(h[of], w)
                    seen = r > 0
                    value = np.where(seen, np.log10(factor[np.minimum(r, MOST + 1)] * np.maximum(r, 1)) - np.log10(np.maximum(c + more, 1))[of], log_left[of])
                    single = words.look_up(w)
                    hot = ~seen & (single > 0)
                    value[hot] += np.log10(words.probability(single[hot]))
                    total = lambda x, places=places, texts=texts, keys=keys: np.bincount(texts, np.repeat(x, places), minlength=len(keys))
                    yield out(id_type, key=keys, score=total(value), base=total(base[of]), known=total(known[of]).astype(np.int64))
                    rest = np.repeat(~seen & (single == 0), places)
                    if rest.any():
                        yield out(id_type, key=keys[texts[rest]], w=np.repeat(w, places)[rest].astype(np.int64))

    schema = f"key long, score double, base double, known long, w long, id {id_kind}, n_tokens long"
    return rows.repartition("slice", "part").sortWithinPartitions("slice", "part", "kind").mapInArrow(looked_up, schema)


def katz_scores(docs: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row: a bigram model with Katz backoff, learned from the rows where ``learn``.

    Tokens are lower-cased words and one end; the history of the first word is a start that is
    no token. Pairs seen up to 5 times are discounted by Good-Turing, likewise single words; a
    pair that was not seen gets its word's probability times the history's exactly normalised
    weight, one whose history was not seen its word's alone. Words never seen are one word of
    the model, with the mass that discounting took. ``score`` is the log10 probability of all
    tokens, ``base_score`` that of single words by add-one.

    All rows teach and all are scored, in slices of the tables that follow the words: a hot
    history is dealt out by the words after it, a slice with too many places by tasks.
    Null and empty texts are one end; texts are read whole, of up to 2^24 different words each; rows that repeat
    teach and are scored each; rows where ``learn`` is null do not teach; with nothing to learn
    from, all scores are 0; an empty table gives no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    taught = rows.where("learn")
    counts = written(word_counts(taught), "katz-words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("w") == END, F.col("c"))), F.lit(0)), *[F.count_if(F.col("c") == r) for r in range(1, MOST + 2)]).first()
    total, distinct, ends, *seen = map(int, sums)
    hot = counts.where(F.col("c") * HOT >= total).orderBy("w").toPandas()
    words = Words(total, distinct, ends, discounts(seen), seen[0], 1 + total // SLICE, hot["w"].to_numpy(np.uint64), hot["c"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(words)
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "4m"):  # packed rows are large
        tables = written(pair_tables(packed_counts(taught, shared), shared), "katz-pairs")
    known, factors = histories(tables, counts, words)

    # A slice's places decide into how many parts its questions go; its tables go to each part.
    parts = np.ones(words.slices, np.int64)
    sliced = tables.where("code is not null").select("slice", "code", "r", F.floor(F.col("places") / (2 * SLICE)).cast("int").alias("more"))
    for r in sliced.where("more > 0").select("slice", "more").toLocalIterator():
        parts[r["slice"]] += r["more"]
    several = spark.sparkContext.broadcast(parts)
    asked = _requests(rows, shared, several)
    asked = asked.withColumn("kind", F.when(F.col("slice").isNull(), 3).otherwise(2))
    pairs = sliced.withColumn("part", F.explode(F.sequence(F.lit(0), "more"))).drop("more").withColumn("kind", F.lit(1))
    hist = _by_slice(known, shared, several).withColumn("kind", F.lit(0))
    every = asked.unionByName(pairs, allowMissingColumns=True).unionByName(hist, allowMissingColumns=True)
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "4m"):
        found = written(_evaluated(every, shared, factors), "katz-found")

    p = F.coalesce(words.probability_column(F.col("c")), F.lit(words.left))
    backed_off = found.where("w is not null").select("key", "w").join(counts, "w", "left").select("key", F.log10(p).alias("score"))
    sums = found.where("w is null").drop("w").unionByName(backed_off, allowMissingColumns=True)
    add_one = float(np.log10(total + distinct + 1))
    sums = sums.groupBy("key").agg(F.max("id").alias(id_col), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    base = F.col("base") + F.lit(float(np.log10(ends + 1)) - add_one)
    return sums.select(id_col, "n_tokens", (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
