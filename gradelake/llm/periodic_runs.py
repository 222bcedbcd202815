"""Periodic runs of words: bit planes of word numbers, compared with themselves shifted by every lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_SIEVED = 4096  # words from which on lags are looked through by samples before planes are


def planes(numbers: np.ndarray) -> list[int]:
    """One integer for each bit of the numbers: bit i of it is that bit of number i."""
    bits = int(numbers.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits(numbers >> b & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def long_stretches(bits: int, least: int) -> Iterator[tuple[int, int]]:
    """(first, length) of the maximal stretches of ones that are ``least`` long or longer.

    A bit is kept if the ``least`` bits from it on are ones: by AND with itself shifted, over
    stretches twice as long each time. What is left of a stretch of n is n - least + 1 bits.
    """
    have = 1
    while have < least and bits:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    at = 0
    while bits:
        gap = (bits & -bits).bit_length() - 1
        bits >>= gap
        size = (~bits & (bits + 1)).bit_length() - 1
        yield at + gap, size + least - 1
        bits >>= size
        at += gap + size


def possible_lags(numbers: np.ndarray) -> Iterator[int]:
    """The lags a run can have, up to a quarter of the words.

    A run of lag q repeats at least 3q places, so it holds a multiple of q with its next four
    words repeated (for q from 4 on): long texts look at the multiples alone, n log n in all,
    and leave out the lags where none is. No lag of a run is left out.
    """
    n = len(numbers)
    most = n // 4
    if n < _SIEVED:
        yield from range(1, most + 1)
        return
    x = numbers.astype(np.uint64) + np.uint64(1)
    four = x[:-3].copy()
    for k in range(1, 4):
        four = four * np.uint64(0x9E3779B97F4A7C15) + x[k : n - 3 + k]
    yield from range(1, min(4, most + 1))
    for q in range(4, most + 1):
        every = four[::q]
        if (every[1:] == every[:-1]).any():
            yield q


def find_runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least 6 words and 4 periods, by start, then period.

    For each lag the planes XOR their shifted selves mark the places that differ, OR over all
    planes; a stretch without a mark is a repetition. One that a smaller lag gave already (its
    divisor) has a smaller period and is not told again. Most lags end at the first plane.
    """
    n = len(numbers)
    bit_planes, whole = planes(numbers), (1 << n) - 1
    seen, found = set(), []
    for q in possible_lags(numbers):
        least = max(6 - q, 3 * q)
        if least > n - q:
            continue
        differ = 0
        for k, plane in enumerate(bit_planes):
            differ |= plane ^ (plane >> q)
            if k == 0 and next(long_stretches(~differ & (whole >> q), least), None) is None:
                break
        else:
            for start, size in long_stretches(~differ & (whole >> q), least):
                if (start, size + q) not in seen:
                    seen.add((start, size + q))
                    found.append((start, size + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of each run its first period stays unless another run drops it."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


def _judge(text: str | None) -> tuple[int, list[dict[str, int]], str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    number: dict[bytes, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = find_runs(numbers) if len(words) >= 6 else []
    left = b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")
    return len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], left


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period) and ``collapsed`` (the text without repeated periods).

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q,
    of at least 6 words and 4 periods, as long as the period holds on both sides. One narrow
    pass, no shuffle: a task holds one batch of texts, the planes of one text (a bit for each
    word and plane) and nothing that grows with the table.

    Null and empty texts have no words and no runs; texts of any length are compared whole, at
    every lag; repeated rows get equal results, ties of runs go by start, then period; an empty
    table gives none; other columns pass through, one of a result's name is replaced.
    """

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_judge(t) for t in texts], columns=["n_words", "runs", "collapsed"])

    # The result is taken apart a step later, so that the function runs once a row.
    rows = docs.withColumn("_found", judged.asNondeterministic()(F.col(text_col)))
    return rows.withColumns({c: F.col(f"_found.{c}") for c in ("n_words", "runs", "collapsed")}).drop("_found")
