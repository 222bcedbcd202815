"""Numbers for the words of texts, worked out over whole arrays of characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_AT_ONCE = 300_000  # characters handled in one step
_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def _classes() -> list[np.ndarray]:
    """By code point: whether it is white space, and whether it is part of a word's core (letters, digits, underscore)."""
    if not _tables:
        points = [chr(i) for i in range(0x110000)]
        _tables.append(np.fromiter(map(str.isspace, points), bool, len(points)))
        _tables.append(np.fromiter((c.isalnum() or c == "_" for c in points), bool, len(points)))
    return _tables


def mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * np.uint64((0xBF58476D1CE4E5B9 + 2 * k * 0x94D049BB133111EB) & (2**64 - 1) | 1) + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def stretch_numbers(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of stretches of ``x`` wherever they stand, from sums of powers up to each place."""
    power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)])
    return mix((sums[first + size] - sums[first]) * back[first] + size.astype(np.uint64), 3)


@dataclass
class Words:
    """The white-space-separated words of texts, in order: of which text and line, and a number for what they say."""

    row: np.ndarray  # index of the text
    line: np.ndarray  # a number for the line, rising
    line_at: np.ndarray  # by line: the place of its first character in its text
    number: np.ndarray  # of the core in lower case; all words without a core are alike
    empty: np.ndarray  # whether there is no core


def words(texts: list[str]) -> Words:
    """The words of texts. A word counts by its core: letters, digits and underscores in lower case, whatever stands between them."""
    space, core = _classes()
    parts, lines, first = [], 0, 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < _AT_ONCE):
            size += len(texts[last]) + 1
            last += 1
        joined = "\n".join(texts[first:last])
        lower = joined.lower()
        points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = points(lower)
        blank, inner = space[x], core[x]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        start, end = edges[::2], edges[1::2]
        # The core characters end to end: words are stretches of them.
        before = np.concatenate([[0], np.cumsum(inner)])
        a, b = before[start], before[end]
        number = stretch_numbers(x[inner].astype(np.uint64) + np.uint64(1), a, b - a) | np.uint64(1)
        line = np.cumsum(x == 10)[start] if len(start) else start
        ends = np.flatnonzero((x if len(lower) == len(joined) else points(joined)) == 10)
        line_at = np.concatenate([[0], ends + 1])
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])[:-1]
        of = np.searchsorted(text_at, line_at, "right") - 1
        parts.append((first + of[line], lines + line, line_at - text_at[of], number, a == b))
        lines += len(line_at)
        first = last
    if not parts:
        none = np.empty(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), none.astype(bool))
    return Words(*(np.concatenate(x) for x in zip(*parts, strict=True)))
