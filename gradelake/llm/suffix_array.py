"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy."""

from __future__ import annotations

import numpy as np

_ROUNDS = 1000  # longest run of a type that is induced in rounds
_FEW = 1024  # alphabets of up to so many symbols are induced bucket by bucket in whole arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last counts as smaller."""
    n = len(t)
    less, differs = np.ones(n, bool), np.ones(n, bool)
    less[:-1], differs[:-1] = t[:-1] < t[1:], t[:-1] != t[1:]
    at = np.where(differs, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _spread(sa: np.ndarray, fill: np.ndarray, before: np.ndarray, chars: np.ndarray, down: bool) -> None:
    """Put suffixes at the ends of their buckets, in order; ``fill`` moves along."""
    o = np.argsort(chars, kind="stable")
    before, chars = before[o], chars[o]
    first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    sizes = np.diff(np.append(first, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(first, sizes)
    sa[fill[chars] - 1 - rank if down else fill[chars] + rank] = before
    fill[chars[first]] += -sizes if down else sizes


def _induce_few(t: np.ndarray, small: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    counts = np.bincount(t, minlength=k)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa, symbols = np.full(n, -1, np.int64), np.flatnonzero(counts)
    narrow = t.astype(np.uint16)
    low = tails.copy()
    _spread(sa, low, order[::-1], narrow[order[::-1]], True)
    fill = heads.copy()
    for c in symbols:
        lo = heads[c]
        while True:
            hi = fill[c]
            wave = sa[lo:hi] if lo < hi else sa[low[c] : tails[c]]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(sa, fill, before, narrow[before], False)
            if lo >= hi:
                break
            lo = hi
    end, fill = fill, tails.copy()
    for c in symbols[::-1]:
        hi = tails[c]
        while True:
            lo = fill[c]
            wave = (sa[lo:hi] if lo < hi else sa[heads[c] : end[c]])[::-1]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                _spread(sa, fill, before, narrow[before], True)
            if lo >= hi:
                break
            hi = lo
    sa[0] = n - 1
    return sa


def _induce_lists(t: np.ndarray, small: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    tails = np.cumsum(np.bincount(t, minlength=k))
    heads = [0, *tails[:-1].tolist()]
    symbols, is_small, sa = t.tolist(), small.tolist(), [-1] * n
    fill = tails.tolist()
    for i in order[::-1].tolist():
        fill[symbols[i]] -= 1
        sa[fill[symbols[i]]] = i
    for at in range(n):
        j = sa[at] - 1
        if j >= 0 and not is_small[j]:
            c = symbols[j]
            sa[heads[c]] = j
            heads[c] += 1
    fill = tails.tolist()
    for at in range(n - 1, -1, -1):
        j = sa[at] - 1
        if j >= 0 and is_small[j]:
            c = symbols[j]
            fill[c] -= 1
            sa[fill[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _settled(first: np.ndarray, then: np.ndarray, sub: np.ndarray, where: np.ndarray, unit: int) -> None:
    """Rank the suffixes ``where`` by first symbol, class of the next suffix and its rank, which is ranked alike.

    A rank is the place of the first suffix of its kind. A round takes the order one suffix
    further down the runs of a type, for suffixes not yet told apart; it ends when none are.
    """
    if not len(where):
        return
    n = len(sub)
    order = np.argsort(each := (first * unit + then) * n + sub[where + 1])
    each, live = each[order], where[order]
    place = np.arange(len(live))
    new = np.concatenate([[True], each[1:] != each[:-1]])
    rank = np.maximum.accumulate(np.where(new, place, 0))
    sub[live] = rank
    while True:
        tied = ~(new & np.append(new[1:], True))
        live, rank = live[tied], rank[tied]
        if not len(live):
            return
        order = np.argsort(each := rank * n + sub[live + 1])
        each, live, rank = each[order], live[order], rank[order]
        new = np.concatenate([[True], each[1:] != each[:-1]])
        whole = np.concatenate([[True], rank[1:] != rank[:-1]])
        if new.sum() == whole.sum():
            return
        place = np.arange(len(live))
        rank = rank + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(whole, place, 0))
        sub[live] = rank


def _induce_many(t: np.ndarray, small: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """As ``_induce_few``, for large alphabets: a type's suffixes are induced in rounds over whole arrays.

    A suffix goes by its first symbol and the suffix after it; in a bucket the larger type comes
    first. Long runs of one type, or numbers that do not fit, are left to lists.
    """
    n = len(t)
    edges = np.flatnonzero(np.concatenate([[True], small[1:] != small[:-1], [True]]))
    if np.diff(edges).max() > _ROUNDS or 2 * k * k * n >= 1 << 62:
        return _induce_lists(t, small, order, k)
    kind, sub = 2 * t + small, np.zeros(n, np.int64)
    sub[order] = np.arange(len(order))
    for where in (np.flatnonzero(~small), np.flatnonzero(small[:-1])):
        _settled(t[where], kind[where + 1], sub, where, 2 * k)
    return np.argsort(kind * n + sub)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Start places of all suffixes in order, in linear time, for symbols below ``k``.

    The last symbol must be 0 and occur nowhere else. Suffixes are classed as smaller or
    larger than the next; substrings between leftmost-smaller ones are sorted by inducing and
    named, the string of names is sorted by recursion unless all differ, and the order of all
    suffixes is induced from that.
    """
    t, n = np.asarray(t, np.int64), len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    induce = _induce_few if k <= _FEW else _induce_many
    small = _types(t)
    leftmost = np.zeros(n, bool)
    leftmost[1:] = small[1:] & ~small[:-1]
    places = np.flatnonzero(leftmost)
    by_symbol = places[np.argsort(t[places], kind="stable")]
    sa = induce(t, small, by_symbol, k)
    ordered = sa[leftmost[sa]]
    if len(ordered) > 1:
        size = np.ones(n, np.int64)
        size[places[:-1]] = np.diff(places) + 1
        a, b = ordered[:-1], ordered[1:]
        alike = size[a] == size[b]
        if alike.any():
            length = size[a[alike]]
            first = np.cumsum(length) - length
            inner = np.arange(length.sum()) - np.repeat(first, length)
            x, y = np.repeat(a[alike], length) + inner, np.repeat(b[alike], length) + inner
            alike[alike] = np.logical_and.reduceat((t[x] == t[y]) & (small[x] == small[y]), first)
        names = np.concatenate([[0], np.cumsum(~alike)])
        if names[-1] + 1 < len(names):
            of = np.empty(n, np.int64)
            of[ordered] = names
            ordered = places[suffix_array(of[places], int(names[-1]) + 1)]
    return induce(t, small, ordered, k)


def _sevens(t: np.ndarray) -> np.ndarray:
    """At each place, the seven symbols (below 512) from there on as one number; missing ones are 0."""
    out, rest = np.zeros(len(t), np.int64), t
    for k in range(min(7, len(t))):
        out[: len(t) - k] |= rest << (9 * (6 - k))
        rest = rest[1:]
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, how many symbols it shares with the suffix before it in order.

    Permuted by place, the value is one less than at the place before wherever both suffixes
    follow the same symbol; only at the other places are symbols compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] < 1) | (t[:-1] != t[before[1:] - 1])
    at = np.flatnonzero(fresh & (before >= 0))
    shared = np.zeros(len(at), np.int64)
    for step in (7, 1):  # seven symbols of up to nine bits at a time, then the rest one by one
        word = t if step == 1 else _sevens(t)
        live = np.arange(len(at)) if t.max(initial=0) < 512 or step == 1 else np.empty(0, int)
        while len(live):
            a, b = at[live] + shared[live], before[at[live]] + shared[live]
            inside = np.maximum(a, b) <= n - step
            live, a, b = live[inside], a[inside], b[inside]
            live = live[word[a] == word[b]]
            shared[live] += step
    out = np.zeros(n, np.int64)
    out[at] = shared
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.where(before >= 0, out[last] - (np.arange(n) - last), 0)
