"""Which of many terms each of many texts holds: a trie of the terms, walked from all places of the texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_TEXT = 1 << 19  # bytes of texts that are walked at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Terms:
    """A trie of distinct terms, byte strings of one byte and more.

    A node is a number, 0 the root; its child by a byte is kept in an open hash table under
    (node, byte). The first two bytes are looked up in a table of all pairs of bytes.
    """

    def __init__(self, terms: list[bytes]):
        size = np.array([len(t) for t in terms], np.int64)
        at, text = np.cumsum(size) - size, np.frombuffer(b"".join(terms), np.uint8).astype(np.int64)
        node, alive = np.zeros(len(terms), np.int64), np.arange(len(terms))
        keys, ends, nodes, depth = [], [], 1, 0
        while len(alive):
            step, child = np.unique(node[alive] << 8 | text[at[alive] + depth], return_inverse=True)
            node[alive] = nodes + child
            keys.append(step)
            depth, nodes = depth + 1, nodes + len(step)
            ends.append(alive[size[alive] == depth])
            alive = alive[size[alive] > depth]
        self.term = np.full(nodes, -1, np.int32)
        ended = np.concatenate(ends or [alive])
        self.term[node[ended]] = ended
        self.size = size.astype(np.int32)
        self._store(np.concatenate(keys or [alive]))
        pairs = np.arange(1 << 16)
        one = self.child(np.zeros(1 << 16, np.int64), pairs >> 8)
        self.one = one[::256].copy()
        self.two = np.where(one > 0, self.child(one, pairs & 255), 0).astype(np.int32)

    def _store(self, keys: np.ndarray) -> None:
        """Keys are numbered from 1 in their order, as the nodes are; a key stands in the first free slot from its hash on."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.node = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            taken = self.key[slot] >= 0
            free, first = np.unique(slot[~taken], return_index=True)
            chosen = left[~taken][first]
            self.key[free], self.node[free] = keys[chosen], chosen + 1
            waits = self.key[slot] != keys[left]
            left, slot = left[waits], (slot[waits] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children of nodes by their bytes, 0 where there is none."""
        keys = node.astype(np.int64) << 8 | byte
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.node[slot], 0)
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            held = self.key[slot[on]]
            same = held == keys[on]
            out[on[same]] = self.node[slot[on[same]]]
            on = on[~same & (held >= 0)]
        return out

    def held(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of each term that a text holds, once, of texts that lie end to end from ``offsets`` on."""
        if not len(text):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        place, node, depth = np.arange(len(text)), self.one[text], 1
        found = []
        while len(place):
            term = self.term[node]
            ends = np.flatnonzero(term >= 0)
            p, term = place[ends], term[ends].astype(np.int64)
            inside = p + depth <= offsets[row[p] + 1]  # what goes on in the next text is not held
            found.append(row[p[inside]] << 32 | term[inside])
            if place[-1] + depth >= len(text):
                on = place + depth < len(text)
                place, node = place[on], node[on]
            node = self.two[text[place].astype(np.int64) << 8 | text[place + 1]] if depth == 1 else self.child(node, text[place + depth])
            on = np.flatnonzero(node)
            place, node, depth = place[on], node[on], depth + 1
        found = np.unique(np.concatenate(found))
        return found >> 32, found & 0xFFFFFFFF


def pairs_held(batches: Iterator[pa.RecordBatch], terms: Terms, first: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """Of batches whose last column is texts as binary, a row (name, other columns) of each term a text holds.

    The names of term t are ``names`` from ``first[t]`` to ``first[t + 1]``, end exclusive.
    """
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        others = [batch.column(i) for i in range(batch.num_columns - 1)]
        fields = ["concept", *batch.schema.names[:-1]]
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(at, at[start] + _TEXT, "right")) - 1)
            row, term = terms.held(body[at[start] : at[end]], at[start : end + 1] - at[start])
            n = first[term + 1] - first[term]
            name = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            row = pa.array(np.repeat(row, n) + start)
            if len(row):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(name)), *[c.take(row) for c in others]], names=fields)
            start = end
