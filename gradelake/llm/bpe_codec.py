"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.bpe import SHIFT, ByPiece, Vocabulary, load

_NEVER = 1 << 40


class Encoder:
    """Exact merges of a pre-token without merging.

    A row of tokens is the outcome of the merges just when each token is its own outcome and
    each neighbouring pair is compatible, that is, no merge across their border comes up while
    both sides are built. So the encoder takes the longest token at a position that is
    compatible with the last one and steps back where none is; a position once found dead
    stays dead, which makes the time linear.
    """

    def __init__(self, data: bytes):
        v = self.vocabulary = load(data, Vocabulary)
        self.merge, self.parts, self.pairs = v.merge, v.parts, {}
        self.lefts, self.rights = {}, {}  # spines, from the byte to the token
        valid = [True] * 256
        for t in range(256, len(v.text)):
            a, b = v.parts[t]
            valid.append(valid[a] and valid[b] and self._first_crossing(a, b) == t)
        self.size = list(map(len, v.text))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, ok in enumerate(valid):
            if ok:
                self.automaton.add_word(v.text[t].decode("latin-1"), t)
        self.automaton.make_automaton()
        self.whole = {v.text[t]: t for t, ok in enumerate(valid) if ok}
        self.pieces = ByPiece(self._ids_of, b"".join)

    def _spine(self, token: int, side: int) -> list[int]:
        kept = (self.lefts, self.rights)[side]
        if (out := kept.get(token)) is None:
            out, t = [token], token
            while self.parts[t]:
                t = self.parts[t][side]
                out.append(t)
            out.reverse()
            kept[token] = out
        return out

    def _first_crossing(self, a: int, b: int) -> int | None:
        """The first merge over the border of a and b, each built on its own; None: there is none.

        The border symbols of a exist from their own merge until that of the next one on the
        spine, and so do those of b. At the same rank the left one of two merges goes first.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            until_a = left[i + 1] if i + 1 < len(left) else _NEVER
            until_b = right[j + 1] if j + 1 < len(right) else _NEVER
            m = self.merge.get(left[i] << SHIFT | right[j])
            if m is not None and m < until_a and m <= until_b:
                return m
            if until_a is until_b is _NEVER or until_a == until_b == _NEVER:
                return None
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def _compatible(self, a: int, b: int) -> bool:
        key = a << SHIFT | b
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= 200_000:
                self.pairs.clear()
            ok = self.pairs[key] = self._first_crossing(a, b) is None
        return ok

    def tokens(self, word: bytes) -> list[int]:
        if (t := self.whole.get(word)) is not None:
            return [t]
        n, size, compatible = len(word), self.size, self._compatible
        at: list[list[int]] = [[] for _ in range(n)]
        for end, t in self.automaton.iter(word.decode("latin-1")):
            at[end + 1 - size[t]].append(t)  # shorter ones end earlier, so each list is by length
        dead = bytearray(n + 1)
        out, where, pos, c = [], [], 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while c >= 0:
                t = options[c]
                if not dead[pos + size[t]] and (not out or compatible(out[-1], t)):
                    break
                c -= 1
            if c >= 0:
                out.append(t)
                where.append((pos, c))
                pos += size[t]
                c = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                pos, c = where.pop()
                out.pop()
                c -= 1
        return out

    def _ids_of(self, word: str) -> bytes:
        ids = self.vocabulary.ids
        return array("i", [ids[t] for t in self.tokens(word.encode())]).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        for part, special in self.vocabulary.segments(text or ""):
            if special:
                out.append(array("i", [self.vocabulary.special[part]]).tobytes())
                continue
            out.extend(self.pieces(part))
        return np.frombuffer(b"".join(out), np.int32)


class Decoder:
    """Token bytes end to end, with the offset of each id."""

    def __init__(self, data: bytes):
        by_id = load(data, Vocabulary).by_id
        texts = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids) -> str:
        """Ids outside the table decode to nothing; broken UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offset) - 1)]
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(start - (ends - size), size) + np.arange(total)
        return self.bytes[take].tobytes().decode("utf-8", "replace")


def _file(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def bpe_ids(spark: SparkSession, text: Column, vocabulary_path: str) -> Column:
    """Token ids (array<int>) of a text column; a null text has none."""
    file = _file(spark, vocabulary_path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(file.value, Encoder)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts], dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def bpe_text(spark: SparkSession, ids: Column, vocabulary_path: str) -> Column:
    """The text of a column of token ids; null ids give an empty text."""
    file = _file(spark, vocabulary_path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = load(file.value, Decoder)
        for column in batches:
            yield pd.Series([decoder.decode(x) for x in column], dtype=object)

    return text(F.coalesce(ids, F.array().cast("array<int>")))


def encode_decode(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>) and ``decoded`` (string) to each row; one narrow pass, no shuffle.

    A null or empty text has no ids and decodes to "". Special strings inside a text are the
    special tokens. Texts of any length are taken whole, repeated rows repeat their result and
    an empty table gives none. Other columns pass through; a column named as a result is
    replaced. A task's tables and caches are of bounded size.
    """
    file = _file(docs.sparkSession, vocabulary_path)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = load(file.value, Encoder), load(file.value, Decoder)
        for texts in batches:
            ids = [encoder.encode(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [decoder.decode(x) for x in ids]})

    # Marked so that the plan runs it once a row, however often its fields are used.
    coded = docs.withColumn("_coded", both.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
    return coded.withColumns({"ids": F.col("_coded.ids"), "decoded": F.col("_coded.decoded")}).drop("_coded")
