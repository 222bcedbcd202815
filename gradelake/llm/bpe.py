"""Byte-level BPE vocabularies: symbol tables and the split of a text before merging.

Symbols are renumbered so that a lower number is an earlier merge: 0-255 are the bytes and
256 + r is what merge r makes. ``merge[left << SHIFT | right]`` is the merged symbol.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import regex

SHIFT = 20
#: White space as the split pattern means it (Unicode White_Space).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_INNER_SPACE = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" \s")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    odd = [b for b in range(256) if b not in set(plain)]
    out = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + i) for i, b in enumerate(odd)}
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tables of one byte-level BPE file in the JSON form of the ``tokenizers`` library."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser or prefix space is supported")
        if model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("unsupported option in the BPE model")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError("only plain added tokens are supported")
        letters, vocab = byte_alphabet(), model["vocab"]
        to_byte = {c: b for b, c in enumerate(letters)}
        number = {c: b for b, c in enumerate(letters)}
        self.ids = [vocab[c] for c in letters]
        self.text: list[bytes] = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merge: dict[int, int] = {}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = number[a], number[b], len(self.text)
            if a + b in number:
                raise ValueError("two merges make the same token")
            number[a + b] = whole
            self.merge[left << SHIFT | right] = whole
            self.parts.append((left, right))
            self.text.append(self.text[left] + self.text[right])
            self.ids.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in added}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.by_id: dict[int, bytes] = dict(zip(self.ids, self.text, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        for c, i in vocab.items():  # ids that no merge makes
            self.by_id.setdefault(i, bytes(to_byte[x] for x in c) if all(x in to_byte for x in c) else c.encode())

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """(stretch, is special) of a text, special strings apart."""
        if self.special_split is None or not any(s in text for s in self.special):
            yield text, False
            return
        for i, part in enumerate(self.special_split.split(text)):
            if part:
                yield part, bool(i % 2)


_KEPT = 3  # a vocabulary, its encoder and its decoder
_loaded: dict[str, object] = {}


def load(data: bytes, make=Vocabulary):
    """What ``make`` builds from the file's bytes, kept by a Python worker while nothing else crowds it out.

    A worker outlives its task, so tables of earlier stages would pile up: a new one beyond
    ``_KEPT`` forgets all others.
    """
    key = f"{make.__name__}:{hashlib.md5(data).hexdigest()}"
    if key not in _loaded:
        if len(_loaded) >= _KEPT:
            _loaded.clear()
        _loaded[key] = make(data)
    return _loaded[key]


def pretokens(text: str) -> list[str]:
    """The stretches that are merged apart from each other; letters after a space are one."""
    return [text] if text[:1] == " " and text[1:].isalpha() else _PRETOKEN.findall(text)


def pieces(text: str) -> list[str]:
    """The text cut at each space before other text; all but the first piece follow a space.

    No pre-token crosses such a cut, because one takes at most the single space before it,
    so pieces can be handled (and remembered) one by one.
    """
    return _INNER_SPACE.split(text) if _ODD_SPACE.search(text) or text[-1:] == " " else text.split(" ")


class Remembered(dict):
    """A dict that fills itself by ``make`` and holds at most two generations of ``limit`` keys.

    When the young generation is full it becomes the old one; keys used again come back from
    there, the others are forgotten. Long keys are not kept.
    """

    def __init__(self, make, limit: int = 200_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByPiece:
    """What ``of_word`` makes of the pre-tokens of a piece, put together by ``join`` and remembered.

    Letters after a space are remembered without it, once for all pieces that hold them.
    """

    def __init__(self, of_word, join):
        self.of_word, self.join = of_word, join
        self.bare = Remembered(of_word, 50_000)
        self.spaced = Remembered(self._spaced)
        self.first = Remembered(lambda piece: join(map(self.bare.__getitem__, pretokens(piece))), 20_000)

    def _spaced(self, piece: str):
        if piece.isalpha():
            return self.of_word(" " + piece)
        found = pretokens(" " + piece)
        return self.join([self.spaced[w[1:]] if w[0] == " " and w[1:].isalpha() else self.bare[w] for w in found])

    def __call__(self, text: str) -> list:
        head, *rest = pieces(text)
        return [self.first[head], *map(self.spaced.__getitem__, rest)]
