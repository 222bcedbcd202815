"""The Merkle manifest, periodic runs and the Katz model: registered queries and awkward rows against brute force."""

import collections
import hashlib
import math
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gradelake.llm import katz, manifest, periodic_runs
from gradelake.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string, runs int, h long, w string, key string, score int"


@pytest.fixture(scope="module")
def docs():
    return list(pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").itertuples())


def awkward(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, names that clash with the operators' own."""
    more = ("x", "y", 1, 2, "z", "k", 9)
    rows = [(i, f"w{i} Alpha beta alpha beta alpha beta alpha beta {i % 3}", ["de", "en", None][i % 3], "s", i, *more) for i in range(1, 30)]
    rows += [(40, None, None, None, None, *more), (41, "", "", "", 0, *more), (42, "long word " * 30_000, "en", "s", 1, *more)]
    rows += [(43, "again again", "en", "s", 1, *more)] * 3 + [(None, "no id a b c", "en", None, 2, *more), (44, "É a É a É a É a b", "fr", "s", 3, *more)]
    return rows, spark.createDataFrame(rows, SCHEMA)


# The manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def by_hand(rows, tampered):
    """(id, leaf, subroot, root, proof, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    rows = [(r, leaf(r)) for r in rows]
    langs = sorted({r[2] for r, _ in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: grown([h for r, h in sorted((x for x in rows if x[0][2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))]) for lang in langs}
    top = grown([trees[x][-1][0] for x in langs])
    out, used = [], collections.Counter()
    for r, h in sorted(rows, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])):
        i, used[r[2]] = used[r[2]], used[r[2]] + 1
        path = [*siblings(trees[r[2]], i), *siblings(top, langs.index(r[2]))]
        x = leaf((*r[:4], tampered(r)))
        for before, after in path:
            x = sha("".join(before) + x + "".join(after))
        out.append((r[0], h, trees[r[2]][-1][0], top[-1][0], "".join("".join(b + a) for b, a in path), x, x == top[-1][0]))
    return sorted(out, key=repr)


def lowered(r):
    if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 3:
        return r[4]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])


def test_op11(spark, docs):
    got = sorted(map(tuple, Q.QUERIES["op11_merkle_manifest"](spark, SF).collect()), key=repr)
    want = by_hand([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs], lowered)
    assert got == [(*x[:4], sha(x[4]), *x[5:]) for x in want]
    assert 0 < sum(not x[-1] for x in got) < len(got)


def test_op11_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df, rel = Q.QUERIES["op11_merkle_manifest"](spark, SF), c.sql(Q.ORACLE["op11_merkle_manifest"])
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest_awkward_rows(spark):
    rows, df = awkward(spark)
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = manifest.manifest(df, FIELDS, found={"text": Q.ascii_lower(F.col("text"))}, changed=changed)
    plain = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    assert sorted(map(tuple, made.collect()), key=repr) == by_hand(plain, lowered)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65, 513])
def test_manifest_sizes(spark, n):
    rows = [(i, "s", "one", i, f"text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted(map(tuple, manifest.manifest(df, FIELDS).collect()), key=repr)
    assert got == by_hand(rows, lambda r: r[4]) and all(x[-1] for x in got)


# Periodic runs


def runs_by_hand(x):
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(x[k] == x[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def drop_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("sieved", [8, 4096])
def test_runs_of_random_numbers(monkeypatch, sieved):
    monkeypatch.setattr(periodic_runs, "_SIEVED", sieved)
    random.seed(sieved)
    for _ in range(1500):
        letters = random.randrange(1, 5)
        x = [random.randrange(letters) for _ in range(random.randrange(60))]
        if random.random() < 0.6:
            base = [random.randrange(6) for _ in range(random.randrange(1, 9))]
            at = random.randrange(len(x) + 1)
            x[at:at] = [base[i % len(base)] for i in range(random.randrange(50))]
        assert periodic_runs.find_runs(np.array(x, np.int64)) == runs_by_hand(x)


def test_runs_of_a_long_text():
    x = np.unique(np.random.default_rng(1).integers(0, 3000, 30_000), return_inverse=True)[1]
    x[5_000:15_000] = np.tile(x[5_000:7_000], 5)
    x[20_000:20_400] = x[20_000]
    found = periodic_runs.find_runs(x)
    assert any(q == 2_000 and n >= 10_000 for _, n, q in found) and any(q == 1 and n >= 400 for _, n, q in found)


def test_op12(spark, docs):
    got = {r.doc_id: r for r in Q.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and any(r.n_runs for r in got.values())
    for d in docs:
        words = d.text.encode().split()
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(drop_by_hand(words, runs))).hexdigest()


def test_runs_awkward_rows(spark):
    rows, df = awkward(spark)
    found = periodic_runs.periodic_runs(df)
    assert set(SCHEMA.replace(",", "").split()[::2]) <= set(found.columns)
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect())
    want = collections.Counter()
    for r in rows:
        words = (r[1] or "").encode().split()
        runs = [(0, 60_000, 2)] if r[0] == 42 else runs_by_hand(words)
        want[r[0], len(words), tuple(runs), b" ".join(drop_by_hand(words, runs)).decode()] += 1
    assert got == want
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0


# The language model


class ByHand:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.word, self.pair, self.total, self.after = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
        for t in texts:
            self.word.update(t)
            for a, b in zip([b"", *t[:-1]], t, strict=True):
                self.pair[a, b] += 1
                self.total[a] += 1
                self.after[a].add(b)
        factors = lambda c: [1.0, *katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)]), 1.0]
        self.of_words, self.of_pairs = factors(self.word), factors(self.pair)
        self.n = self.word.total()
        self.share = self.n if min(self.of_words) < 1 else self.n + 1
        self.unknown = 1 - sum(self.single(w) for w in self.word)
        self.weights = {}

    def single(self, w):
        c = self.word[w]
        return self.of_words[min(c, 6)] * c / self.share if c else self.unknown

    def weight(self, h):
        if h not in self.weights:
            counts = [self.pair[h, w] for w in self.after[h]]
            kept, total = sum(self.of_pairs[min(c, 6)] * c for c in counts), sum(counts)
            total += all(self.of_pairs[min(c, 6)] == 1 for c in counts)
            self.weights[h] = (1 - kept / total) / (1 - sum(map(self.single, self.after[h]))), total
        return self.weights[h]

    def probability(self, h, w):
        if h not in self.total:
            return self.single(w)
        left, total = self.weight(h)
        c = self.pair.get((h, w), 0)
        return self.of_pairs[min(c, 6)] * c / total if c else left * self.single(w)

    def row(self, t):
        score = sum(math.log10(self.probability(h, w)) for h, w in zip([b"", *t[:-1]], t, strict=True))
        base = sum(math.log10((self.word.get(w, 0) + 1) / (self.n + len(self.word) + 1)) for w in t)
        return len(t), sum(w in self.word for w in t), self.n, base, score


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def same(r, want):
    assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
    assert r.base_score == pytest.approx(want[3], rel=1e-10) and r.score == pytest.approx(want[4], rel=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_op13(spark, docs, monkeypatch, small):
    if small:  # many slices, parts and flushes, and rare words
        monkeypatch.setattr(katz, "SLICE", 2_000)
        monkeypatch.setattr(katz, "_FLUSH", 700)
        monkeypatch.setattr(katz, "HOT", 50)
    got = {r.doc_id: r for r in Q.QUERIES["op13_lm_scoring"](spark, SF).collect()}
    out = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    model = ByHand([tokens(d.text) for d in docs if not out[d.doc_id]])
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].held_out == out[d.doc_id]
        same(got[d.doc_id], model.row(tokens(d.text)))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


def test_model_is_normalised(docs):
    model = ByHand([tokens(d.text) for d in docs])
    for h in list(model.total)[:20]:
        assert sum(model.probability(h, w) for w in model.word) + model.weight(h)[0] * model.unknown == pytest.approx(1)


def test_scores_of_awkward_rows(spark):
    rows, df = awkward(spark)
    model = ByHand([tokens(r[1]) for r in rows if r[0] is not None and r[0] % 4])
    got = sorted(katz.katz_scores(df, F.col("doc_id") % 4 != 0).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    rows.sort(key=lambda r: (r[0] or 0, len(tokens(r[1]))))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, row in zip(got, rows, strict=True):
        same(r, model.row(tokens(row[1])))


def test_scores_without_anything_to_learn(spark):
    _, df = awkward(spark)
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in katz.katz_scores(df, F.lit(False)).collect()} == {(0.0, 0.0, 0, 0)}
    assert katz.katz_scores(df.where("false"), F.lit(True)).count() == 0


def test_words_are_gathered_without_an_object_for_each(monkeypatch):
    """As plain splitting and a dictionary have them, in less processor time: it was the largest part of the model's."""
    r = random.Random(3)
    made = ["".join(r.choice("aBcÉß中") for _ in range(r.randint(1, 6))) for _ in range(20_000)]
    gaps = [" ", "\n", "  ", "\t", "\x0b\x0c", "\x85", "\xa0", "\x1c", "　"]
    texts = ["", None, " ", "\x00 A\x00"] + [r.choice(["", *gaps]) + "".join(w + r.choice(gaps[: r.choice([1, 9])]) for w in r.choices(made, k=400)) for _ in range(1_500)]

    def plain():
        numbers, triples, n = {b"": 0, b" ": 1}, [], []
        for i, t in enumerate(texts):
            x = [0, *(numbers.setdefault(w, len(numbers)) for w in (t or "").encode().lower().split()), 1]
            triples.append(np.array(x[:-1], np.uint64) << np.uint64(40) | np.array(x[1:], np.uint64) << np.uint64(16) | np.uint64(i))
            n.append(len(x) - 1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers)) & katz._MASK
        return n, hashes, np.sort(np.concatenate(triples))

    def gathered():
        held = katz.Gathered()
        n = [x for some in katz._runs(pa.array(texts)) for x in held.add(some).tolist()]
        return n, held.hashes(), held.triples()

    def seconds(f):
        begin = time.process_time()
        f()
        return time.process_time() - begin

    for words in (1, 1_000, katz._FLUSH):
        monkeypatch.setattr(katz, "_FLUSH", words)
        assert all(np.array_equal(a, b) for a, b in zip(gathered(), plain(), strict=True))
    assert min(seconds(gathered) for _ in range(3)) < 0.8 * min(seconds(plain) for _ in range(3))
    assert [len(x) for x in katz._runs(pa.array(["x"] * 2_300))] == [1_000, 1_000, 300]
