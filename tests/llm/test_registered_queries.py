"""The registered queries over whole tables of the smallest size, against brute force, the library or held-out accuracy."""

import collections
import hashlib
import math
import os
import re
import string
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from gradelake.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.no_padding(), LIBRARY.no_truncation()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return {int(r.doc_id): r for r in d.itertuples()}


@pytest.fixture(scope="module")
def run(spark):
    def rows(name, key="doc_id"):
        found = Q.QUERIES[name](spark, SF).collect()
        assert len({r[key] for r in found}) == len(found)
        return {r[key]: r for r in found}

    return rows


def grouped(ids, links):
    ids = list(ids)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_op1_and_op9(run, docs):
    counts, codes = run("op1_token_counts"), run("op9_bpe_codec")
    assert set(counts) == set(codes) == set(docs)
    for i, d in docs.items():
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((d.text or "").encode()), len(ids), len(ids) > 512)
        assert (codes[i].n_tokens, codes[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert codes[i].decoded_sha256 == sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())


def test_op2(run, docs):
    got, first = run("op2_suffix_dedup"), {}
    data = {i: (docs[i].text or "").encode() for i in sorted(docs)}
    for i, b in data.items():
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()))


def test_op3(run, docs):
    got, prints = run("op3_simhash_dedup"), {}
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, d in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (d.text or "").translate(lower))
        parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    links = [(i, j) for i in docs for j in docs if j < i and (prints[i] ^ prints[j]).bit_count() <= 4]
    want = grouped(docs, links)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_op4(run):
    v = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = [None if e is None else np.array(e, float) for e in v.embedding]
    usable = [k for k in range(len(v)) if x[k] is not None and np.isfinite(x[k]).all() and x[k].any() and not pd.isna(v.label[k])]
    links = [(int(v.vec_id[a]), int(v.vec_id[b])) for a in usable for b in usable if a != b and v.label[a] == v.label[b] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98]
    n, group = collections.Counter(a for a, _ in links), grouped(map(int, v.vec_id), links)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in run("op4_embedding_dedup", "vec_id").items()} == {i: (n[i], g, g == i) for i, g in group.items()}


def witten_bell(texts, order):
    """log P of a text by counts of substrings, straight from the definition."""
    counts = collections.Counter(t[a:b] for t in texts for a in range(len(t)) for b in range(a, min(a + order + 1, len(t)) + 1))
    nexts = collections.defaultdict(collections.Counter)
    for s, n in counts.items():
        if s:
            nexts[s[:-1]][s[-1]] += n

    def probability(context, c):
        shorter = 1 / 65536 if not context else probability(context[1:], c)
        seen = nexts.get(context)
        return shorter if seen is None else (seen[c] + len(seen) * shorter) / (sum(seen.values()) + len(seen))

    return lambda text: sum(math.log(probability(text[max(0, i - order) : i], c)) for i, c in enumerate(text))


def test_op5(run):
    pages = pd.read_parquet(f"{SF}/pages.parquet", columns=["page_id", "url"])
    got, kinds, known = run("op5_url_filters", "page_id"), {}, {"allow": set(), "block": set()}
    for r in pages.itertuples():
        rest = r.url.split("://", 1)[1] if r.url is not None and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        fits = [(len(rule), rule, v) for rule, v in Q.URL_RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        kinds[r.page_id] = host, path, rule, verdict
        if rule:
            known[verdict].add(host + path)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule)
    assert all(0 < len(x) <= 4000 for x in known.values())
    import pyspark.sql.functions as F
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    by_hash = {v: [r.t for r in spark.createDataFrame([(t,) for t in known[v]], "t string").orderBy(F.xxhash64("t"), "t").collect()] for v in known}
    models = {v: witten_bell([t + "\x03" for i, t in enumerate(by_hash[v]) if i % 5], 5) for v in known}
    ratio = lambda t: (models["allow"](t + "\x03") - models["block"](t + "\x03")) / (len(t) + 1)
    for i, (host, path, _, verdict) in list(kinds.items())[:60]:
        assert abs(got[i].llr - ratio(host + path)) < 1e-9
    bound = {got[i].verdict: [] for i in got}
    for i, (host, path, _, verdict) in kinds.items():
        if verdict:
            assert got[i].verdict == verdict
        else:
            bound[got[i].verdict].append(got[i].llr)
    assert not all(bound.values()) or max(bound["block"]) < min(bound["allow"])


def test_op6(run, docs, spark):
    from tests_llm_tiles import tiles_brute

    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    words = lambda t: [w for w in ("".join(re.findall(r"\w+", x.lower())) for x in (t or "").split()) if w]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want, of = {}, {int(r.item_id): words(r.text) for r in items.itertuples()}
    for i, d in docs.items():
        w = words(d.text)
        mine = grams(w)
        for item, q in of.items():
            shared = mine & grams(q)
            if len(q) >= 5 and len(shared) * 5 >= 0.5 * len(q):
                near = sorted({p for k in range(len(w) - 4) if tuple(w[k : k + 5]) in shared for p in range(max(0, k - 1), min(len(w), k + 6))})
                text = [w[p] if p in near else None for p in range(near[0], near[-1] + 1)]  # nothing else can be in a tile
                found = [n for _, _, n in tiles_brute(text, q, 5)]
                if sum(found) >= 0.5 * len(q):
                    want[i, item] = (len(found), max(found), sum(found))
    rows = Q.QUERIES["op6_benchmark_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id): (r.n_tiles, r.longest, r.covered) for r in rows} == want and want


def test_op8(run, docs):
    got = run("op8_language_id")
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or ""))
    asked = [i for i, r in got.items() if r.held_out and r.lang_pred != "und" and docs[i].lang]
    assert len(asked) > 20 and sum(got[i].lang_pred == docs[i].lang for i in asked) >= 0.95 * len(asked)


def credentials(text):
    """Web tokens of three parts, and runs of 20 key characters and more with a digit and a letter, with their padding."""
    done = 0
    for run in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        if run.start() < done:
            continue
        web = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}").match(text, run.start())
        mixed = len(run[0]) >= 20 and re.search("[0-9]", run[0]) and re.search("[A-Za-z]", run[0])
        if web or mixed:
            found = web or re.compile(re.escape(run[0]) + "(?:={1,2}(?![A-Za-z0-9+/_=-]))?").match(text, run.start())
            done = found.end()
            yield found


def test_op10(spark):
    """The smallest tables hold no secret: the next larger ones are read. The pattern of candidates and the bounds are written out."""
    larger = SF.replace("sf0.001", "sf0.01")
    docs = {int(r.doc_id): r for r in pd.read_parquet(f"{larger}/documents.parquet").itertuples()}
    got = {r.doc_id: r for r in Q.QUERIES["op10_secret_scans"](spark, larger).collect()}
    holders, values = collections.defaultdict(set), {}
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, d in docs.items():
        text = d.text or ""
        found = [(m.start(), 0, m.end(), m.start(2), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), m.start(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), m.start(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [(a, k, b) for a, k, b, _, _ in found]
        wide = {(m.start(), m.end(), m[0]) for m in credentials(text) if not any(a < m.end() and m.start() < b for a, _, b in base)}
        values[i] = sorted(base), {(v, b, x) for _, _, b, v, x in found} | wide
        for _, _, x in values[i][1]:
            holders[x].add((d.source, text))
    n = 0
    for i, (base, mine) in values.items():
        said = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'owned')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        owned = [(a, 3, b) for a, b, x in mine if len({s for s, _ in holders[x]}) == 1 and len(holders[x]) <= 20]
        n += len(owned)
        kinds = [k for _, k, _ in base]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(kinds.count(k) for k in range(3))
        assert got[i].base_sha256 == sha(said(base).encode()) and got[i].spans == said(base + owned)
        assert (got[i].n_owned, got[i].n_copied) == (len(owned), len(mine) - len(owned))
    assert n > 0 and set(got) == set(docs)
