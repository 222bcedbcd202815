"""Retrieval with bounds against scoring every chunk."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from gradelake.llm.common import setting
from gradelake.operators import retrieval


def best(queries, chunks, k):
    words = lambda t: collections.Counter(re.findall("[a-z]{3,}", t.lower()))
    out = []
    for q, text in queries:
        asked, scored = words(text), []
        for doc, n, t, g in chunks:
            held = words(t)
            overlap = sum((asked & held).values())
            norm = (asked.total() + held.total()) / 2
            score = round((overlap / norm if norm else 0.0) * 0.7 + g * 0.3, 6)
            scored.append((-score, doc, n, overlap))
        out += [(q, d, n, o, -s, i) for i, (s, d, n, o) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("group", "seeds", "k"), [(150_000, 8, 5), (1_500, 1, 3)])
def test_bounds_lose_nothing(spark, monkeypatch, group, seeds, k):
    monkeypatch.setattr(retrieval, "_GROUP", group)
    monkeypatch.setattr(retrieval, "_SEEDS", seeds)
    r = random.Random(group)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(3, 5))) for _ in range(300)]
    common = vocabulary[:12]
    text = lambda n: " ".join(r.choice(common if r.random() < 0.6 else vocabulary) for _ in range(n))
    chunks = [(d, i, text(r.choice([0, 1, 3, 12, 60, 61, 140])), round(0.86 + r.randrange(100) / 600, 3)) for d in range(60) for i in range(r.randint(1, 4))]
    queries = [(q, text(r.choice([1, 4, 20, 40]))) for q in range(25)]
    queries += [(100, ""), (101, "zz absent9 unknownword"), (102, chunks[3][2]), (103, " ".join(common * 4))]
    chunks += [(900, i, queries[5][1], 0.9) for i in range(4)]  # ties
    q = spark.createDataFrame(queries, "query_id long, query string")
    c = spark.createDataFrame(chunks, "doc_id long, chunk_id int, text string, grounding_score double")
    got = retrieval.scored_chunks(q, c, k).select("query_id", "doc_id", "chunk_id", "overlap", "score", "rank")
    assert sorted(map(tuple, got.collect())) == best(queries, chunks, k)


def test_fewer_chunks_than_asked_for_and_none(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "")], "query_id long, query string")
    c = spark.createDataFrame([(1, 0, "alpha", 0.9), (2, 0, "", 1.0)], "doc_id long, chunk_id int, text string, grounding_score double")
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.scored_chunks(q, c, 5).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert retrieval.scored_chunks(q, c.where("false"), 5).count() == 0
    assert retrieval.scored_chunks(q.where("false"), c, 5).count() == 0


def test_common_terms_are_not_looked_up(spark, monkeypatch):
    """Of chunks that share only what all share, few rows reach the order."""
    written, sizes = retrieval.written, {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = out
        return out

    monkeypatch.setattr(retrieval, "written", counted)
    r = random.Random(3)
    filler = ["the", "and", "for", "with", "from", "this"]
    c = [(d, 0, " ".join(r.choices(filler, k=80) + [f"rare{chr(97 + d % 26)}{chr(97 + d // 26 % 26)}"] * 3), 0.9) for d in range(676)]
    q = [(d, f"the and for rare{chr(97 + d % 26)}{chr(97 + d // 26 % 26)} " * 3) for d in range(0, 676, 13)]
    chunks = spark.createDataFrame(c, "doc_id long, chunk_id int, text string, grounding_score double")
    got = retrieval.scored_chunks(spark.createDataFrame(q, "query_id long, query string"), chunks, 1).collect()
    assert all(x.query_id == x.doc_id for x in got) and len(got) == len(q)
    assert sizes["looked-up"].where(F.col("term").startswith("the ")).count() == 0
    assert sizes["seeds"].count() < 0.05 * len(q) * len(c)


def test_terms_number_the_occurrences_of_words(spark):
    """Also of words that occur more often than neighbours are compared one by one."""
    r = random.Random(8)
    texts = ["", "one", "the " * 30 + "end", *(" ".join(r.choices(["the", "And", "for", "rare", "zz"], [20, 5, 3, 1, 1], k=n)) for n in (5, 40, 200))]
    c = spark.createDataFrame([(i, 0, t, 0.9) for i, t in enumerate(texts)], "doc_id long, chunk_id int, text string, grounding_score double")
    index = retrieval.indexed(c)
    for row in index.collect():
        held = collections.Counter(re.findall("[a-z]{3,}", row.text.lower()))
        assert row.terms == [f"{w} {k}" for w in sorted(held) for k in range(-1, held[w] - 1)] and row.n_chunk == held.total()
    terms = index._jdf.queryExecution().optimizedPlan().toString().split("AS terms")[0]
    assert terms.count("array_position") == 1 and "CASE WHEN" in terms


def test_the_index_is_not_shuffled(spark, monkeypatch):
    """What is looked up goes to the chunks: no stage deals out their terms."""
    plans, written = {}, retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: plans.setdefault(name, df) and written(df, name))
    monkeypatch.setattr(retrieval, "_GROUP", 3)
    c = retrieval.indexed(spark.range(0, 400, 1, 4).selectExpr("id as doc_id", "0 as chunk_id", "concat('alpha beta w', chr(97 + id % 26), 'xyz') as text", "0.9D as grounding_score"))
    q = spark.createDataFrame([(i, f"alpha w{chr(97 + i)}xyz") for i in range(8)], "query_id long, query string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = retrieval.scored_chunks(q, written(c, "index"), 2)
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in out.collect()) == sorted((i, i + 26 * (k - 1), k) for i in range(8) for k in (1, 2))
        physical = plans["scored-seeds"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "Exchange hashpartitioning" not in physical
