"""The walk of a trie over many texts, against looking for each term in each text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradelake.operators import concepts, many_terms


@pytest.mark.parametrize("letters", ["a", "ab", "abcdé😀 \n", "abcdefghijklmnopqrstuvwxyz"])
def test_terms_held_equal_plain_search(letters):
    r = random.Random(len(letters))
    for _ in range(20):
        terms = sorted({"".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(r.choice([0, 1, 300]))})
        texts = ["".join(r.choices(letters, k=r.choice([0, 1, 2, 60]))) for _ in range(15)]
        body = [t.encode() for t in texts]
        places = np.cumsum([0, *map(len, body)]).astype(np.int64)
        row, term = many_terms.Terms([t.encode() for t in terms]).held(np.frombuffer(b"".join(body), np.uint8), places)
        assert sorted(zip(row.tolist(), term.tolist(), strict=True)) == sorted((i, k) for i, t in enumerate(texts) for k, x in enumerate(terms) if x in t)


def test_texts_are_walked_a_bounded_part_at_a_time(monkeypatch):
    monkeypatch.setattr(many_terms, "_TEXT", 7)
    texts = ["ab", "", "b" * 30, "a", "xab"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([t.encode() for t in texts])], names=["id", "text"]).slice(1)
    out = many_terms.pairs_held(iter([batch]), many_terms.Terms([b"ab", b"b"]), np.array([0, 2, 3]), pa.array(["AB", "Ab", "B"]))
    assert sorted(tuple(x.values()) for b in out for x in b.to_pylist()) == [("AB", 4), ("Ab", 4), ("B", 2), ("B", 4)]


def test_chunks_are_not_made_a_row_for_each_stretch(spark, monkeypatch):
    c = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.concat(F.lit("Model of "), F.col("id").cast("string")).alias("text"))
    n = spark.createDataFrame([("Model",), ("MODEL",), ("of 4",)], "concept string")
    for most in (4 << 20, 6):  # bytes at once
        monkeypatch.setattr(concepts, "_BYTES", most)
        found = concepts.concept_places(c, n)
        plan = found._jdf.queryExecution().toString()
        assert "Generate" not in plan and "Join" not in plan and "hashpartitioning" not in plan
        assert found.count() == 50 + 50 + 11
