"""Many concepts in many chunks, most frequent values and weighted samples, against plain counting."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from gradelake.operators import concepts
from gradelake.operators import questions as Q


def plan(df):
    return df._jdf.queryExecution().toString()


def test_concept_places_equal_the_nested_loop(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    chunks = [(i, j, text(r.choice([0, 2, 30, 200]))) for i in range(40) for j in range(3)] + [(99, 0, None), (98, 0, "AbC. É")]
    names = list({text(r.choice([1, 2, 3, 4, 6])) for _ in range(300)}) + ["", None, "ABC", "É", "abc"]
    c = spark.createDataFrame(chunks, "doc_id long, chunk_id int, text string")
    n = spark.createDataFrame([(x,) for x in names], "concept string")
    found = concepts.concept_places(c, n)
    want = sorted((x, d, k) for x in set(names) if x is not None for d, k, t in chunks if t is not None and x.lower() in t.lower())
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert concepts.concept_places(c, n.where("false")).count() == 0 and concepts.concept_places(c.where("false"), n).count() == 0


def test_twenty_thousand_concepts(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(20_000)]
    chunks = [(i, 0, " ".join(r.choices(words, k=25))) for i in range(300)]
    c = spark.createDataFrame(chunks, "doc_id long, chunk_id int, text string")
    got = concepts.concept_places(c, spark.createDataFrame([(w,) for w in words], "concept string"))
    want = {(w, d, 0) for d, _, t in chunks for w in t.split()}
    assert set(map(tuple, got.collect())) >= want and "NestedLoop" not in plan(got)


@pytest.mark.parametrize(("cells", "most"), [(1 << 16, 5), (7, 5), (64, 20), (64, 10_000)])
def test_most_frequent_values(spark, monkeypatch, cells, most):
    monkeypatch.setattr(concepts, "_CELLS", cells)
    r = random.Random(most)
    values = [min(int(r.paretovariate(0.7)), 900) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(None if v is None else f"v{v}", i) for i, v in enumerate(values)], "v string, place long")
    first, n = {}, collections.Counter()
    for i, v in enumerate(values[:-1]):
        first.setdefault(f"v{v}", i)
        n[f"v{v}"] += 1
    want = sorted(n.items(), key=lambda x: (-x[1], first[x[0]]))[:most]
    assert [tuple(x) for x in concepts.most_frequent(df, "v", ["place"], most).collect()] == want
    assert concepts.most_frequent(df.where("false"), "v", ["place"], 5).count() == 0


def test_weighted_samples(spark):
    weights = {i: [0.0, 1.0, 2.0, 5.0][i % 4] for i in range(200)} | {200: None}
    df = spark.createDataFrame(list(weights.items()), "id long, w double")
    one = [x.id for x in Q.weighted_sample(df, "w", ["id"], 20, seed=1).orderBy("place").collect()]
    assert one == [x.id for x in Q.weighted_sample(df.repartition(7), "w", ["id"], 20, seed=1).orderBy("place").collect()]
    assert len(set(one)) == 20 and all(weights[i] for i in one)
    # First draws go by weight: of many seeds, the share of each class is its share of all weights.
    seeds = spark.range(3000).withColumnRenamed("id", "seed")
    few = df.where("id < 8").crossJoin(F.broadcast(seeds)).withColumn("k", Q.sampling_key(F.col("w"), 0, F.col("seed"), F.col("id")))
    first = few.where("k is not null").groupBy("seed").agg(F.min_by("w", "k").alias("w")).groupBy("w").count().collect()
    total = sum(x["count"] for x in first)
    for x in first:
        p = x.w / 8
        assert abs(x["count"] - total * p) < 5 * math.sqrt(total * p * (1 - p))
