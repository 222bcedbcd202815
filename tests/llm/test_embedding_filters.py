"""What the cap filters prune and what they keep: recall after all prunes, and work on vectors without links."""

import numpy as np
import pandas as pd
import pytest

from gradelake.llm import common, embedding_dedup
from gradelake.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "rep long, label int, vector array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at_cosine(rng, x, cosine):
    """A vector at a cosine from each row."""
    y = rng.standard_normal(x.shape)
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("n", [400, 2000, 8000])
def test_pairs_at_the_bound_are_found(spark, n):
    """Half of the vectors have one partner just above the bound: 0.99 of these pairs survive filters and sketches."""
    rng = np.random.default_rng(n)
    x = unit(rng.standard_normal((n // 2, 64)))
    both = np.concatenate([x, at_cosine(rng, x, 0.9805)])
    reps = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(both)], SCHEMA)
    close = embedding_dedup.close_in_filters(reps, 0.98)
    found = {tuple(sorted((r.rep, r.parent))) for r in embedding_dedup.filter_links(reps, close, 0.98).collect()}
    want = {(i, i + n // 2) for i in range(n // 2)}
    assert len(found & want) >= 0.99 * len(want) and len(found - want) == 0


def test_vectors_without_links_are_hardly_compared(spark):
    """12,000 random vectors of one label: of 72 million pairs fewer than one in a hundred thousand is verified."""
    rng = np.random.default_rng(7)
    reps = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rng.standard_normal((12_000, 64)))], SCHEMA)
    met = embedding_dedup.close_in_filters(reps, 0.98).groupBy("task").count().collect()
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in met) < 720


def test_sketches_lose_no_link():
    rng = np.random.default_rng(1)
    caps = embedding_dedup.CapFilters(64, 64, 48, 24, 11)
    x = unit(rng.standard_normal((20_000, 64)))
    a, b = (np.unpackbits(caps.sketch(z), axis=1) for z in (x, at_cosine(rng, x, 0.98)))
    assert (a != b).sum(1).max() <= embedding_dedup.sketch_bits(0.98)


def test_registered_query_over_near_vectors(spark, tmp_path):
    """The table with slightly turned copies of a third of its rows, so that there are links of several sizes."""
    v = pd.read_parquet(f"{SF}/embeddings.parquet")
    rng = np.random.default_rng(2)
    near = []
    for times in (1, 2):
        some = v.iloc[:: 3 * times].copy()
        some["embedding"] = [np.asarray(e, np.float32) + rng.normal(0, 0.1 * np.linalg.norm(e) / np.sqrt(len(e)), len(e)).astype(np.float32) for e in some["embedding"]]
        some["vec_id"] += 10_000 * times
        near.append(some)
    v = pd.concat([v, *near], ignore_index=True)
    v.to_parquet(tmp_path / "embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in Q.QUERIES["op4_embedding_dedup"](spark, str(tmp_path)).collect()}
    x = unit(np.stack(v["embedding"].to_list()).astype(float))
    same = v["label"].to_numpy()[:, None] == v["label"].to_numpy()[None, :]
    linked = (x @ x.T >= 0.98) & same & ~np.eye(len(x), dtype=bool)
    ids = v["vec_id"].to_numpy()
    group = common.forest(*np.nonzero(linked), len(x))
    least = {g: ids[group == g].min() for g in set(group)}
    want = {int(i): (int(n), int(least[g]), bool(least[g] == i)) for i, n, g in zip(ids, linked.sum(1), group)}
    wrong = [i for i in want if got[i] != want[i]]
    assert linked.sum() > 200 and len(wrong) <= 0.01 * len(want)
