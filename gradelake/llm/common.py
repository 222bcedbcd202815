"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.sources.tables import dealt_out, given_up, shared_folder, written  # noqa: F401
from gradelake.sources.tables import table as stored_table


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow hand texts to Python in batches of at most ``rows`` rows, a few MB, not 10,000.

    Whole texts, their arrays and results are held a batch at a time, which bounds a worker's
    memory. A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside; the old one comes back."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (node, component), component being the smallest node reachable.

    Nodes are ordered by a hash, so that chains of ids in order are no chains here. In each
    round every node points at its first neighbour in that order, pointers are doubled twice,
    and the edges are contracted onto what is pointed at: a fixed share of the linked nodes
    vanishes in a round on average, so the number of rounds is logarithmic and each is smaller
    than the last. Nodes without an edge are not returned; null ends and self links are ignored.
    """
    node = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = e.select(node("a").alias("u"), node("b").alias("v"))
    e = checkpoint(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = checkpoint(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        for _ in range(2):
            jump = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up = up.join(jump, "p").select("u", F.col("pp").alias("p"))
        up = checkpoint(up)
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = up.select(F.col("u").alias("component"), "p")
            labels = checkpoint(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        left = up.select("u", F.col("p").alias("pu"))
        right = up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = e.join(left, "u").join(right, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        e = checkpoint(e)
    if labels is None:
        return e.select(F.col("u.n").alias("node"), F.col("v.n").alias("component"))
    least = labels.groupBy("component").agg(F.min("node.n").alias("least"))
    return checkpoint(labels.join(least, "component").select(F.col("node.n").alias("node"), F.col("least").alias("component")))


def forest(i: np.ndarray, j: np.ndarray, n: int, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest index linked with each of n indices, directly or not."""
    parent = np.arange(n) if parent is None else parent
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def split_hot(rows: DataFrame, key: list[str], unit: Column, block_rows: int) -> DataFrame:
    """Deal the rows of each key into tasks (blk_i, blk_j) of at most about 2 x block_rows rows.

    A key of up to ``block_rows`` rows is one task (0, 0). A larger one is cut by a hash of
    ``unit`` into n blocks and each pair of blocks is a task, so that a self-join of the key
    is whole and no task holds a whole hot key. ``blk`` is the row's own block. Keys of one
    row have nothing to be joined with and are left out.

    Rows meet the sizes of their keys by a merge join: ``rows`` are often made many of one (by
    an explode or in Python), of which Spark knows nothing, so that it would take them for the
    smaller side and send them all through the driver.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = sizes.select(*key, F.ceil(F.col("_n") / block_rows).cast("int").alias("_b"))
    dealt = rows.hint("merge").join(sizes, key).withColumn("blk", F.pmod(F.xxhash64(unit), F.col("_b")).cast("int"))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return dealt.withColumn("blk_i", F.least("blk", "_j")).withColumn("blk_j", F.greatest("blk", "_j")).drop("_b", "_j")


def whole_tasks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``task`` put together so that no task is cut, of about ``rows`` rows or one task each."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            some = pd.concat(held, ignore_index=True)
            whole = (some["task"] != some["task"].iat[-1]).to_numpy()
            if whole.any():
                yield some[whole]
                some = some[~whole]
            held, size = [some], len(some)
    if size:
        yield pd.concat(held, ignore_index=True)


def kept_rows(docs: DataFrame, kept: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The rows whose (id, hash of text) is in ``kept``, those that repeat both once, and the rows without an id.

    Of rows that repeat both, the first in the order of their columns stays.
    """
    rows = docs.where(F.col(id_col).isNotNull()).withColumns({"_id": F.col(id_col), "_th": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    kept = kept.toDF("_kid", "_kth")
    rows = rows.join(kept, (F.col("_id") == F.col("_kid")) & (F.col("_th") == F.col("_kth")), "left_semi")
    once = rows.groupBy("_id", "_th").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    small_batches(spark)
    return stored_table(spark, sf_dir, name, spread)
