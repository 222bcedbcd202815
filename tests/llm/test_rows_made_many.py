"""Rows that are made many of one are not sent through the driver, however small Spark takes them to be."""

from pyspark.sql import functions as F

from gradelake.llm import common, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_dealt_to_tasks_are_not_broadcast(spark):
    rows = spark.range(40).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(499))).alias("key"))
    tasks = common.split_hot(rows, ["key"], F.col("v"), 64)
    assert tasks.count() == 20_000 and tasks.collect()
    assert "SortMergeJoin" in plan(tasks) and "Broadcast" not in plan(tasks)


def test_fingerprints_in_many_tables_are_not_broadcast(spark):
    prints = spark.range(300).select(F.xxhash64("id").alias("f"))
    links = simhash.hamming_links(prints, "f", 10)
    assert links.count() == 0 and links.collect() == []
    assert "SortMergeJoin" in plan(links) and "Broadcast" not in plan(links)
