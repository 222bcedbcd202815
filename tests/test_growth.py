"""Work that has to grow with the input alone: patterns run once over a text, nothing is worked out twice, nothing large is shuffled."""

import hashlib
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_functions import chunks_brute, one

from gradelake.functions import text as T
from gradelake.llm.common import setting
from gradelake.operators import chunking
from gradelake.plans import domain as D
from gradelake.plans import queries as P
from gradelake.sources import tables
from gradelake.sources.tables import longest_share, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_the_chunker_runs_no_pattern_over_what_has_gathered(spark):
    made = T.chunk_texts(F.col("x"))
    assert "regexp_replace" not in str(made)
    r = random.Random(5)
    gaps = [" ", "\n", " ", "  ", "\x85", " \x1c", "　"]
    sentence = lambda: r.choice(gaps).join("".join(r.choices("abé😀", k=r.randint(1, 9))) for _ in range(r.choice([1, 5, 30]))) + r.choice([".", "!", "?", "", "..."])
    texts = ["".join(r.choice(["", *gaps]) + sentence() for _ in range(r.choice([1, 3, 80]))) for _ in range(60)] + ["", "  \n", "x" * 3000, ". . .", None]
    for size, overlap in ((1100, 140), (40, 9), (10, 30)):
        assert one(spark, texts, lambda c: T.chunk_texts(c, size, overlap)) == [chunks_brute(x, size, overlap) for x in texts]  # noqa: B023


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id long, content string")
    assert plan(chunking.ingest_gate(docs, F.col("content"))).split("== Optimized")[1].split("== Physical")[0].count("aggregate(") == 1
    for q in ("q_type_quota", "q_coverage_display", "q_summary"):
        optimized = plan(P.QUERIES[q](spark, SF)).split("== Optimized")[1].split("== Physical")[0]
        assert max(optimized.count("aggregate("), optimized.count("regexp_extract_all(") // 4) == 1


def test_stored_chunks_hold_what_modules_read(spark):
    """Modules read places and texts: tokens are not counted for them, nor digests made."""
    stored, read = (D.headed_chunks(spark, SF, stored=x).select("doc_id", "chunk_id", "text") for x in (True, False))
    assert set(D.headed_chunks(spark, SF, stored=True).columns) == {"doc_id", "chunk_id", "text"}
    assert stored.exceptAll(read).count() == read.exceptAll(stored).count() == 0 and read.count() > 0


@pytest.mark.parametrize(("piece", "least"), [(32 << 20, 1), (1 << 12, 8)])
def test_pieces_of_a_table_do_not_grow_with_it(spark, monkeypatch, piece, least):
    monkeypatch.setattr(tables, "_PIECE", piece)
    assert tables.table(spark, SF, "documents", spread=True).rdd.getNumPartitions() >= least * spark.sparkContext.defaultParallelism


def test_a_large_table_in_few_row_groups_is_dealt_out(spark, tmp_path):
    """A row group is one task's, whatever the size of splits: few of them leave the other cores without texts."""
    n = 4 * spark.sparkContext.defaultParallelism
    rows = pd.DataFrame({"doc_id": range(800), "text": [hashlib.sha256(str(i).encode()).hexdigest() * 8 for i in range(800)]})
    with setting(spark, "spark.sql.files.maxPartitionBytes", "2k"):
        for name, size in (("lumps", 800), ("even", 800 // n)):
            rows.to_parquet(tmp_path / f"{name}.parquet", row_group_size=size)
        lumps, even = (table(spark, str(tmp_path), name, spread=True) for name in ("lumps", "even"))
        assert longest_share(spark.read.parquet(f"{tmp_path}/lumps.parquet")) == 1 and longest_share(lumps) < 2 / spark.sparkContext.defaultParallelism
        assert "Repartition" not in even._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, lumps.collect())) == sorted(map(tuple, rows.itertuples(index=False)))
        assert table(spark, str(tmp_path), "lumps").rdd.getNumPartitions() > 1 and longest_share(lumps.where("false")) == 0


def test_pieces_are_bounded_by_rows_where_bytes_say_little(spark, tmp_path):
    """Texts that repeat are stored once: a table of few bytes may hold many, which its pieces have to share."""
    n = 3 * tables._ROWS * spark.sparkContext.defaultParallelism
    spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one text "), 400).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/same.parquet")
    same = table(spark, str(tmp_path), "same", spread=True)
    rows = same.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert rows.sum() == n and rows.max() < 2 * tables._ROWS


def test_what_is_written_leaves_no_shuffle_behind(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    out = tables.written(spark.range(20000).repartition(4, "id"), "once")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and out.count() == 20000 and spark.conf.get(tables._FREED) == "false"
