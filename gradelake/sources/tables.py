"""Stored tables: reading them so that all cores have work, and intermediate ones in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PIECE = 32 << 20  # bytes of a table that a task gets where it is dealt out,
_ROWS = 16_384  # and rows: a text that repeats is stored once in a row group, so that bytes may say little


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; on one machine without it, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gradelake-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again; it goes when the application ends.

    What was shuffled for it is not read again once it is written, and is given up then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    old = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, old)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def given_up(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave and that nothing reads again."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _rows(df: DataFrame) -> tuple[int, int]:
    """Of a stored table the rows, and those that the longest task reads; only the files' footers are read for it."""
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    row = tasks.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return row["rows"] or 0, row["most"] or 0


def longest_share(df: DataFrame) -> float:
    """Of a stored table's rows, the share that the longest task reads."""
    rows, most = _rows(df)
    return most / rows if rows else 0.0


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A Parquet table; with ``spread``, one that does not give every core its share of the rows is dealt out by rows.

    A row group is read by one task, however many splits its bytes fill, and a file may be one
    row group or a few: a few tasks would read all texts and work on them alone. Texts are worth
    a shuffle then, into pieces that do not grow with the table, by bytes or by rows, and so they
    are in a table too small to give every core a split. One whose longest task is a small part of a core's share
    is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt_out(df) if spread else df


def dealt_out(df: DataFrame) -> DataFrame:
    """A stored table as ``table`` deals it out."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    rows, most = _rows(df)
    longest = size * most / rows if rows else 0.0
    if size < cores * split or longest > max(size / (4 * cores), min(_PIECE, 1.5 * size / cores)):
        return df.repartition(cores * max(1, round(max(size / _PIECE, rows / _ROWS) / cores)))
    return df
