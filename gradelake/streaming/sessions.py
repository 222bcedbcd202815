"""Session and ingest streams, each of the batch operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.sources import files as source


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n_events, n_clicks, n_views) of each closed session.

    Works on batches and streams; in a stream, sessions are emitted once the watermark has
    passed them. Event times without a zone are taken in the session's.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    out = grouped.agg(F.count(F.lit(1)).alias("n_events"), F.sum((F.col("event_type") == "click").cast("long")).alias("n_clicks"), F.sum((F.col("event_type") == "view").cast("long")).alias("n_views"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "n_clicks", "n_views")


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def flushed(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and end; state and progress stay in ``checkpoint``."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def ingest_stream(spark: SparkSession, folder: str, out: str, rejected: str, checkpoint: str, pdf: source.PdfReaders | None = None) -> None:
    """New files of a folder become documents with chunks, the others a list of rejects; each file once.

    A batch that is run again after a failure is written under its own number again.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        good, bad = source.ingested(batch, pdf=pdf)
        good.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
