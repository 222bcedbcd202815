"""Change logs merged into stored tables, and rollups kept up to date by signed deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions import grading as G

#: Columns of a stored table besides its own: the last change it has seen, whether the row is gone, its bucket.
SEQ, GONE, BUCKET = "_seq", "_gone", "_bucket"


def folded(log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key of a log (seq, key, op, columns): what its changes come to, whatever their order.

    ``op`` is put (the columns that are not null take new values, the row is made if there is
    none) or delete. Kept are the last deletion, the last put and, for each column, the last
    put that set it: maxima, so that each task sends one row for each key.
    """
    put, seq = F.col("op") == "put", F.col("seq")
    last = lambda c: F.max(F.when(put & F.col(c).isNotNull(), F.struct(seq.alias("s"), F.col(c).alias("v")))).alias(f"_n_{c}")
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.when(F.col("op") == "delete", seq)).alias("_deleted"), F.max(F.when(put, seq)).alias("_put"), *[last(c) for c in columns])


def merged(stored: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``stored`` (key, columns, _seq, _gone) after a log: last write wins by sequence number, column by column.

    A row knows the last change it has seen; older ones do nothing to it, so a log may be run
    again, whole or in part. Logs follow one another; in one, changes may stand in any order.
    Rows that are deleted stay as marks, so that an old put does not bring them back. Two
    changes of one number are one change; of their values the greatest counts.
    """
    new = folded(log, key, columns)
    met = stored.join(new, key, "full_outer")
    seen = F.coalesce(SEQ, F.lit(-1).cast("long"))
    deleted = F.coalesce("_deleted", F.lit(-1).cast("long"))
    cleared = (deleted > seen) | F.coalesce(GONE, F.lit(True))
    values = {c: F.when(F.col(f"_n_{c}.s") > F.greatest(seen, deleted), F.col(f"_n_{c}.v")).otherwise(F.when(~cleared, F.col(c))) for c in columns}
    put = F.coalesce("_put", F.lit(-1).cast("long"))
    alive = F.when(F.greatest(put, deleted) > seen, put > deleted).otherwise(~F.coalesce(GONE, F.lit(True)))
    return met.select(key, *[v.alias(c) for c, v in values.items()], F.greatest(seen, put, deleted).alias(SEQ), (~alive).alias(GONE))


def live(stored: DataFrame) -> DataFrame:
    """The rows of a stored table that are not gone, without what belongs to the store."""
    return stored.where(~F.col(GONE)).drop(SEQ, GONE, BUCKET)


def fresh(rows: DataFrame) -> DataFrame:
    """Rows as a stored table has them before any change."""
    return rows.withColumns({SEQ: F.lit(-1).cast("long"), GONE: F.lit(False)})


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias(BUCKET)


def stored(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write a table in ``buckets`` parts by its key, ready for ``apply_log``."""
    out = fresh(rows).withColumn(BUCKET, _bucket(key, buckets))
    out.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(path)


def apply_log(spark: SparkSession, path: str, log: DataFrame, key: str, columns: list[str], buckets: int) -> None:
    """Merge a log into the table at ``path``; only the buckets that hold one of its keys are read and written anew.

    A run that ends half-way leaves some buckets old and others new, both whole: run again, it
    does the rest. At most ``buckets`` numbers come to the driver.
    """
    dealt = log.withColumn(BUCKET, _bucket(key, buckets))
    touched = [r[0] for r in dealt.where(F.col(key).isNotNull()).select(BUCKET).distinct().collect()]
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = merged(old, log, key, columns).withColumn(BUCKET, _bucket(key, buckets))
    new.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def regrade_delta(answers: DataFrame, regrades: DataFrame, questions: DataFrame) -> DataFrame:
    """(submission_id, score, total, n_answers): what new scores (submission_id, question_id, score) change in the totals, signed.

    Each answer that is graded again counts once less as it was and once more as it is. Only
    submissions that are graded again are read, by a semi-join that reaches the scan of answers
    as a filter where they are few. Of several scores of one answer the greatest counts.
    """
    new = regrades.groupBy("submission_id", "question_id").agg(F.max("score").alias("_new"))
    touched = answers.join(new.select("submission_id").distinct(), "submission_id", "left_semi")
    q = questions.select(F.col("id").alias("question_id"), "points")
    met = touched.join(new, ["submission_id", "question_id"]).join(q, "question_id")
    sign = F.explode(F.array(F.struct(F.lit(-1).alias("s"), F.col("score").alias("v")), F.struct(F.lit(1).alias("s"), F.col("_new").alias("v"))))
    rows = met.select("submission_id", "points", sign.alias("d"))
    s = F.col("d.s")
    return rows.groupBy("submission_id").agg(F.sum(s * G.clamped(F.col("d.v"), F.col("points"))).cast("long").alias("score"), F.sum(s * F.col("points")).cast("long").alias("total"), F.sum(s).cast("long").alias("n_answers"))


def kept_up(view: DataFrame, delta: DataFrame, keys: list[str], count: str = "n_answers") -> DataFrame:
    """A view of sums after a signed delta of the same columns; rows whose ``count`` comes to 0 go."""
    sums = [c for c in view.columns if c not in keys]
    both = view.unionByName(delta.select(*view.columns))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(count) != 0)


def roster_delta(delta: DataFrame, submissions: DataFrame) -> DataFrame:
    """(student_id, score, total, n_evaluated): what a delta of submission totals changes for students; a regrade adds no submission."""
    of = submissions.where("status = 'evaluated'").select(F.col("id").alias("submission_id"), "student_id")
    zero = F.lit(0).cast("long")
    return delta.join(of, "submission_id").groupBy("student_id").agg(F.sum("score").alias("score"), F.sum("total").alias("total"), F.max(zero).alias("n_evaluated"))
