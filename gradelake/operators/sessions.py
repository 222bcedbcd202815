"""Session telemetry: capped interactions, sampling, and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_MS = 600_000
MOST_INTERACTIONS = 5_000


@dataclass(frozen=True)
class Limits:
    """What one session's recorder keeps."""

    ms: int = MOST_MS
    interactions: int = MOST_INTERACTIONS
    cursors: int = 10_000
    stored: int = 30_000
    scroll_gap_ms: int = 200
    cursor_gap_ms: int = 250


def capped(events: DataFrame, session: str, time_ms: str, tie: str, most: int = MOST_INTERACTIONS, most_ms: int = MOST_MS) -> DataFrame:
    """The first ``most`` events of each session before ``most_ms``; the rest is not recorded."""
    order = Window.partitionBy(session).orderBy(time_ms, tie)
    kept = events.where(F.col(time_ms) < most_ms)
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def throttled(events: DataFrame, session: str, time_ms: str, tie: str, gap_ms: int) -> DataFrame:
    """(session, kept_ms): the times kept when each must be ``gap_ms`` after the last kept one.

    What is kept hangs on what was kept before, so the times of a session are folded in
    order. Times that repeat cannot both be kept, so a session's list has at most one entry
    per millisecond of its length, which the caps bound.
    """
    ordered = F.array_sort(F.collect_set(F.col(time_ms)))
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(None).cast("bigint").alias("last"), none.alias("out"))

    def step(state, t):
        keep = state["last"].isNull() | (t - state["last"] >= gap_ms)
        return F.struct(F.when(keep, t).otherwise(state["last"]).alias("last"), F.when(keep, F.concat(state["out"], F.array(t))).otherwise(state["out"]).alias("out"))

    folded = events.groupBy(session).agg(ordered.alias("_t"))
    return folded.select(session, F.explode(F.aggregate("_t", start, step, lambda s: s["out"])).alias("kept_ms"))


def recorded(events: DataFrame, limits: Limits, user: str = "user_id", event: str = "event_id", ts: str = "ts") -> DataFrame:
    """(user, event, t, type, kind): what the recorder keeps of each session, and its replay store.

    ``events`` has ``type`` (scroll and cursor are sampled, all others are not). ``t`` is in
    milliseconds from the session's first event. Interactions (kind interaction) and cursor
    samples (kind cursor) are kept up to their numbers, sampled ones when their gap has passed
    since the last one kept. The store (kind store) takes every event; when it overflows, the
    older half goes, so what is left is the newest events, as many as follow from their number.
    Events at one time go by their id.
    """
    by_user = Window.partitionBy(user)
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000)
    rows = events.select(user, event, "type", at.alias("_at")).withColumn("t", F.col("_at") - F.min("_at").over(by_user)).where(F.col("t") < limits.ms).drop("_at")
    kept = []
    for kind, gap in (("scroll", limits.scroll_gap_ms), ("cursor", limits.cursor_gap_ms)):
        of = rows.where(F.col("type") == kind)
        times = throttled(of, user, "t", event, gap).select(user, F.col("kept_ms").alias("t"))
        first = of.groupBy(user, "t").agg(F.min(event).alias(event))  # of events at one time the first is kept
        kept.append(first.join(times, [user, "t"]).select(user, event, "t", F.lit(kind).alias("type")))
    free = rows.where(~F.col("type").isin("scroll", "cursor")).select(user, event, "t", "type")
    order = by_user.orderBy("t", event)
    nth = F.row_number().over(order)
    interactions = free.unionByName(kept[0]).withColumn("_n", nth).where(F.col("_n") <= limits.interactions)
    cursors = kept[1].withColumn("_n", nth).where(F.col("_n") <= limits.cursors)
    n, most = F.count(F.lit(1)).over(by_user), limits.stored
    left = most + 1 - (most + 1) // 2  # after the first overflow; from then on every most + 1 - left events
    size = F.when(n <= most, n).otherwise(left + (n - (most + 1)) % (most + 1 - left))
    store = rows.withColumns({"_s": size, "_n": F.row_number().over(by_user.orderBy(F.desc("t"), F.desc(event)))}).where("_n <= _s").drop("_s")
    told = lambda df, kind: df.select(user, event, "t", "type", F.lit(kind).alias("kind"))
    return told(interactions, "interaction").unionByName(told(cursors, "cursor")).unionByName(told(store, "store"))


def closed_attempts(actions: DataFrame) -> DataFrame:
    """(attempt_id, answers, closed_at, by): one row for each attempt that was started.

    ``actions`` is (attempt_id, ts, seq, kind, question_id, answer, limit_minutes), kind being
    start, answer or submit. An attempt closes by its first submission in time (by student) or
    at the end of its limit (by time), with the last answer to each question until then.
    """
    at = F.col("ts").cast("timestamp")
    starts = actions.where("kind = 'start'").groupBy("attempt_id").agg(F.max(at + F.make_dt_interval(mins=F.col("limit_minutes"))).alias("ends"))
    sent = actions.where("kind = 'submit'").select("attempt_id", at.alias("submitted")).join(starts, "attempt_id").where("submitted <= ends").groupBy("attempt_id").agg(F.min("submitted").alias("submitted"))
    ends = auto_submitted(starts.join(sent, "attempt_id", "left").withColumns({"_from": F.col("ends"), "_none": F.lit(0)}), "_from", "_none", "submitted")
    given = actions.where("kind = 'answer'").select("attempt_id", at.alias("_at"), "seq", "question_id", "answer").join(ends.select("attempt_id", "closed_at"), "attempt_id").where("_at <= closed_at")
    last = given.groupBy("attempt_id", "question_id").agg(F.max_by("answer", F.struct("_at", "seq", "answer")).alias("answer"))
    listed = last.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("question_id", "answer"))).alias("answers"))
    none = F.array().cast("array<struct<question_id:bigint,answer:string>>")
    return ends.join(listed, "attempt_id", "left").select("attempt_id", F.coalesce("answers", none).alias("answers"), "closed_at", F.when(F.col("submitted").isNull(), "time").otherwise("student").alias("by"))


def summaries(events: DataFrame, session: str, time_ms: str, tie: str) -> DataFrame:
    """Per session: clicks, scrolls, depth, distinct elements, first times, cursor distance and duration.

    ``events`` has type (click, scroll or other), element, depth_pct, x and y. A first time of
    0 gives way to the next one, as recorded data has it.
    """
    order = Window.partitionBy(session).orderBy(time_ms, tie)
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    rows = events.withColumn("_d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    first = lambda kind: F.coalesce(F.min(F.when((F.col("type") == kind) & (F.col(time_ms) > 0), F.col(time_ms))), F.min(F.when(F.col("type") == kind, F.col(time_ms))))
    return rows.groupBy(session).agg(
        F.count_if(F.col("type") == "click").alias("total_clicks"),
        F.count_if(F.col("type") == "scroll").alias("total_scrolls"),
        F.coalesce(F.max(F.when(F.col("type") == "scroll", F.col("depth_pct"))), F.lit(0)).alias("max_scroll_depth_pct"),
        F.count_distinct(F.when(F.col("type") == "click", F.col("element"))).alias("unique_elements_clicked"),
        first("click").alias("time_to_first_click_ms"),
        first("scroll").alias("time_to_first_scroll_ms"),
        F.floor(F.sum("_d") + 0.5).cast("long").alias("cursor_distance_px"),
        F.max(time_ms).alias("duration_ms"),
    )


def auto_submitted(attempts: DataFrame, started: str, limit_minutes: str, submitted: str) -> DataFrame:
    """``closed_at``: the submission, or the end of the time limit if that comes first; once per attempt."""
    end = F.col(started) + F.make_dt_interval(mins=F.col(limit_minutes))
    return attempts.withColumn("closed_at", F.coalesce(F.least(F.col(submitted), end), F.col(submitted), end))


def halved_on_overflow(events: DataFrame, user: str, time_ms: str, order: str, most: int) -> DataFrame:
    """A session's events after its store overflowed: the oldest half goes, again and again, until ``most`` fit."""
    by_user = Window.partitionBy(user)
    n = F.count(F.lit(1)).over(by_user)
    times = F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(most))))).cast("int")
    kept = F.ceil(n / F.pow(F.lit(2.0), times))
    newest = F.row_number().over(by_user.orderBy(F.desc(time_ms), F.desc(order)))
    return events.withColumns({"_k": kept, "_r": newest}).where("_r <= _k").drop("_k", "_r")
