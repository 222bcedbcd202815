"""Streams with keyed state and timers against the batch operators, in one go and after a restart."""

import shutil

import pytest
from pyspark.sql import functions as F

from gradelake.operators import sessions
from gradelake.streaming import recorder, sessions as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"
LIMITS = sessions.Limits(ms=864_000_000, interactions=12, cursors=9, stored=7, scroll_gap_ms=3_600_000, cursor_gap_ms=7_200_000)


def parts(df, folder, n, ts="ts"):
    """The rows in order of time in n files, which the stream reads one after the other."""
    rows = df.orderBy(ts).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(f"{folder}/{i}")


@pytest.fixture(scope="module")
def events(spark):
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "scroll").otherwise("cursor")
    return spark.read.parquet(EVENTS).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"))


def last_event(spark, schema):
    """An event long after all others, so that the watermark passes them."""
    return spark.createDataFrame([(-1, -1, "2030-01-01 00:00:00", "click")], "user_id long, event_id long, ts string, type string").withColumn("ts", F.to_timestamp("ts")).select(*schema.names)


def rows(df):
    return sorted(map(tuple, df.where("user_id >= 0").select("user_id", "event_id", "t", "type", "kind").collect()))


def test_recorder_stream_equals_batch(spark, events, tmp_path):
    parts(events, tmp_path / "in", 5)
    args = lambda: (spark, recorder.recorded_stream(streams.event_stream(spark, str(tmp_path / "in" / "*"), events.schema), LIMITS, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    # The first run sees three files only; the second goes on from its state.
    for i in (3, 4):
        shutil.move(str(tmp_path / "in" / str(i)), str(tmp_path / f"later{i}"))
    recorder.run(*args())
    for i in (3, 4):
        shutil.move(str(tmp_path / f"later{i}"), str(tmp_path / "in" / str(i)))
    recorder.run(*args())
    last_event(spark, events.schema).write.parquet(str(tmp_path / "in" / "9"))
    recorder.run(*args())
    got, want = rows(spark.read.parquet(str(tmp_path / "out"))), rows(sessions.recorded(events, LIMITS))
    assert got == want and {k for *_, k in got} == {"interaction", "cursor", "store"}


def test_recorder_by_hand(spark):
    times = [(1, 0, "scroll"), (2, 100, "scroll"), (3, 200, "scroll"), (4, 210, "click"), (5, 210, "cursor"), (6, 300, "cursor"), (7, 460, "cursor"), (8, 999, "key"), (9, 1000, "click")]
    df = spark.createDataFrame([(7, e, t, k) for e, t, k in times], "user_id long, event_id long, t long, type string").withColumn("ts", F.timestamp_millis(F.col("t") + 5)).drop("t")
    got = rows(sessions.recorded(df, sessions.Limits(ms=1000, interactions=3, stored=4)))
    assert [(e, k) for _, e, _, _, k in got] == [(1, "interaction"), (3, "interaction"), (4, "interaction"), (5, "cursor"), (5, "store"), (6, "store"), (7, "cursor"), (7, "store"), (8, "store")]


@pytest.mark.parametrize("most", [1, 2, 5, 8])
def test_store_by_hand(spark, most):
    for n in range(1, 25):
        store = []
        for i in range(n):
            store.append(i)
            if len(store) > most:
                store = store[len(store) // 2 :]
        left = most + 1 - (most + 1) // 2
        assert len(store) == (n if n <= most else left + (n - (most + 1)) % (most + 1 - left))
        assert store == list(range(n))[-len(store) :]


ACTIONS = "attempt_id long, ts string, seq long, kind string, question_id long, answer string, limit_minutes int"


def test_countdown_stream_equals_batch(spark, tmp_path):
    at = lambda m, s=0: f"2024-01-01 10:{m:02d}:{s:02d}"
    actions = []
    for a in range(1, 13):
        actions.append((a, at(a), 0, "start", None, None, 10 + a % 3))
        for i in range(1, 6):
            actions.append((a, at(a + 3 * i, a), i, "answer", i % 3, f"a{a}-{i}", None))
        if a % 3 == 0:
            actions.append((a, at(a + 7), 6, "submit", None, None, None))
        if a % 4 == 1:
            actions.append((a, at(a + 30), 7, "submit", None, None, None))  # after the end
    df = spark.createDataFrame(actions, ACTIONS).withColumn("ts", F.to_timestamp("ts"))
    parts(df, tmp_path / "in", 5)
    stream = lambda: recorder.closed_stream(streams.event_stream(spark, str(tmp_path / "in" / "*"), df.schema), "1 minute")
    recorder.run(spark, stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    spark.createDataFrame([(99, "2024-01-02 00:00:00", 0, "answer", 1, "x", None)], ACTIONS).withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in" / "9"))
    recorder.run(spark, stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    key = lambda d: sorted((r.attempt_id, str(r.closed_at), r.by, tuple(map(tuple, r.answers))) for r in d.collect())
    got = key(spark.read.parquet(str(tmp_path / "out")))
    assert got == key(sessions.closed_attempts(df)) and len(got) == 12
    assert {by for _, _, by, _ in got} == {"time", "student"}
