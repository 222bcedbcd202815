"""The session recorder and the attempts' countdown as streams with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradelake.operators.sessions import Limits
from gradelake.streaming.sessions import flushed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state of several kinds needs."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


def _ms(ts: datetime) -> int:
    """Milliseconds since 1970, cut."""
    return int(pd.Timestamp(ts).value // 1_000_000)


RECORDED = "user_id long, event_id long, t long, type string, kind string"


@dataclass
class Recorder(StatefulProcessor):
    """One session's recorder: events wait until the watermark has passed them and are taken in order of time.

    State: the start, the last kept scroll and cursor times, how many of each are kept, and the
    replay store, of which the older half goes whenever it overflows. Rows out: what is
    recorded (``kind`` interaction or cursor) as soon as it is, and the store (``kind`` store)
    once, when the session's time is over.
    """

    limits: Limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "start long, scroll long, cursor long, interactions long, cursors long")
        self.waiting = handle.getListState("waiting", "event_id long, at long, type string")
        self.store = handle.getListState("store", "event_id long, t long, type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for some in rows:
            fresh = [(int(e), _ms(ts), k) for e, ts, k in zip(some["event_id"], some["ts"], some["type"], strict=True)]
            fresh = [r for r in fresh if r[1] > passed]
            if fresh:
                self.waiting.appendList(fresh)
                self.handle.registerTimer(max(r[1] for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in waiting if r[1] <= passed), key=lambda r: (r[1], r[0]))
        later = [r for r in waiting if r[1] > passed]
        self.waiting.put(later) if later else self.waiting.clear()
        most, out = self.limits, []
        start, scroll, cursor, interactions, cursors = self.progress.get() if self.progress.exists() else (None, None, None, 0, 0)
        store = list(self.store.get()) if self.store.exists() else []
        for event, at, kind in ready:
            if start is None:
                start = at
                self.handle.registerTimer(start + most.ms)
            t = at - start
            if t >= most.ms:
                continue
            store.append((event, t, kind))
            if len(store) > most.stored:
                store = store[len(store) // 2 :]
            if kind == "cursor":
                if cursors < most.cursors and (cursor is None or t - cursor >= most.cursor_gap_ms):
                    cursor, cursors = t, cursors + 1
                    out.append((event, t, kind, "cursor"))
            elif interactions < most.interactions and (kind != "scroll" or scroll is None or t - scroll >= most.scroll_gap_ms):
                scroll = t if kind == "scroll" else scroll
                interactions += 1
                out.append((event, t, kind, "interaction"))
        if start is not None:
            self.progress.update((start, scroll, cursor, interactions, cursors))
        if start is not None and expiredTimerInfo.getExpiryTimeInMs() == start + most.ms:
            out += [(*r, "store") for r in store]
            self.store.clear()
        elif store:
            self.store.put(store)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["user_id", "event_id", "t", "type", "kind"])

    def close(self) -> None:
        pass


def recorded_stream(events: DataFrame, limits: Limits, late: str = "10 minutes") -> DataFrame:
    """``operators.sessions.recorded`` of a stream (user_id, event_id, ts, type)."""
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "type").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Recorder(limits), RECORDED, "Append", "EventTime")


CLOSED = "attempt_id long, answers array<struct<question_id:long,answer:string>>, closed_at timestamp, by string"


@dataclass
class Countdown(StatefulProcessor):
    """One attempt: it is closed by its submission or, once the limit is over, with the answers given until then.

    Rows in: ``kind`` start (with ``limit_minutes``), answer (question and text; the last one of
    a question counts) or submit. One row out for each attempt; what comes after the end of its
    time is not taken.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "at long, ends long")
        self.given = handle.getListState("given", "at long, seq long, kind string, question_id long, answer string")
        self.done = handle.getValueState("done", "closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        for some in rows:
            fresh = []
            for at, seq, kind, q, text, limit in zip(some["ts"], some["seq"], some["kind"], some["question_id"], some["answer"], some["limit_minutes"], strict=True):
                if kind == "start":
                    ends = _ms(at) + int(limit) * 60_000
                    self.begun.update((_ms(at), ends))
                    self.handle.registerTimer(ends)
                else:
                    fresh.append((_ms(at), int(seq), kind, None if pd.isna(q) else int(q), None if pd.isna(text) else text))
                    if kind == "submit":
                        self.handle.registerTimer(_ms(at))
            if fresh:
                self.given.appendList(fresh)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists() or not self.begun.exists():
            return
        _, ends = self.begun.get()
        given = sorted(self.given.get(), key=lambda r: (r[0], r[1], r[4] or "")) if self.given.exists() else []
        sent = min((r[0] for r in given if r[2] == "submit" and r[0] <= ends), default=None)
        closed = ends if sent is None else sent
        if closed > timerValues.getCurrentWatermarkInMs():
            return
        answers = {r[3]: r[4] for r in given if r[2] == "answer" and r[0] <= closed}
        self.done.update((True,))
        self.begun.clear()
        self.given.clear()
        listed = [{"question_id": q, "answer": a} for q, a in sorted(answers.items())]
        moment = datetime.fromtimestamp(closed / 1000, timezone.utc)
        yield pd.DataFrame({"attempt_id": [key[0]], "answers": [listed], "closed_at": [moment], "by": ["time" if sent is None else "student"]})

    def close(self) -> None:
        pass


def closed_stream(actions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``operators.sessions.closed_attempts`` of a stream (attempt_id, ts, seq, kind, question_id, answer, limit_minutes)."""
    rows = actions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("attempt_id").transformWithStateInPandas(Countdown(), CLOSED, "Append", "EventTime")


def run(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream with keyed state over what is there and end; it goes on from ``checkpoint`` the next time."""
    with keyed_state(spark):
        flushed(stream, out, checkpoint)
