"""Streams with typed state: bounded logs with a time to live, and timers for leases and deadlines.

State lies in RocksDB and in the checkpoint, so a restarted query goes on where it was. A key's state is one number, or as many
as a log retains.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep typed state."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- bounded logs ------------------------------------------------------------------------

APPENDED = "key string, sequence long, event_id long, outcome string"


class _Append(StatefulProcessor):
    def __init__(self, most: int, retention_ms: int | None) -> None:
        self.most, self.retention = most, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence long, at_ms long")
        self.tail = handle.getListState("tail", "sequence long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, begun = (tuple(self.last.get()) if self.last.exists() else (None, 0)), False
        new = []
        for sequence, event_id, at in sorted((r.sequence, r.event_id, r.at_ms) for r in rows):
            if last[0] is not None and self.retention is not None and at >= last[1] + self.retention:
                last, new, begun = (None, 0), [], True  # the log is gone, and its key is a new one
            follows = last[0] is None or sequence == last[0] + 1
            if follows:
                last = (sequence, max(at, last[1]))
                new.append((sequence, event_id))
            yield Row(key=key[0], sequence=sequence, event_id=event_id, outcome="APPENDED" if follows else "GAP" if sequence > last[0] else "DUPLICATE")
        if new:
            self.last.update(last)
            held = [] if begun or len(new) >= self.most or not self.tail.exists() else [tuple(x) for x in self.tail.get()]
            self.tail.put([*held, *new][-self.most :])
            if self.retention is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last[1] + self.retention)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        self.tail.clear()
        return iter(())


def bounded_log(stream: DataFrame, most: int, retention_ms: int | None = None) -> DataFrame:
    """``stream`` has key, sequence and event_id; each event comes out as APPENDED, DUPLICATE (at or before the last) or GAP.

    A log begins with whatever number its key has first and keeps its newest ``most`` events. With ``retention_ms``, for which
    events have a time ``at``, it is gone so long after the last event that was appended, by the watermark or by the time of the
    key's own next event, whichever comes first; then it begins anew. Events of a key are taken in the order of their numbers
    within a batch.
    """
    columns = [F.col("key").cast("string").alias("key"), F.col("sequence").cast("long").alias("sequence"), F.col("event_id").cast("long").alias("event_id")]
    if retention_ms is None:
        rows = stream.select(*columns, F.lit(0).cast("long").alias("at_ms"))
    else:
        rows = stream.withWatermark("at", "0 seconds").select(*columns, F.unix_millis("at").alias("at_ms"), "at")
    return rows.groupBy("key").transformWithState(_Append(most, retention_ms), APPENDED, "Append", "None" if retention_ms is None else "EventTime")


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, sequence, event_id: what the logs hold, read from a query's state."""
    with state_store(spark):
        rows = spark.read.format("statestore").option("stateVarName", "tail").load(checkpoint)
    return rows.select(F.col("key.key").alias("key"), "list_element.*")


# ---- timers ------------------------------------------------------------------------------

EXPIRED = "key string, end long, attempt int, next_status string"


def _after(attempt: int, most: int) -> tuple[str, int]:
    """What becomes of a job whose lease has run out, and the attempt that comes next."""
    return ("WAITING", attempt) if attempt >= most else ("QUEUED", attempt + 1)


def _step(state: tuple[int | None, int], action: str, at: int, until: int | None) -> tuple[int | None, int]:
    """The lease (its end, or None) and the attempt after an action that comes while nothing has run out."""
    end, attempt = state
    if action == "lease" and end is None or action == "renew" and end is not None:
        return until, attempt
    return (None, attempt) if action == "done" else state


class _Leases(StatefulProcessor):
    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "until long, attempt int")

    def _expired(self, key: tuple, end: int, attempt: int) -> tuple[Row, int]:
        status, following = _after(attempt, self.most)
        return Row(key=key[0], end=end, attempt=attempt, next_status=status), following

    def _keep(self, state: tuple[int | None, int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.lease.update(state)
        if state[0] is not None:
            self.handle.registerTimer(state[0])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.lease.get()) if self.lease.exists() else (None, 1)
        for r in sorted(((r.at_ms, r.action, r.until_ms) for r in rows), key=lambda r: (r[0], r[1])):
            if state[0] is not None and state[0] <= r[0]:
                out, following = self._expired(key, *state)
                yield out
                state = (None, following)
            state = _step(state, r[1], r[0], r[2])
        self._keep(state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = tuple(self.lease.get()) if self.lease.exists() else (None, 1)
        if state[0] is not None and state[0] <= expiredTimerInfo.getExpiryTimeInMs():
            out, following = self._expired(key, *state)
            self.lease.update((None, following))
            yield out


def _moments(log: DataFrame) -> list[Column]:
    ms = lambda c: F.unix_millis(F.col(c)).alias(f"{c}_ms")
    return [F.col("key").cast("string").alias("key"), "action", ms("at"), ms("until")]


def _told(found: DataFrame) -> DataFrame:
    return found.select("key", F.timestamp_millis("end").alias("expired_at"), "attempt", "next_status")


def expiring_leases(stream: DataFrame, most_attempts: int, lateness: str = "0 seconds") -> DataFrame:
    """key, expired_at, attempt, next_status of leases that ran out: ``stream`` has key, action (lease, renew, done), at and until.

    A timer per key fires when the watermark passes the lease's end; a renewal that comes in time moves it, the end of the work
    takes it away, and one that comes too late changes nothing. After the last attempt a job waits for a person.
    """
    rows = stream.withWatermark("at", lateness).select(*_moments(stream), "at")
    return _told(rows.groupBy("key").transformWithState(_Leases(most_attempts), EXPIRED, "Append", "EventTime"))


def expired_leases(log: DataFrame, most_attempts: int, as_of: Column) -> DataFrame:
    """What ``expiring_leases`` says of a whole log by a given time, as a batch: sorted rows stream through their task, which keeps one lease."""
    rows = log.select(*_moments(log), F.unix_millis(as_of).alias("as_of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, limit, begun = None, (None, 1), 0, False
        out: list[tuple] = []

        def close() -> None:
            if begun and state[0] is not None and state[0] <= limit:
                out.append((key, state[0], state[1], _after(state[1], most_attempts)[0]))

        def sent() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["key", "end", "attempt", "next_status"])
            out.clear()
            return made

        for b in batches:
            for k, action, at, until, as_of_ in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if k != key or not begun:
                    close()
                    key, state, begun = k, (None, 1), True
                limit = as_of_
                if state[0] is not None and state[0] <= at:
                    status, following = _after(state[1], most_attempts)
                    out.append((key, state[0], state[1], status))
                    state = (None, following)
                state = _step(state, action, at, until)
            yield sent()
        close()
        yield sent()

    found = rows.repartition("key").sortWithinPartitions("key", "at_ms", "action").mapInArrow(run, EXPIRED)
    return _told(found)
