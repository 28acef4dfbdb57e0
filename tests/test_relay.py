"""The relay over several batches: order, retries, stages, and a batch that is killed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewright.shared import new_path
from pagewright.streaming import relay

SCHEMA = "run string, sequence long, event_id string, event_type string, payload string"


def events(spark, *rows):
    kinds = {"p": "ingestion.requested.v1", "i": "index.built", "u": "other"}
    return spark.createDataFrame([(r, s, f"{r}{s}", kinds[k], "{}") for r, s, k in rows], SCHEMA)


class Clock:
    def __init__(self):
        self.at = dt.datetime(2024, 1, 1)

    def __call__(self):
        return F.lit(self.at)


def sink(sent, refuses=()):
    def put(rows):
        got = sorted((r["run"], r["sequence"]) for r in rows.collect())
        sent.extend(got)
        return rows.select("event_id", (~F.col("event_id").isin(list(refuses) or [""])).alias("ok"))

    return put


def test_order_retries_and_stages(spark):
    path, clock, parse, project = new_path(spark, "relay"), Clock(), [], []
    refuses = {"a2"}
    step = relay.relay(path, {"PARSE": lambda rows: sink(parse, refuses)(rows), "PROJECT": sink(project)}, rounds=3, now=clock)
    step(events(spark, ("a", 1, "p"), ("a", 2, "p"), ("a", 3, "p"), ("b", 2, "i"), ("b", 1, "p"), ("c", 1, "u"), ("c", 2, "p")), 0)
    assert parse == [("a", 1), ("b", 1), ("a", 2)] and project == [("b", 2)]  # a2 holds back a3, c1 has no sink and holds back c2
    left = {r["event_id"]: (r["attempts"], (r["available_at"] - clock.at).total_seconds()) for r in relay.waiting(spark, path, 0).collect()}
    assert left == {"a2": (1, 2.0), "a3": (0, 0.0), "c1": (0, 0.0), "c2": (0, 0.0)}
    clock.at += dt.timedelta(seconds=1)  # too early for a2; repeats of what was delivered are known
    step(events(spark, ("a", 1, "p"), ("b", 1, "p"), ("b", 3, "p"), ("a", 2, "p")), 1)
    assert parse[3:] == [("b", 3)]
    clock.at += dt.timedelta(seconds=1)
    step(events(spark), 2)
    assert parse[4:] == [("a", 2)] and {r["event_id"]: r["attempts"] for r in relay.waiting(spark, path, 2).collect()}["a2"] == 2
    refuses.clear()
    clock.at += dt.timedelta(seconds=5)
    step(events(spark), 3)
    assert parse[5:] == [("a", 2), ("a", 3)]
    delivered = relay.ledger(spark, path)
    assert sorted(r["event_id"] for r in delivered.collect()) == ["a1", "a2", "a3", "b1", "b2", "b3"] and relay.in_order(delivered).isEmpty()


def test_a_killed_batch_sends_nothing_twice(spark):
    path, clock, parse = new_path(spark, "relay"), Clock(), []

    def broken(rows):
        raise RuntimeError("killed")

    rows = events(spark, ("a", 1, "p"), ("a", 2, "i"), ("b", 1, "p"))
    with pytest.raises(RuntimeError):
        relay.relay(path, {"PARSE": sink(parse), "PROJECT": broken}, rounds=2, now=clock)(rows, 0)
    assert parse == [("a", 1), ("b", 1)]
    project = []
    relay.relay(path, {"PARSE": sink(parse), "PROJECT": sink(project)}, rounds=2, now=clock)(rows, 0)
    assert parse == [("a", 1), ("b", 1)] and project == [("a", 2)]
    assert sorted(r["event_id"] for r in relay.ledger(spark, path).collect()) == ["a1", "a2", "b1"] and relay.waiting(spark, path, 0).isEmpty()


def test_on_a_stream(spark):
    from pagewright.streaming import sequences

    path, source, log, parse = new_path(spark, "relay"), new_path(spark, "in"), new_path(spark, "log"), []
    step = relay.relay(path, {"PARSE": sink(parse)}, rounds=2)
    for part in ([("a", 1, "p"), ("b", 1, "p")], [("a", 2, "p")]):
        events(spark, *part).coalesce(1).write.mode("append").parquet(source)
        sequences.run_available(spark.readStream.schema(SCHEMA).parquet(source), step, log)
    assert parse == [("a", 1), ("b", 1), ("a", 2)] and relay.ledger(spark, path).count() == 3
