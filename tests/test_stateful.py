"""Typed state over restarts, times to live, and timers."""

import random

from pyspark.sql import functions as F

from pagewright.shared import new_path
from pagewright.streaming import sequences, stateful


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_logs_over_restarts(spark):
    path, out, log = (new_path(spark, n) for n in ("in", "out", "log"))
    schema = "key string, sequence long, event_id long"

    def run(rows):
        feed(spark, path, rows, schema)
        with stateful.state_store(spark):
            sequences.run_available(stateful.bounded_log(spark.readStream.schema(schema).parquet(path), 3), sequences.batch_sink(out), log)

    run([("a", 58, 1), ("a", 59, 2), ("b", 1, 3), ("b", 3, 4), ("c", 1, 5)])  # any first number; a gap
    run([("a", 60, 6), ("a", 59, 7), ("a", 61, 8), ("a", 63, 9), ("b", 2, 10), ("b", 3, 11)])
    got = {r["event_id"]: r["outcome"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "APPENDED", 2: "APPENDED", 3: "APPENDED", 4: "GAP", 5: "APPENDED", 6: "APPENDED", 7: "DUPLICATE", 8: "APPENDED", 9: "GAP", 10: "APPENDED", 11: "APPENDED"}
    held = {}
    for r in stateful.retained(spark, log).collect():
        held.setdefault(r["key"], []).append((r["sequence"], r["event_id"]))
    assert {k: sorted(v) for k, v in held.items()} == {"a": [(59, 2), (60, 6), (61, 8)], "b": [(1, 3), (2, 10), (3, 11)], "c": [(1, 5)]}


def test_logs_begin_anew_after_their_time(spark):
    path, out, log = (new_path(spark, n) for n in ("in", "out", "log"))
    schema = "key string, sequence long, event_id long, at_s long"

    def run(rows):
        feed(spark, path, rows, schema)
        stream = spark.readStream.schema(schema).parquet(path).withColumn("at", F.timestamp_seconds("at_s"))
        with stateful.state_store(spark):
            sequences.run_available(stateful.bounded_log(stream, 3, 3_000), sequences.batch_sink(out), log)

    run([("k", 1, 1, 100), ("k", 2, 2, 101), ("other", 1, 6, 101)])
    run([("k", 58, 3, 104), ("k", 59, 4, 104), ("k", 61, 5, 105), ("other", 2, 7, 103)])
    got = {r["event_id"]: r["outcome"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "APPENDED", 2: "APPENDED", 3: "APPENDED", 4: "APPENDED", 5: "GAP", 6: "APPENDED", 7: "APPENDED"}
    run([("x", 1, 8, 900)])  # time goes on, and what isn't written to is forgotten
    assert {(r["key"], r["sequence"]) for r in stateful.retained(spark, log).collect()} == {("x", 1)}
    run([("k", 7, 9, 901)])
    assert spark.read.parquet(out).filter("event_id = 9").first()["outcome"] == "APPENDED"


def lease_log(n, keys):
    draw, rows, at = random.Random(8), [], 1_000_000
    for i in range(n):
        at += draw.randint(1, 40)
        action = draw.choice(["lease", "lease", "renew", "renew", "done"])
        rows.append((f"j{draw.randrange(keys)}", action, at, at + draw.randint(10, 400) if action != "done" else None))
    return rows


def plain(rows, most, as_of):
    out, state = [], {}
    for key, action, at, until in [*rows, *[(k, "none", as_of, None) for k in {r[0] for r in rows}]]:
        end, attempt = state.get(key, (None, 1))
        if end is not None and end <= at:
            out.append((key, end, attempt, "WAITING" if attempt >= most else "QUEUED"))
            end, attempt = None, min(most, attempt + 1)
        if action == "lease" and end is None or action == "renew" and end is not None:
            end = until
        if action == "done":
            end = None
        state[key] = (end, attempt)
    return sorted(out)


def test_timers_say_what_the_batch_says(spark):
    rows = lease_log(160, 9)
    last = max(r[2] for r in rows)
    path, out, log = (new_path(spark, n) for n in ("in", "out", "log"))
    schema = "key string, action string, at_s long, until_s long"

    def moments(frame):
        return frame.select("key", "action", F.timestamp_seconds("at_s").alias("at"), F.timestamp_seconds("until_s").alias("until"))

    for begin in (0, 60, 110):  # the query ends and starts again in between
        feed(spark, path, rows[begin : begin + 60 if begin == 0 else begin + 50], schema)
        with stateful.state_store(spark):
            sequences.run_available(stateful.expiring_leases(moments(spark.readStream.schema(schema).parquet(path)), 3), sequences.batch_sink(out), log)
    want = plain(rows, 3, last)
    assert {w[3] for w in want} == {"QUEUED", "WAITING"}

    def shown(frame):
        return sorted((r["key"], r["s"], r["attempt"], r["next_status"]) for r in frame.select("key", F.unix_seconds("expired_at").alias("s"), "attempt", "next_status").collect())

    assert shown(stateful.expired_leases(moments(spark.createDataFrame(rows, schema)), 3, F.timestamp_seconds(F.lit(last)))) == want
    assert shown(spark.read.parquet(out)) == want
