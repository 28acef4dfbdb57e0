"""State over several batches."""

from pagewright.shared import new_path
from pagewright.streaming import sequences


def test_late_repeats_are_dropped(spark):
    path, out, log = (new_path(spark, n) for n in ("in", "out", "log"))
    schema = "k int, ts timestamp"
    for second in (1, 2):
        spark.sql(f"SELECT 1 AS k, timestamp'2024-01-01 00:00:0{second}' AS ts").write.mode("append").parquet(path)
        stream = sequences.deduplicated(spark.readStream.schema(schema).parquet(path), ["k"], "ts", "1 hour")
        sequences.run_available(stream, sequences.batch_sink(out), log)
    assert spark.read.parquet(out).count() == 1


def test_listener_adds_up_what_passes(spark):
    """Totals of a stream over two runs are those of the batch histogram."""
    import time

    from pyspark.sql import functions as F

    from pagewright.operators import events
    from pagewright.streaming import metrics

    bounds, schema = (0.1, 1.0, 10.0), "id long, lag double"
    path, out, log = (new_path(spark, n) for n in ("in", "out", "log"))
    rows = [(i, (i * 37 % 200) / 10) for i in range(300)]
    listener = metrics.Histogram(bounds)
    spark.streams.addListener(listener)
    try:
        for part in (rows[:100], rows[100:]):
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(path)
            stream = metrics.observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path), F.col("lag"), bounds)
            sequences.run_available(stream, sequences.batch_sink(out), log)
        deadline = time.time() + 20
        while listener.totals().get("n") != 300 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = listener.totals()
    batch = events.lag_histogram(spark.createDataFrame(rows, schema).withColumn("k", F.lit(1)), F.col("lag"), bounds, "k")
    assert {r["le"]: r["n"] for r in batch.collect()} == {le: got[le] for le in listener.bounds}
    assert got["n"] == 300 and abs(got["total"] - sum(x for _, x in rows)) < 1e-6
