"""Maintenance on small state tables: every outcome, and tries again."""

from pyspark.sql import functions as F

from pagewright.operators import maintenance


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_every_outcome(spark):
    names = ["old", "live", "fine", "lost", "changed", "extra", "source", "later"]
    manifests = spark.createDataFrame([(m, "ACTIVE" if m == "live" else "SUPERSEDED" if m == "old" else "ACTIVE") for m in names], "manifest string, status string")
    records = spark.createDataFrame([(m, f"{m}{i}", f"h{i}", "p") for m in names for i in range(5)], "manifest string, vector_id string, content_sha256 string, profile string")
    held = records.filter("NOT (manifest IN ('lost', 'source') AND vector_id LIKE '%0')").withColumn("content_sha256", F.when(F.col("vector_id") == "changed3", "x").otherwise(F.col("content_sha256")))
    held = held.unionByName(spark.createDataFrame([("extra", "more", "h", "p")], records.schema))
    rows = [(m, "CLEANUP_MANIFEST" if m in ("old", "live") else "RECONCILE_MANIFEST", m, "PENDING", 0, 100 if m == "later" else -1) for m in names]
    tasks = spark.createDataFrame(rows, "task string, task_type string, manifest string, status string, attempts int, s int")
    tasks = tasks.withColumn("available_at", now() + F.make_dt_interval(secs=F.col("s"))).drop("s")
    got = maintenance.maintained(tasks, manifests, records, held, spark.createDataFrame([("source",)], "manifest string"), "p", now(), 60)
    outcomes = {r["task"]: r["outcome"] for r in got.outcomes.collect()}
    assert outcomes == {"old": "CLEANED", "live": "RETRY", "fine": "HEALTHY", "lost": "REPAIRED", "changed": "MANUAL", "extra": "MANUAL", "source": "MANUAL"}
    after = {r["task"]: (r["status"], r["d"]) for r in got.tasks.withColumn("d", F.unix_seconds("available_at") - F.unix_seconds(now())).collect()}
    assert after == {"old": ("SUCCEEDED", 60), "live": ("WAITING", 60), "fine": ("WAITING", 60), "lost": ("WAITING", 60), "changed": ("FAILED", 60), "extra": ("FAILED", 60), "source": ("FAILED", 60), "later": ("PENDING", 100)}
    counts = {r["manifest"]: r["count"] for r in got.stored.groupBy("manifest").count().collect()}
    assert counts == {"live": 5, "fine": 5, "lost": 5, "changed": 5, "extra": 6, "source": 4, "later": 5}
    again = maintenance.maintained(tasks.filter("task = 'lost'"), manifests, records, got.stored, spark.createDataFrame([], "manifest string"), "p", now())
    assert [r["outcome"] for r in again.outcomes.collect()] == ["HEALTHY"]


def test_tries_again_later_and_later(spark):
    tasks = spark.createDataFrame([(str(a), a, "RUNNING") for a in (0, 1, 2, 7, 9)] + [("ok", 3, "RUNNING")], "task string, attempts int, status string").withColumn("available_at", now())
    got = maintenance.failed(tasks, tasks.filter("task <> 'ok'").select("task"), now(), 10)
    assert {r["task"]: (r["attempts"], r["status"], r["d"]) for r in got.withColumn("d", F.unix_seconds("available_at") - F.unix_seconds(now())).collect()} == {
        "0": (1, "WAITING", 30), "1": (2, "WAITING", 60), "2": (3, "WAITING", 120), "7": (8, "WAITING", 3600), "9": (10, "FAILED", 3600), "ok": (3, "RUNNING", 0)}
