"""Maintenance of an index over state tables: cleaning up what is superseded, comparing what is live, mending what is missing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.numbers import task_backoff_seconds
from pagewright.operators import lifecycle
from pagewright.operators.publication import updated


class Maintained(NamedTuple):
    tasks: DataFrame
    stored: DataFrame  # the vectors that the index holds afterwards
    outcomes: DataFrame  # task, outcome: CLEANED, HEALTHY, REPAIRED, RETRY or MANUAL


def maintained(tasks: DataFrame, manifests: DataFrame, records: DataFrame, stored: DataFrame, broken: DataFrame, profile: str, now: Column, interval: int = 86_400) -> Maintained:
    """State after all tasks that are due; ``tasks`` has task, task_type, manifest, status, attempts and available_at.

    ``records``: what manifests should hold, ``stored``: what the index holds, of the same columns (manifest, vector_id,
    content_sha256, profile, ...); ``broken``: manifests with a source file that is gone or another. A manifest that is live again
    isn't cleaned up. Missing vectors are written again if nothing else is wrong; all other differences are for a person. What is
    healthy is looked at again after ``interval`` seconds.
    """
    due = tasks.filter(F.col("status").isin("PENDING", "WAITING") & (F.col("available_at") <= now)).select("task", "task_type", "manifest")
    known = due.join(manifests.select("manifest", F.col("status").alias("is")), "manifest", "left")
    clean = known.filter("task_type = 'CLEANUP_MANIFEST'").select("task", "manifest", F.when(F.col("is") == "ACTIVE", "RETRY").otherwise("CLEANED").alias("outcome"))
    gone = clean.filter("outcome = 'CLEANED'").select("manifest").distinct()
    looked = known.filter("task_type = 'RECONCILE_MANIFEST'").select("task", "manifest")
    mine = looked.select("manifest").distinct()
    wanted = records.join(mine, "manifest", "left_semi")
    issues = lifecycle.verified(wanted.select("manifest", "vector_id", "content_sha256"), stored.join(mine, "manifest", "left_semi"), profile)
    code = F.col("code")
    # a look-up that finds less than it should is no issue of its own while vectors are missing
    told = issues.groupBy("manifest").agg(
        F.count_if(code == "MISSING_PRIMARY_KEY").alias("missing"), F.count_if(~code.isin("MISSING_PRIMARY_KEY", "COUNT_MISMATCH", "FIXED_QUERY_MISMATCH")).alias("unsafe"), F.count(F.lit(1)).alias("n")
    )
    bad = broken.select("manifest").distinct().withColumn("bad", F.lit(True))
    judged = looked.join(told, "manifest", "left").join(bad, "manifest", "left")
    outcome = F.when(F.col("bad"), "MANUAL").when(F.col("n").isNull(), "HEALTHY").when((F.col("unsafe") == 0) & (F.col("missing") > 0), "REPAIRED").otherwise("MANUAL")
    judged = judged.select("task", "manifest", outcome.alias("outcome"))
    again = judged.filter("outcome = 'REPAIRED'").select("manifest").distinct()
    key = ["manifest", "vector_id"]
    written = records.join(again, "manifest", "left_semi").join(stored.select(*key), key, "left_anti").select(*stored.columns)
    after = stored.join(gone, "manifest", "left_anti").unionByName(written)
    outcomes = clean.unionByName(judged).select("task", "outcome")
    done = F.col("outcome")
    status = F.when(done == "CLEANED", "SUCCEEDED").when(done == "MANUAL", "FAILED").otherwise("WAITING")
    later = (now + F.make_dt_interval(secs=F.lit(interval))).alias("available_at")
    return Maintained(updated(tasks, outcomes.select("task", status.alias("status"), later), "task", "status", "available_at"), after, outcomes)


def failed(tasks: DataFrame, errors: DataFrame, now: Column, most: int) -> DataFrame:
    """Tasks after errors (task): each is tried again later and later, and after ``most`` attempts is for a person."""
    attempts = F.col("attempts") + 1
    hit = tasks.join(errors.select("task").distinct(), "task", "left_semi")
    new = hit.select("task", attempts.alias("attempts"), F.when(attempts >= most, "FAILED").otherwise("WAITING").alias("status"), (now + F.make_dt_interval(secs=task_backoff_seconds(attempts))).alias("available_at"))
    return updated(tasks, new, "task", "attempts", "status", "available_at")
