"""Rollouts on small state tables: every way a request can go."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagewright.operators import index, rollout

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@pytest.fixture
def state(spark):
    names = [("m1", 1, 1, "ACTIVE"), ("c1", 1, 2, "VERIFIED"), ("m2", 2, 1, "ACTIVE"), ("c2", 2, 2, "VERIFIED"), ("m3", 3, 1, "ACTIVE"), ("c3", 3, 2, "VERIFIED"), ("old4", 4, 1, "SUPERSEDED"), ("m4", 4, 2, "ACTIVE"), ("c4", 4, 3, "VERIFIED")]
    requests = [("r1", 1, "c1", "m1", "FULL", None, "EVALUATING", None), ("r2", 2, "c2", "m2", "CANARY", 20, "EVALUATING", None), ("r3", 3, "c3", "m3", "FULL", None, "EVALUATING", None), ("r4", 4, "c4", "old4", "FULL", None, "EVALUATING", None)]
    return rollout.State(
        spark.createDataFrame(requests, "request string, space long, candidate string, previous string, mode string, percent int, status string, code string"),
        spark.createDataFrame(names, "manifest string, space long, version int, status string"),
        spark.createDataFrame([(1, "m1", 1, 5), (2, "m2", 1, 1), (3, "m3", 1, 1), (4, "m4", 2, 9)], "space long, manifest string, version int, optimistic_version int"),
        spark.createDataFrame([], "space long, stable string, candidate string, percent int, salt string"),
    )


def statuses(s):
    return {r["request"]: (r["status"], r["code"]) for r in s.requests.collect()}, {r["manifest"]: r["status"] for r in s.manifests.collect()}, {r["space"]: (r["manifest"], r["optimistic_version"]) for r in s.heads.collect()}


def users(spark):
    return spark.createDataFrame([(2, f"employee-{i}") for i in range(200)], "space long, user string")


def routed(spark, s):
    return {(r["manifest"], r["route"]) for r in index.routes(users(spark), s.heads, s.manifests, s.canaries, F.col("user")).collect()}


def test_the_whole_way(spark, state):
    reports = spark.createDataFrame([("r1", True), ("r2", True), ("r3", False), ("r4", True)], "request string, ok boolean")
    step = rollout.decided(state, reports, now())
    requests, manifests, heads = statuses(step.state)
    assert requests == {"r1": ("PUBLISHED", None), "r2": ("READY", None), "r3": ("FAILED", "OFFLINE_EVALUATION_FAILED"), "r4": ("CONFLICT", "VERSION_CONFLICT")}
    assert manifests == {"m1": "SUPERSEDED", "c1": "ACTIVE", "m2": "ACTIVE", "c2": "VERIFIED", "m3": "ACTIVE", "c3": "FAILED", "old4": "SUPERSEDED", "m4": "ACTIVE", "c4": "VERIFIED"}
    assert heads == {1: ("c1", 6), 2: ("m2", 1), 3: ("m3", 1), 4: ("m4", 9)}
    assert {(r["task_type"], r["manifest"]) for r in step.tasks.collect()} == {("CLEANUP_MANIFEST", "m1"), ("RECONCILE_MANIFEST", "c1"), ("CLEANUP_MANIFEST", "c3")}
    assert {(r["event_type"], r["key"]) for r in step.events.collect()} == {
        ("index.profile_rebuild.published", "r1"), ("cache.invalidate.space", "r1"), ("index.profile_canary.ready", "r2"), ("cache.invalidate.space", "r2"), ("index.profile_evaluation.failed", "r3")}
    assert routed(spark, step.state) == {("m2", "STABLE"), ("c2", "CANARY")}

    up = rollout.promoted(step.state, spark.createDataFrame([("r2",), ("r1",)], "request string"), now())
    requests, manifests, heads = statuses(up.state)
    assert requests["r2"] == ("PUBLISHED", None) and heads[2] == ("c2", 2) and manifests["m2"] == "SUPERSEDED" and up.state.canaries.isEmpty()
    assert routed(spark, up.state) == {("c2", "STABLE")} and {r["key"] for r in up.events.collect()} == {"r2"}

    back = rollout.taken_back(up.state, spark.createDataFrame([("r2",), ("r3",)], "request string"))
    requests, manifests, heads = statuses(back.state)
    assert requests["r2"] == ("ROLLED_BACK", None) and requests["r3"][0] == "FAILED" and heads[2] == ("m2", 3) and (manifests["m2"], manifests["c2"]) == ("ACTIVE", "SUPERSEDED")
    assert routed(spark, back.state) == {("m2", "STABLE")}


def test_canaries_are_revoked_and_conflicts_change_nothing(spark, state):
    step = rollout.decided(state, spark.createDataFrame([("r1", True), ("r2", True)], "request string, ok boolean"), now())
    back = rollout.taken_back(step.state, spark.createDataFrame([("r2",)], "request string"))
    requests, manifests, heads = statuses(back.state)
    assert requests["r2"] == ("ROLLED_BACK", None) and manifests["c2"] == "REVOKED" and heads[2] == ("m2", 1) and back.state.canaries.isEmpty() and routed(spark, back.state) == {("m2", "STABLE")}
    # the head has moved on meanwhile: neither promotion nor the way back may overwrite it
    moved = step.state._replace(heads=step.state.heads.withColumn("manifest", F.lit("other")))
    up = rollout.promoted(moved, spark.createDataFrame([("r2",)], "request string"), now())
    assert statuses(up.state)[0]["r2"] == ("CONFLICT", "VERSION_CONFLICT") and up.events.isEmpty() and {m for m, _ in statuses(up.state)[2].values()} == {"other"}
    back = rollout.taken_back(moved, spark.createDataFrame([("r1",)], "request string"))
    assert statuses(back.state)[0]["r1"] == ("PUBLISHED", "VERSION_CONFLICT") and back.events.isEmpty()


def test_reports_have_a_hash_of_their_cases(spark):
    truth = spark.createDataFrame([("r", "b", 2), ("r", "a", 1), ("r", "c", 3), ("s", "a", 1)], "request string, case_id string, expected int")
    hits = spark.createDataFrame([("r", "a", 9), ("r", "a", 1), ("r", "b", 7)], "request string, case_id string, found int")
    got = {r["request"]: r for r in rollout.evaluated(hits, truth, 1 / 3).collect()}
    assert (got["r"]["cases"], got["r"]["passed"], got["r"]["recall"], got["r"]["ok"]) == (3, 1, 0.333333, True) and not got["s"]["ok"]
    assert got["r"]["facts_sha256"] == hashlib.sha256(b"a:1:true\nb:2:false\nc:3:false").hexdigest()
