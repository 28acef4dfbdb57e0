"""Rollouts of new embedding profiles over state tables: evaluation, canary or full publication, promotion and way back.

A request names a space, its candidate and the manifest that was stable when the candidate was built; a space has one open request
at a time. Every step takes the state and returns the next one; a step that finds another head than the request's stable manifest
changes nothing but the request, which is in conflict.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.publication import updated


class State(NamedTuple):
    requests: DataFrame  # request, space, candidate, previous, mode (FULL or CANARY), percent, status, code
    manifests: DataFrame  # manifest, space, version, status and more
    heads: DataFrame  # space, manifest, version, optimistic_version
    canaries: DataFrame  # space, stable, candidate, percent, salt


class Step(NamedTuple):
    state: State
    tasks: DataFrame  # task_type, manifest, available_at: what is due newly
    events: DataFrame  # event_type, key, space, manifest


def evaluated(hits: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """request, cases, passed, recall, ok, facts_sha256: a case passes if one of its hits (request, case_id, found) is what it should find.

    ``truth``: request, case_id, expected; a request has a bounded number of cases. The hash is over its cases in their order.
    """
    keys = ["request", "case_id"]
    found = truth.join(hits, keys, "left").groupBy(*keys, "expected").agg(F.coalesce(F.bool_or(F.col("found") == F.col("expected")), F.lit(False)).alias("hit"))
    fact = F.concat_ws(":", F.col("case_id").cast("string"), F.col("expected").cast("string"), F.col("hit").cast("string"))
    got = found.groupBy("request").agg(F.count(F.lit(1)).alias("cases"), F.count_if("hit").alias("passed"), F.sort_array(F.collect_list(F.struct(F.col("case_id").cast("string").alias("c"), fact.alias("fact")))).alias("facts"))
    rate = F.col("passed") / F.col("cases")
    return got.select("request", "cases", "passed", F.round(rate, 6).alias("recall"), (rate >= least).alias("ok"), F.sha2(F.array_join("facts.fact", "\n"), 256).alias("facts_sha256"))


def _said(rows: DataFrame, *kinds: str) -> DataFrame:
    """An event of each kind for rows with request, space and manifest."""
    return rows.select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("event_type"), F.col("request").alias("key"), "space", "manifest")


def _due(rows: DataFrame, kind: str, at: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("task_type"), "manifest", at.alias("available_at"))


def _moved(state: State, moves: DataFrame, status_of_old: str = "SUPERSEDED") -> tuple[DataFrame, DataFrame]:
    """(manifests, heads) after heads move: ``moves`` has space, manifest (the new head) and old."""
    becomes = moves.select("manifest", F.lit("ACTIVE").alias("status")).unionByName(moves.select(F.col("old").alias("manifest"), F.lit(status_of_old).alias("status")))
    version = moves.join(state.manifests.select("manifest", "version"), "manifest")
    heads = updated(state.heads, version.join(state.heads.select("space", (F.col("optimistic_version") + 1).alias("optimistic_version")), "space"), "space", "manifest", "version", "optimistic_version")
    return updated(state.manifests, becomes, "manifest", "status"), heads


def _activated(state: State, asked: DataFrame, now: Column, retention_days: int, event: str) -> Step:
    """Candidates of some requests (request, space, candidate, previous) become heads, where the head is still the one they were built on."""
    seen = asked.join(state.heads.select("space", F.col("manifest").alias("head")), "space", "left").join(state.manifests.select(F.col("manifest").alias("candidate"), F.col("status").alias("is")), "candidate", "left")
    good = F.coalesce((F.col("head") == F.col("previous")) & (F.col("is") == "VERIFIED"), F.lit(False))
    moves = seen.filter(good).select("request", "space", F.col("candidate").alias("manifest"), F.col("previous").alias("old"))
    manifests, heads = _moved(state, moves)
    result = seen.select("request", F.when(good, "PUBLISHED").otherwise("CONFLICT").alias("status"), F.when(~good, "VERSION_CONFLICT").alias("code"))
    tasks = _due(moves.select(F.col("old").alias("manifest")), "CLEANUP_MANIFEST", now + F.expr(f"INTERVAL {retention_days} DAYS")).unionByName(_due(moves, "RECONCILE_MANIFEST", now + F.expr("INTERVAL 10 MINUTES")))
    canaries = state.canaries.join(moves.select("space"), "space", "left_anti")
    return Step(State(updated(state.requests, result, "request", "status", "code"), manifests, heads, canaries), tasks, _said(moves, event, "cache.invalidate.space"))


def decided(state: State, reports: DataFrame, now: Column, retention_days: int = 7) -> Step:
    """What becomes of evaluated requests (``reports``: request, ok): FULL ones are published, CANARY ones get their canary, failed ones are closed."""
    # Events and codes of the decision.
    judged = state.requests.filter("status = 'EVALUATING'").join(reports.select("request", "ok"), "request")
    full = judged.filter("ok AND mode = 'FULL'").select("request", "space", "candidate", "previous")
    step = _activated(state, full, now, retention_days, "index.profile_rebuild.published")
    bad = judged.filter("NOT ok").select("request", "space", F.col("candidate").alias("manifest"))
    tried = judged.filter("ok AND mode = 'CANARY'")
    result = bad.select("request", F.lit("FAILED").alias("status"), F.lit("OFFLINE_EVALUATION_FAILED").alias("code")).unionByName(tried.select("request", F.lit("READY").alias("status"), F.lit(None).cast("string").alias("code")))
    closed = bad.join(state.manifests.filter("status = 'VERIFIED'").select("manifest"), "manifest", "left_semi").select("manifest", F.lit("FAILED").alias("status"))
    # a new canary has a salt of its own, so that other users try it
    rows = tried.select("space", F.col("previous").alias("stable"), "candidate", "percent", F.sha2(F.concat_ws(":", F.lit("canary"), F.col("request").cast("string")), 256).alias("salt"))
    canaries = step.state.canaries.join(rows.select("space"), "space", "left_anti").unionByName(rows)
    after = State(updated(step.state.requests, result, "request", "status", "code"), updated(step.state.manifests, closed, "manifest", "status"), step.state.heads, canaries)
    said = _said(bad, "index.profile_evaluation.failed").unionByName(_said(tried.select("request", "space", F.col("candidate").alias("manifest")), "index.profile_canary.ready", "cache.invalidate.space"))
    return Step(after, step.tasks.unionByName(_due(bad, "CLEANUP_MANIFEST", now)), step.events.unionByName(said))


def promoted(state: State, asked: DataFrame, now: Column, retention_days: int = 7) -> Step:
    """Canaries of some requests (request) become the heads of their spaces."""
    ready = state.requests.filter("status = 'READY'").join(asked.select("request"), "request", "left_semi").select("request", "space", "candidate", "previous")
    return _activated(state, ready, now, retention_days, "index.profile_canary.promoted")


def taken_back(state: State, asked: DataFrame) -> Step:
    """Requests (request) that are undone: a canary is revoked, a published candidate gives way to the manifest before it if that is still there."""
    mine = state.requests.join(asked.select("request"), "request", "left_semi")
    tried = mine.filter("status = 'READY'").select("request", "space", F.col("candidate").alias("manifest"))
    live = mine.filter("status = 'PUBLISHED'").join(state.heads.select("space", F.col("manifest").alias("head")), "space", "left")
    live = live.join(state.manifests.select(F.col("manifest").alias("previous"), F.col("status").alias("was")), "previous", "left")
    good = F.coalesce((F.col("head") == F.col("candidate")) & (F.col("was") == "SUPERSEDED"), F.lit(False))
    moves = live.filter(good).select("request", "space", F.col("previous").alias("manifest"), F.col("candidate").alias("old"))
    manifests, heads = _moved(state, moves)
    revoked = tried.join(manifests.filter("status = 'VERIFIED'").select("manifest"), "manifest", "left_semi").select("manifest", F.lit("REVOKED").alias("status"))
    result = tried.select("request", F.lit("ROLLED_BACK").alias("status"), F.lit(None).cast("string").alias("code")).unionByName(live.select("request", F.when(good, "ROLLED_BACK").otherwise(F.col("status")).alias("status"), F.when(~good, "VERSION_CONFLICT").alias("code")))
    canaries = state.canaries.join(tried.select("space"), "space", "left_anti")
    after = State(updated(state.requests, result, "request", "status", "code"), updated(manifests, revoked, "manifest", "status"), heads, canaries)
    none = _due(tried.limit(0), "CLEANUP_MANIFEST", F.lit(None).cast("timestamp"))
    return Step(after, none, _said(tried.unionByName(moves.select("request", "space", "manifest")), "index.profile_rebuild.rolled_back", "cache.invalidate.space"))
