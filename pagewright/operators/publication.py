"""Index manifests as state tables: building, publishing, failing and rolling back, for all spaces of a batch at once.

A manifest lists the documents of a space at one time; a head names the manifest that readers see. State tables are read,
changed rows come back, and the caller writes them with the head last, so that a lost job leaves readers where they were.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_manifests(targets: DataFrame, manifests: DataFrame, heads: DataFrame, members: DataFrame, chunks: DataFrame, profile: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, members, refused): a new manifest for each space with targets.

    ``targets``: space, document_id, version_id, revision; ``manifests``: manifest, space, version, status, profile; ``heads``:
    space, manifest; ``members``: manifest, document_id, version_id, revision, embedding_revision, vector_count; ``chunks``:
    version_id, revision, granularity, eligible. Members of the space's head are taken over, with the next embedding revision if
    their profile was another, but for the targets' documents, which come in anew. A target without a chunk to index is refused.
    """
    counts = chunks.filter((F.col("granularity") == "CHILD") & F.col("eligible")).groupBy("version_id", "revision").agg(F.count(F.lit(1)).alias("vector_count"))
    counted = targets.join(counts, ["version_id", "revision"], "left")
    refused = counted.filter("vector_count IS NULL").select("space", "document_id", F.lit("INVALID_STATE").alias("code"))
    wanted = counted.filter("vector_count IS NOT NULL")
    # new versions and, per document, the next embedding revision over all manifests of its space
    versions = manifests.groupBy("space").agg(F.max("version").alias("last"))
    made = wanted.select("space").distinct().join(versions, "space", "left").select("space", (F.coalesce("last", F.lit(0)) + 1).alias("version"))
    made = made.withColumn("manifest", F.concat_ws("-", F.col("space").cast("string"), F.col("version").cast("string")))
    known = members.join(manifests.select("manifest", "space"), "manifest").join(wanted.select("space", "document_id"), ["space", "document_id"], "left_semi")
    last = known.groupBy("space", "document_id").agg(F.max("embedding_revision").alias("last"))
    fresh = wanted.join(last, ["space", "document_id"], "left").join(made.select("space", "manifest"), "space")
    fresh = fresh.select("manifest", "document_id", "version_id", "revision", (F.coalesce("last", F.lit(0)) + 1).alias("embedding_revision"), "vector_count")
    old = heads.join(manifests.select("manifest", F.col("profile").alias("old_profile")), "manifest").join(members, "manifest").drop("manifest")
    kept = old.join(wanted.select("space", "document_id"), ["space", "document_id"], "left_anti").join(made.select("space", "manifest"), "space")
    kept = kept.select("manifest", "document_id", "version_id", "revision", (F.col("embedding_revision") + F.when(F.col("old_profile") == profile, 0).otherwise(1)).alias("embedding_revision"), "vector_count")
    listed = kept.unionByName(fresh)
    expected = listed.groupBy("manifest").agg(F.sum("vector_count").alias("expected"))
    return made.join(expected, "manifest").select("manifest", "space", "version", F.lit("BUILDING").alias("status"), F.lit(profile).alias("profile"), "expected"), listed, refused


class Published(NamedTuple):
    manifests: DataFrame
    heads: DataFrame
    runs: DataFrame
    tasks: DataFrame  # the new ones
    events: DataFrame  # event_type, key, space, manifest, version, previous


def _said(rows: DataFrame, key: Column, *kinds: str) -> DataFrame:
    """An event of each kind for each row (space, manifest, version, previous)."""
    return rows.select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("event_type"), key.alias("key"), "space", "manifest", "version", "previous")


def publish(manifests: DataFrame, heads: DataFrame, runs: DataFrame, now: Column, retention_days: int, tasks: DataFrame | None = None) -> Published:
    """State after the publication of every verified run; ``runs`` has run, space, manifest, status, ``tasks`` task_type and manifest.

    The runs of a space are published in the order of their manifests' versions: each supersedes the one before it, and the last
    is what readers see. A superseded manifest is cleaned up after its retention, a published one reconciled in ten minutes; a
    task that is there already isn't made again.
    """
    at = Window.partitionBy("space").orderBy("version", "run")
    ready = runs.filter("status = 'VERIFIED'").join(manifests.filter("status = 'VERIFIED'").select("manifest", "version"), "manifest").select("run", "space", "manifest", "version")
    ready = ready.join(heads.select("space", F.col("manifest").alias("head"), "optimistic_version"), "space", "left")
    ready = ready.withColumns({"previous": F.coalesce(F.lag("manifest").over(at), "head"), "last": F.lead("manifest").over(at).isNull()})
    becomes = ready.select("manifest", F.when(F.col("last"), "ACTIVE").otherwise("SUPERSEDED").alias("becomes"))
    old = ready.filter("head IS NOT NULL").select(F.col("head").alias("manifest"), F.lit("SUPERSEDED").alias("becomes")).distinct()
    after = manifests.join(becomes.unionByName(old), "manifest", "left")
    moves = F.col("becomes").isNotNull() & F.col("status").isin("VERIFIED", "ACTIVE")
    after = after.select(*[F.when(moves, F.col("becomes")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in manifests.columns])
    moved = ready.groupBy("space").agg(F.max_by(F.struct("manifest", "version"), "last").alias("to"), F.count(F.lit(1)).alias("n"), F.first("optimistic_version").alias("before"))
    pointers = heads.join(moved.select("space"), "space", "left_anti").select("space", "manifest", "version", "optimistic_version")
    pointers = pointers.unionByName(moved.select("space", "to.manifest", "to.version", (F.coalesce("before", F.lit(0)) + F.col("n")).alias("optimistic_version")))
    cleanup = ready.filter("previous IS NOT NULL").select(F.lit("CLEANUP_MANIFEST").alias("task_type"), F.col("previous").alias("manifest"), (now + F.expr(f"INTERVAL {retention_days} DAYS")).alias("available_at"))
    due = cleanup.unionByName(ready.select(F.lit("RECONCILE_MANIFEST").alias("task_type"), "manifest", (now + F.expr("INTERVAL 10 MINUTES")).alias("available_at")))
    if tasks is not None:
        due = due.join(tasks.select("task_type", "manifest"), ["task_type", "manifest"], "left_anti")
    done = updated(runs, ready.select("run", F.lit("PUBLISHED").alias("status")), "run", "status")
    # What is said of a publication.
    said = _said(ready, F.col("run"), "ingestion.m05_published", "index.manifest.published", "index.document.membership.changed", "cache.invalidate.space")
    return Published(after, pointers, done, due, said)


class Failed(NamedTuple):
    manifests: DataFrame
    runs: DataFrame
    jobs: DataFrame
    events: DataFrame  # event_type, key, code


def failed(manifests: DataFrame, runs: DataFrame, jobs: DataFrame, failures: DataFrame) -> Failed:
    """State after the failure of some runs (run, code): what was being built is closed, its job waits without a lease; heads stay as they are.

    ``runs`` has run, job_id, manifest, status; ``jobs``: job_id, status, lease_owner. A run that is published stays published.
    """
    broken = runs.filter("status <> 'PUBLISHED'").join(failures.groupBy("run").agg(F.min("code").alias("code")), "run", "left_semi").select("run", "job_id", "manifest")
    closed = broken.select("manifest", F.lit(True).alias("broken")).distinct()
    status = F.when(F.col("broken") & F.col("status").isin("BUILDING", "VERIFIED"), "FAILED").otherwise(F.col("status"))
    after = manifests.join(closed, "manifest", "left").withColumn("status", status).drop("broken")
    waiting = broken.select("job_id", F.lit("WAITING").alias("status"), F.lit(None).cast("string").alias("lease_owner")).distinct()
    said = broken.join(failures.groupBy("run").agg(F.min("code").alias("code")), "run").select(F.lit("ingestion.m05_failed").alias("event_type"), F.col("run").alias("key"), "code")
    return Failed(after, updated(runs, broken.select("run", F.lit("FAILED").alias("status")), "run", "status"), updated(jobs, waiting, "job_id", "status", "lease_owner"), said)


class RolledBack(NamedTuple):
    manifests: DataFrame
    heads: DataFrame
    events: DataFrame  # event_type, key, space, manifest, version, previous
    refused: DataFrame  # request, space, version


def rollback(manifests: DataFrame, heads: DataFrame, tasks: DataFrame, requests: DataFrame) -> RolledBack:
    """State after requests (request, space, version), those of a space in the order of their names.

    A manifest can come back as long as its vectors haven't been cleaned up. It becomes active, the one before it superseded, and
    the head's version is counted up; a request for what is the head already changes nothing but is answered like any other.
    """
    gone = tasks.filter("task_type = 'CLEANUP_MANIFEST' AND status = 'SUCCEEDED'").select("manifest")
    whole = manifests.filter(F.col("status").isin("SUPERSEDED", "VERIFIED", "ACTIVE")).join(gone, "manifest", "left_anti").select("space", "version", "manifest")
    asked = requests.select("request", "space", "version").join(whole, ["space", "version"], "left")
    refused = asked.filter("manifest IS NULL").select("request", "space", "version")
    at = Window.partitionBy("space").orderBy("request")
    good = asked.filter("manifest IS NOT NULL").join(heads.select("space", F.col("manifest").alias("head"), "optimistic_version"), "space", "left")
    good = good.withColumns({"previous": F.when(F.col("head").isNotNull(), F.coalesce(F.lag("manifest").over(at), "head")), "last": F.lead("request").over(at).isNull()})
    switches = F.col("head").isNotNull() & (F.col("manifest") != F.col("previous"))
    moved = good.filter("head IS NOT NULL").groupBy("space").agg(F.max_by(F.struct("manifest", "version"), "last").alias("to"), F.count_if(switches).alias("n")).filter("n > 0")
    # what was active on the way is superseded, what is the last is active
    touched = good.filter(switches).select("space", F.explode(F.array("manifest", "previous")).alias("manifest")).distinct().join(moved.select("space", F.col("to.manifest").alias("now")), "space")
    becomes = touched.select("manifest", F.when(F.col("manifest") == F.col("now"), "ACTIVE").otherwise("SUPERSEDED").alias("status"))
    pointers = heads.join(moved, "space", "left").select("space", F.coalesce("to.manifest", "manifest").alias("manifest"), F.coalesce("to.version", "version").alias("version"), (F.col("optimistic_version") + F.coalesce("n", F.lit(0))).alias("optimistic_version"))
    # What is said of a rollback.
    said = _said(good, F.concat_ws(":", "manifest", F.col("request").cast("string")), "index.manifest.rolled_back", "cache.invalidate.space")
    return RolledBack(updated(manifests, becomes, "manifest", "status"), pointers, said, refused)


# ---- what workers read ------------------------------------------------------------------------


def leased(jobs: DataFrame, step: str, worker: str, now: Column) -> DataFrame:
    """Running jobs at a step whose lease this worker holds."""
    return jobs.filter((F.col("status") == "RUNNING") & (F.col("current_step") == step) & (F.col("lease_owner") == worker) & (F.col("lease_expires_at") > now))


def chunk_inputs(jobs: DataFrame, versions: DataFrame, documents: DataFrame, spaces: DataFrame, parses: DataFrame, worker: str, now: Column) -> DataFrame:
    """Jobs that may be chunked, each with its version, space's owner and successful, clean parse."""
    good = parses.filter("status = 'SUCCEEDED' AND verdict = 'CLEAN' AND file_format IS NOT NULL").select("job_id", F.col("run_id").alias("parse_run"), F.col("revision").alias("parse_revision"), "file_format", "page_count")
    mine = leased(jobs, "CHUNK", worker, now).select("job_id", "document_id", "version_id", F.col("revision").alias("job_revision"))
    return mine.join(versions.select("version_id", F.col("revision").alias("version_revision")), "version_id").join(documents.select("document_id", "space"), "document_id").join(spaces.select("space", "owner"), "space").join(good, "job_id")


def embed_targets(jobs: DataFrame, documents: DataFrame, runs: DataFrame, reports: DataFrame, worker: str, now: Column) -> DataFrame:
    """Jobs whose document may be embedded: its processing has succeeded with an eligible report."""
    may = runs.filter("status = 'SUCCEEDED'").join(reports.filter("eligible").select("run_id"), "run_id").select("job_id", "run_id")
    mine = leased(jobs, "EMBED", worker, now).select("job_id", "document_id", "version_id", "revision")
    return mine.join(documents.select("document_id", "space"), "document_id").join(may, "job_id")


def review_context(reports: DataFrame, runs: DataFrame, jobs: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Reports with what a reviewer must know."""
    named = reports.select("run_id", "verdict", "version_id").join(runs.select("run_id", "job_id", F.col("status").alias("run_status")), "run_id")
    return named.join(jobs.select("job_id", "document_id"), "job_id").join(documents.select("document_id", "space"), "document_id").join(versions.select("version_id", F.col("revision").alias("version_revision")), "version_id")


def build_input(members: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of manifests' members that are to be indexed."""
    kept = chunks.filter((F.col("granularity") == "CHILD") & F.col("eligible"))
    return members.select("manifest", "document_id", "version_id", "revision").join(documents.select("document_id", "space"), "document_id").join(kept, ["version_id", "revision"])


def vector_records(refs: DataFrame, manifests: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per vector that a manifest holds: its chunk, document and embedding."""
    rows = refs.join(manifests.select("manifest", "space"), "manifest").join(chunks.select("chunk_id", "version_id", "ordinal"), "chunk_id")
    rows = rows.join(versions.select("version_id", "document_id"), "version_id").join(documents.select("document_id"), "document_id")
    return rows.join(facts.select("fact_id", "profile", "content_sha256"), "fact_id")


def member_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct files behind a manifest's members."""
    return members.select("manifest", "version_id").join(files, "version_id").select("manifest", "object_key", "sha256").distinct()


def close_sessions(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Upload sessions; one without a pending file is complete."""
    open_ = files.filter("status = 'PENDING'").select("session").distinct().withColumn("open", F.lit(True))
    return sessions.join(open_, "session", "left").withColumn("status", F.when(F.col("open").isNull(), "COMPLETED").otherwise(F.col("status"))).drop("open")


def updated(state: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """A state table with some columns taken from the rows of ``changes`` that have its key, one for each."""
    new = changes.select(key, F.struct(*columns).alias("__new"))
    return state.join(new, key, "left").withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}).drop("__new")


def owned(messages: DataFrame, conversations: DataFrame, user: str) -> DataFrame:
    """Messages of the conversations that a user owns."""
    return messages.join(conversations.filter(F.col("owner") == user).select("conversation"), "conversation", "left_semi")
