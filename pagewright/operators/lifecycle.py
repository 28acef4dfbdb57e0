"""Lifecycles over tables: runs driven by commands, grants by policy versions, reprocessing, and an index build from chunks to verified vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import ids
from pagewright.operators import access, events, index, publication
from pagewright.shared import write_shared

# The state that each command asks of a run.
COMMANDS = {"start": "RUNNING", "complete": "COMPLETED", "fail": "FAILED", "cancel": "CANCELLING", "cancelled": "CANCELLED", "expire": "EXPIRED"}


def run_states(commands: DataFrame, run: str = "run", order: str = "sequence") -> DataFrame:
    """Add state (after the command) and applied: each run's commands in order, from ACCEPTED on.

    A command that the machine doesn't allow changes nothing. Sorted rows stream through their task, which keeps one run's state;
    all other columns pass as they are.
    """
    allowed = events.RUN_STATES

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, "ACCEPTED", False
        for b in batches:
            states, applied = [], []
            for k, c in zip(b.column(run).to_pylist(), b.column("command").to_pylist(), strict=True):
                if k != key or not begun:
                    key, state, begun = k, "ACCEPTED", True
                to = COMMANDS.get(c)
                ok = to in allowed[state]
                state = to if ok else state
                states.append(state), applied.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.string()), pa.array(applied, pa.bool_())], [*b.schema.names, "state", "applied"])

    schema = T.StructType([*commands.schema.fields, T.StructField("state", T.StringType()), T.StructField("applied", T.BooleanType())])
    return commands.repartition(run).sortWithinPartitions(run, order).mapInArrow(step, schema)


def reprocess(versions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, jobs): ended versions that are asked for (version_id) go back to the queue with the next revision; what was made of the old one stays."""
    asked = requests.select("version_id").distinct().withColumn("asked", F.lit(True))
    again = F.col("asked") & F.array_contains(F.array(*[F.lit(s) for s, to in events.DOCUMENT_STATES.items() if to == ("QUEUED",)]), F.col("status"))
    marked = versions.join(asked, "version_id", "left").withColumn("again", F.coalesce(again, F.lit(False))).drop("asked")
    jobs = marked.filter("again").select("version_id", (F.col("revision") + 1).alias("revision"), F.lit("QUEUED").alias("status"), F.lit("PARSE").alias("current_step"))
    after = marked.withColumns({"revision": F.col("revision") + F.col("again").cast("int"), "status": F.when(F.col("again"), "QUEUED").otherwise(F.col("status"))})
    return after.drop("again"), jobs


def apply_grants(spaces: DataFrame, grants: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spaces, grants, events) after replacing the grants of some subjects; a space whose changes would leave it without an administrator keeps its grants.

    ``spaces``: space, policy_version; ``grants``: space, subject_type, subject_id, permissions; ``changes``: the same, empty
    permissions take a grant away. Each changed space gets the next policy version and an event.
    """
    key = ["space", "subject_type", "subject_id"]
    new = grants.join(changes.select(*key), key, "left_anti").unionByName(changes.filter(F.size("permissions") > 0))
    admins = new.groupBy("space").agg(F.count_if(F.array_contains("permissions", access.ORDER[-1])).alias("admins"))
    touched = changes.select("space").distinct().join(admins, "space", "left").withColumn("ok", F.coalesce("admins", F.lit(0)) > 0).select("space", "ok")
    marked = spaces.join(touched, "space", "left")
    after = marked.select("space", (F.col("policy_version") + F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("policy_version"))
    good = touched.filter("ok").select("space")
    kept = grants.join(good, "space", "left_anti").unionByName(new.join(good, "space", "left_semi"))
    said = after.join(good, "space").select("space", F.lit("space.policy.changed").alias("event_type"), "policy_version")
    return after, kept, said


class Indexed(NamedTuple):
    facts: DataFrame  # profile, content_sha256, vector: those that were known and the new ones
    expected: DataFrame  # manifest, vector_id, content_sha256: what the index should hold
    records: DataFrame  # what is to be written


def indexed(members: DataFrame, documents: DataFrame, chunks: DataFrame, facts: DataFrame, profile: str, embed: Callable[[Column], Column]) -> Indexed:
    """The vectors of manifests' members: reused by content or made once each.

    ``chunks`` also has embedding_text; ``facts``: profile, content_sha256, vector. Nothing is published here: once the records
    are written, ``verified`` on what is read back must find no issue.
    """
    wanted = write_shared(publication.build_input(members, documents, chunks).withColumn("profile", F.lit(profile)), "index-input")
    fresh = index.new_facts(wanted.withColumnRenamed("embedding_text", "text"), facts.select("profile", "content_sha256"))
    known = write_shared(facts.filter(F.col("profile") == profile).unionByName(fresh.select("profile", "content_sha256", embed(F.col("text")).alias("vector"))), "index-facts")
    named = wanted.withColumn("vector_id", ids.vector_id(F.col("manifest"), F.col("chunk_id"), F.col("profile")))
    records = named.join(known, ["profile", "content_sha256"]).select("manifest", "vector_id", "chunk_id", "content_sha256", "profile", "vector")
    return Indexed(known, named.select("manifest", "vector_id", "content_sha256"), records)


def verified(expected: DataFrame, stored: DataFrame, profile: str) -> DataFrame:
    """manifest, code, vector_id, repairable: how the stored records (manifest, vector_id, content_sha256, profile) differ from what is expected.

    Vectors are compared by their keys in both directions; of each manifest the first, middle and last are also looked up.
    """
    wanted, there = index.in_manifests(expected), index.in_manifests(stored)
    probes = index.probe_ids(wanted, ["manifest"], "key").select("manifest", F.col("key").alias("id"))
    found = there.join(probes.select(F.col("id").alias("key")), "key", "left_semi").select("manifest", F.col("key").alias("id"))
    return index.reconcile_manifests(wanted, there, profile, probes, found)


def backlog(jobs: DataFrame, outbox: DataFrame) -> DataFrame:
    """waiting, any_running: what waits in two queues together, and whether anything runs."""
    parts = jobs.select(F.count_if(F.col("status") == "QUEUED").alias("n"), F.coalesce(F.bool_or(F.col("status") == "RUNNING"), F.lit(False)).alias("running"))
    sent = outbox.select(F.count_if(~F.col("published")).alias("n"), F.lit(False).alias("running"))
    return parts.unionByName(sent).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("waiting"), F.bool_or("running").alias("any_running"))


def merged(old: Column, new: Column) -> Column:
    """A JSON object with another's fields put over its own, as text with sorted names; values of any kind stay what they are.

    Null, and anything that isn't an object, counts as empty.
    """
    read = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(read(old), lambda k, _: ~F.map_contains_key(read(new), k))
    both = F.map_concat(kept, read(new))
    names = F.array_sort(F.map_keys(both))
    return F.to_json(F.map_from_arrays(names, F.transform(names, lambda k: both[k])))
