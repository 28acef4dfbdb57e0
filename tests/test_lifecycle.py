"""Lifecycles and publication on small hand-made tables."""

from pyspark.sql import functions as F

from pagewright.operators import events, lifecycle, publication


def test_runs_follow_their_machine(spark):
    rows = [(1, i, c) for i, c in enumerate(["complete", "start", "start", "cancel", "complete", "cancelled", "fail"])] + [(2, 0, "expire"), (2, 1, "start"), (3, 0, "nonsense")]
    got = sorted(tuple(r) for r in lifecycle.run_states(spark.createDataFrame(rows, "run int, sequence int, command string")).collect())
    assert [(r[3], r[4]) for r in got] == [
        ("ACCEPTED", False), ("RUNNING", True), ("RUNNING", False), ("CANCELLING", True), ("CANCELLING", False), ("CANCELLED", True), ("CANCELLED", False), ("EXPIRED", True), ("EXPIRED", False), ("ACCEPTED", False)]


def test_staying_is_a_repeat_for_some_machines_only(spark):
    rows = spark.createDataFrame([("JOB", "QUEUED", "QUEUED"), ("RUN", "RUNNING", "RUNNING"), ("JOB", "SUCCEEDED", "QUEUED"), ("DOCUMENT", "SUCCEEDED", "QUEUED")], "machine string, from_state string, to_state string")
    assert {tuple(r) for r in events.illegal_transitions(rows).collect()} == {("RUN", "RUNNING", "RUNNING"), ("JOB", "SUCCEEDED", "QUEUED")}
    assert events.terminal("MANIFEST") == ["REVOKED", "FAILED"]


def test_late_runs_take_their_open_steps_with_them(spark):
    runs = spark.createDataFrame([(1, "RUNNING", 5), (2, "COMPLETED", 5), (3, "ACCEPTED", 50)], "run int, status string, deadline_at int")
    steps = spark.createDataFrame([(1, "a", "RUNNING"), (1, "b", "SUCCEEDED"), (2, "a", "RUNNING"), (9, "a", "QUEUED")], "run int, step string, status string")
    after, late, said = events.expire_deadlines(runs, steps, F.lit(10))
    assert {r["run"]: r["new_status"] for r in after.collect()} == {1: "EXPIRED", 2: "COMPLETED", 3: "ACCEPTED"}
    assert {(r["run"], r["step"]): r["new_status"] for r in late.collect()} == {(1, "a"): "CANCELLED", (1, "b"): "SUCCEEDED", (2, "a"): "RUNNING", (9, "a"): "QUEUED"}
    assert [tuple(r) for r in said.collect()] == [(1, "run.expired")]


def test_a_space_keeps_an_administrator(spark):
    spaces = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "space long, policy_version int")
    grants = spark.createDataFrame([(1, "USER", "a", ["ADMIN"]), (2, "USER", "a", ["ADMIN"]), (2, "USER", "b", ["READ"])], "space long, subject_type string, subject_id string, permissions array<string>")
    changes = spark.createDataFrame([(1, "USER", "a", []), (2, "USER", "a", ["WRITE"]), (2, "USER", "b", ["ADMIN"])], grants.schema)
    after, kept, said = lifecycle.apply_grants(spaces, grants, changes)
    assert {r["space"]: r["policy_version"] for r in after.collect()} == {1: 1, 2: 2, 3: 1} and [r["space"] for r in said.collect()] == [2]
    assert {(r["space"], r["subject_id"]): r["permissions"] for r in kept.collect()} == {(1, "a"): ["ADMIN"], (2, "a"): ["WRITE"], (2, "b"): ["ADMIN"]}


def manifests(spark):
    return spark.createDataFrame([("m1", 1, 1, "SUPERSEDED", "p"), ("m2", 1, 2, "ACTIVE", "q"), ("m3", 1, 3, "VERIFIED", "p"), ("n1", 2, 1, "VERIFIED", "p")], "manifest string, space long, version int, status string, profile string")


def heads(spark):
    return spark.createDataFrame([(1, "m2", 2, 7)], "space long, manifest string, version int, optimistic_version int")


def test_publication_moves_everything_at_once(spark):
    runs = spark.createDataFrame([("r3", 1, "m3", "VERIFIED"), ("rn", 2, "n1", "VERIFIED"), ("r9", 1, "m1", "FAILED")], "run string, space long, manifest string, status string")
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    got = publication.publish(manifests(spark), heads(spark), runs, now, 7)
    assert {r["manifest"]: r["status"] for r in got.manifests.collect()} == {"m1": "SUPERSEDED", "m2": "SUPERSEDED", "m3": "ACTIVE", "n1": "ACTIVE"}
    assert {tuple(r) for r in got.heads.collect()} == {(1, "m3", 3, 8), (2, "n1", 1, 1)}
    assert {(r["task_type"], r["manifest"]) for r in got.tasks.collect()} == {("CLEANUP_MANIFEST", "m2"), ("RECONCILE_MANIFEST", "m3"), ("RECONCILE_MANIFEST", "n1")}
    assert {r["run"]: r["status"] for r in got.runs.collect()} == {"r3": "PUBLISHED", "rn": "PUBLISHED", "r9": "FAILED"}
    assert got.events.filter("manifest = 'm3' AND previous = 'm2'").count() == 4 and got.events.filter("manifest = 'n1' AND previous IS NULL").count() == 4
    again = publication.publish(got.manifests, got.heads, got.runs, now, 7, got.tasks)  # nothing is left to publish
    assert again.events.isEmpty() and again.tasks.isEmpty() and sorted(again.heads.collect()) == sorted(got.heads.collect())


def test_two_runs_of_a_space_are_published_in_order(spark):
    more = manifests(spark).unionByName(spark.createDataFrame([("m4", 1, 4, "VERIFIED", "p")], manifests(spark).schema))
    runs = spark.createDataFrame([("r4", 1, "m4", "VERIFIED"), ("r3", 1, "m3", "VERIFIED")], "run string, space long, manifest string, status string")
    there = spark.createDataFrame([("CLEANUP_MANIFEST", "m2")], "task_type string, manifest string")
    got = publication.publish(more, heads(spark), runs, F.current_timestamp(), 7, there)
    assert {r["manifest"]: r["status"] for r in got.manifests.collect()} == {"m1": "SUPERSEDED", "m2": "SUPERSEDED", "m3": "SUPERSEDED", "m4": "ACTIVE", "n1": "VERIFIED"}
    assert [tuple(r) for r in got.heads.collect()] == [(1, "m4", 4, 9)]
    assert {(r["task_type"], r["manifest"]) for r in got.tasks.collect()} == {("CLEANUP_MANIFEST", "m3"), ("RECONCILE_MANIFEST", "m3"), ("RECONCILE_MANIFEST", "m4")}
    assert {(r["manifest"], r["previous"]) for r in got.events.collect()} == {("m3", "m2"), ("m4", "m3")}


def test_failures_close_what_was_being_built(spark):
    runs = spark.createDataFrame([("r3", "j3", "m3", "VERIFIED"), ("r2", "j2", "m2", "PUBLISHED"), ("rn", "jn", "n1", "BUILDING")], "run string, job_id string, manifest string, status string")
    jobs = spark.createDataFrame([("j3", "RUNNING", "w"), ("j2", "SUCCEEDED", None), ("jn", "RUNNING", "w")], "job_id string, status string, lease_owner string")
    got = publication.failed(manifests(spark), runs, jobs, spark.createDataFrame([("r3", "X"), ("r2", "X")], "run string, code string"))
    assert {r["manifest"]: r["status"] for r in got.manifests.collect()} == {"m1": "SUPERSEDED", "m2": "ACTIVE", "m3": "FAILED", "n1": "VERIFIED"}
    assert {r["run"]: r["status"] for r in got.runs.collect()} == {"r3": "FAILED", "r2": "PUBLISHED", "rn": "BUILDING"}
    assert {tuple(r) for r in got.jobs.collect()} == {("j3", "WAITING", None), ("j2", "SUCCEEDED", None), ("jn", "RUNNING", "w")}
    assert [tuple(r) for r in got.events.collect()] == [("ingestion.m05_failed", "r3", "X")]


def test_rollback_keeps_readers_where_they_can_read(spark):
    from pagewright.operators import index

    done = spark.createDataFrame([("CLEANUP_MANIFEST", "m1", "SUCCEEDED")], "task_type string, manifest string, status string")
    none = spark.createDataFrame([], "space long, stable string, candidate string, percent int, salt string")

    def ask(*rows):
        return spark.createDataFrame(rows, "request string, space long, version int")

    def seen(got):
        return [(r["space"], r["manifest"]) for r in index.routes(got.heads.select("space"), got.heads, got.manifests, none, F.lit("u")).collect()]

    got = publication.rollback(manifests(spark), heads(spark), done, ask(("a", 1, 1), ("b", 9, 1)))
    assert [tuple(r) for r in got.heads.collect()] == [(1, "m2", 2, 7)] and {r["request"] for r in got.refused.collect()} == {"a", "b"} and got.events.isEmpty() and seen(got) == [(1, "m2")]
    got = publication.rollback(manifests(spark), heads(spark), done.limit(0), ask(("a", 1, 1)))
    assert [tuple(r) for r in got.heads.collect()] == [(1, "m1", 1, 8)] and got.refused.isEmpty() and seen(got) == [(1, "m1")]
    assert {r["manifest"]: r["status"] for r in got.manifests.collect()} == {"m1": "ACTIVE", "m2": "SUPERSEDED", "m3": "VERIFIED", "n1": "VERIFIED"}
    assert {tuple(r) for r in got.events.collect()} == {(e, "m1:a", 1, "m1", 1, "m2") for e in ("index.manifest.rolled_back", "cache.invalidate.space")}
    # two requests of one space leave one head; one for the head itself is only answered; a space without a head stays without
    got = publication.rollback(manifests(spark), heads(spark), done.limit(0), ask(("a", 1, 1), ("b", 1, 3), ("c", 1, 3), ("d", 2, 1)))
    assert [tuple(r) for r in got.heads.collect()] == [(1, "m3", 3, 9)] and seen(got) == [(1, "m3")]
    assert {r["manifest"]: r["status"] for r in got.manifests.collect()} == {"m1": "SUPERSEDED", "m2": "SUPERSEDED", "m3": "ACTIVE", "n1": "VERIFIED"}
    assert {(r["key"], r["previous"]) for r in got.events.collect()} == {("m1:a", "m2"), ("m3:b", "m1"), ("m3:c", "m3"), ("n1:d", None)}


def test_canaries_hold_for_their_head_and_a_verified_candidate(spark):
    from pagewright.operators import index

    users = spark.createDataFrame([(1, 5, f"employee-{i}") for i in range(100)], "space long, policy_version int, user string")

    def routed(stable, candidate):
        tried = spark.createDataFrame([(1, stable, candidate, 20, "salt")], "space long, stable string, candidate string, percent int, salt string")
        rows = index.routes(users, heads(spark), manifests(spark), tried, F.col("user")).collect()
        assert len(rows) == 100 and {r["policy_version"] for r in rows} == {5}
        return {(r["manifest"], r["route"]) for r in rows}

    assert routed("m2", "m3") == {("m2", "STABLE"), ("m3", "CANARY")}
    assert routed("m1", "m3") == routed("m2", "m1") == {("m2", "STABLE")}


def test_new_manifests_take_members_over(spark):
    members = spark.createDataFrame([("m2", 10, "v10", 1, 4, 2), ("m2", 11, "v11", 1, 1, 3), ("m1", 11, "v11", 1, 6, 3)], "manifest string, document_id long, version_id string, revision int, embedding_revision int, vector_count long")
    targets = spark.createDataFrame([(1, 11, "v11", 2), (1, 12, "v12", 1), (3, 13, "v13", 1)], "space long, document_id long, version_id string, revision int")
    chunks = spark.createDataFrame([("v11", 2, "CHILD", True)] * 2 + [("v11", 2, "PARENT", True), ("v12", 1, "CHILD", False), ("v13", 1, "CHILD", True)], "version_id string, revision int, granularity string, eligible boolean")
    new, listed, refused = publication.build_manifests(targets, manifests(spark), heads(spark).select("space", "manifest"), members, chunks, "p")
    assert {tuple(r) for r in new.collect()} == {("1-4", 1, 4, "BUILDING", "p", 4), ("3-1", 3, 1, "BUILDING", "p", 1)}
    # document 10 came with another profile; document 11 goes on from the highest revision it ever had
    assert {(r["manifest"], r["document_id"], r["embedding_revision"], r["vector_count"]) for r in listed.collect()} == {("1-4", 10, 5, 2), ("1-4", 11, 7, 2), ("3-1", 13, 1, 1)}
    assert [tuple(r) for r in refused.collect()] == [(1, 12, "INVALID_STATE")]


def test_an_index_is_built_once_per_content(spark):
    members = spark.createDataFrame([("m", 1, "v", 1)], "manifest string, document_id long, version_id string, revision int")
    docs = spark.createDataFrame([(1, 1)], "document_id long, space long")
    chunks = spark.createDataFrame([(f"c{i}", "v", 1, i, "CHILD", True, "abb"[i], "abb"[i]) for i in range(3)] + [("p", "v", 1, 9, "PARENT", True, "z", "z")], "chunk_id string, version_id string, revision int, ordinal int, granularity string, eligible boolean, content_sha256 string, embedding_text string")
    facts = spark.createDataFrame([("p", "a", [1.0]), ("q", "b", [2.0])], "profile string, content_sha256 string, vector array<double>")
    known, expected, records = lifecycle.indexed(members, docs, chunks, facts, "p", lambda t: F.array(F.lit(9.0)))
    issues = lifecycle.verified(expected, records, "p")
    assert {r["code"] for r in lifecycle.verified(expected, records.limit(2), "p").collect()} == {"MISSING_PRIMARY_KEY", "COUNT_MISMATCH", "FIXED_QUERY_MISMATCH"}
    assert {(r["manifest"], r["code"]) for r in lifecycle.verified(expected, records.withColumn("manifest", F.lit("other")), "p").collect()} > {("m", "MISSING_PRIMARY_KEY"), ("other", "UNEXPECTED_PRIMARY_KEY")}
    assert {(r["content_sha256"], r["vector"][0]) for r in known.collect()} == {("a", 1.0), ("b", 9.0)}
    assert sorted((r["chunk_id"], r["vector"][0]) for r in records.collect()) == [("c0", 1.0), ("c1", 9.0), ("c2", 9.0)] and issues.isEmpty()


def test_json_is_merged_by_name(spark):
    cases = [('{"b":"1","a":"2"}', '{"b":"3"}'), (None, '{"x":"1"}'), ('{"x":"1"}', None), ('{"a":1,"b":{"x":[1,2]},"n":null}', '{"c":true,"a":2.5,"big":9007199254740993}'), ("[1]", '{"a":"é\\""}'), (None, None)]
    df = spark.createDataFrame(cases, "o string, n string")
    got = [r[0] for r in df.select(lifecycle.merged(F.col("o"), F.col("n"))).collect()]
    assert got == ['{"a":"2","b":"3"}', '{"x":"1"}', '{"x":"1"}', '{"a":2.5,"b":{"x":[1,2]},"big":9007199254740993,"c":true,"n":null}', '{"a":"é\\""}', "{}"]


def test_other_columns_pass_as_they_are(spark):
    rows = [(None, i, "start", 2**53 + 1 if i else None) for i in range(2)] + [(1, 0, "start", 2**53 + 1)]
    got = lifecycle.run_states(spark.createDataFrame(rows, "run int, sequence int, command string, big long")).collect()
    assert sorted((r["run"], r["applied"], r["big"]) for r in got if r["run"]) == [(1, True, 2**53 + 1)] and {(r["applied"], r["big"]) for r in got if r["run"] is None} == {(True, None), (False, 2**53 + 1)}
