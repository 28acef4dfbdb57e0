"""Manifests, jobs and uploads: multi-way joins, anti-joins and state changes, on state tables that stand on the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import vectors
from pagewright.operators import index, lifecycle, maintenance, ocr, publication, rollout
from pagewright.plans.registry import query
from pagewright.shared import new_path, table, write_shared
from pagewright.sources import snapshots

NOW = "1995-06-17 00:00:00"
PROFILE = "p1"


def _now():
    return F.lit(NOW).cast("timestamp")


# Documents belong to 25 spaces; orders are jobs on them, lines are runs and chunks, parts are files.
STATE = f"""docs AS (SELECT doc_id AS document_id, doc_id % 25 AS space FROM documents), vers AS (SELECT 'v' || doc_id AS version_id, doc_id AS document_id, 1 + doc_id % 3 AS revision FROM documents),
    spaces AS (SELECT n_nationkey AS space, n_name AS owner FROM nation WHERE n_nationkey % 7 <> 6),
    jobs AS (SELECT o_orderkey AS job_id, o_orderkey % 200 AS document_id, 'v' || (o_orderkey % 200) AS version_id, 1 + o_orderkey % 3 AS revision, CASE o_orderstatus WHEN 'F' THEN 'RUNNING' WHEN 'O' THEN 'QUEUED' ELSE 'WAITING' END AS status,
        (['CHUNK', 'EMBED', 'INDEX'])[o_custkey % 3 + 1] AS current_step, 'w' || (o_custkey % 2) AS lease_owner, o_orderdate + INTERVAL 900 DAY AS lease_expires_at FROM orders),
    runs AS (SELECT l_orderkey || '.' || l_linenumber AS run_id, l_orderkey AS job_id, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CASE WHEN l_returnflag = 'A' THEN 'CLEAN' ELSE 'REJECTED' END AS verdict,
        1 + l_orderkey % 3 AS revision, CASE WHEN l_suppkey % 4 > 0 THEN 'PDF' END AS file_format, l_quantity::INT AS page_count, l_quantity > 25 AS eligible, 'v' || (l_orderkey % 200) AS version_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
    chunks AS (SELECT 'c' || run_id AS chunk_id, version_id, revision, l_linenumber AS ordinal, CASE WHEN l_linenumber % 4 = 0 THEN 'PARENT' ELSE 'CHILD' END AS granularity, eligible, sha256(run_id) AS content_sha256 FROM runs WHERE l_linenumber < 6)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 25).alias("space"))


def _versions(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("v"), k.cast("string")).alias("version_id"), k.alias("document_id"), (1 + k % 3).alias("revision"))


def _spaces(spark, sf_dir):
    return table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 6").select(F.col("n_nationkey").cast("long").alias("space"), F.col("n_name").alias("owner"))


def _jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "RUNNING").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("WAITING")
    step = F.element_at(F.array(F.lit("CHUNK"), F.lit("EMBED"), F.lit("INDEX")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), (k % 200).alias("document_id"), F.concat(F.lit("v"), (k % 200).cast("string")).alias("version_id"), (1 + k % 3).alias("revision"), status.alias("status"),
        step.alias("current_step"), F.concat(F.lit("w"), (F.col("o_custkey") % 2).cast("string")).alias("lease_owner"), (F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("lease_expires_at"),
    )


def _runs(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")
    first = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")).alias("f")).select("l_orderkey", "l_linenumber", "f.*")
    return first.select(
        F.concat_ws(".", k.cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"), k.alias("job_id"), "l_linenumber", F.when(F.col("l_linestatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.when(F.col("l_returnflag") == "A", "CLEAN").otherwise("REJECTED").alias("verdict"), (1 + k % 3).alias("revision"), F.when(F.col("l_suppkey") % 4 > 0, "PDF").alias("file_format"),
        F.col("l_quantity").cast("int").alias("page_count"), (F.col("l_quantity") > 25).alias("eligible"), F.concat(F.lit("v"), (k % 200).cast("string")).alias("version_id"),
    )


def _chunks(spark, sf_dir):
    rows = _runs(spark, sf_dir).filter("l_linenumber < 6")
    kind = F.when(F.col("l_linenumber") % 4 == 0, "PARENT").otherwise("CHILD")
    return rows.select(F.concat(F.lit("c"), "run_id").alias("chunk_id"), "version_id", "revision", F.col("l_linenumber").alias("ordinal"), kind.alias("granularity"), "eligible", F.sha2("run_id", 256).alias("content_sha256"))


@query(f"""WITH {STATE} SELECT j.job_id, j.document_id, j.version_id, j.revision AS job_revision, v.revision AS version_revision, d.space, s.owner, r.run_id AS parse_run, r.revision AS parse_revision, r.file_format, r.page_count
    FROM jobs j JOIN vers v ON v.version_id = j.version_id JOIN docs d ON d.document_id = j.document_id JOIN spaces s ON s.space = d.space JOIN runs r ON r.job_id = j.job_id
    WHERE j.status = 'RUNNING' AND j.current_step = 'CHUNK' AND j.lease_owner = 'w1' AND j.lease_expires_at > TIMESTAMP '{NOW}' AND r.status = 'SUCCEEDED' AND r.verdict = 'CLEAN' AND r.file_format IS NOT NULL""")
def chunk_inputs(spark, sf_dir):
    return publication.chunk_inputs(_jobs(spark, sf_dir), _versions(spark, sf_dir), _docs(spark, sf_dir), _spaces(spark, sf_dir), _runs(spark, sf_dir), "w1", _now())


@query(f"""WITH {STATE} SELECT d.space, j.job_id, j.document_id, j.version_id, j.revision, r.run_id FROM jobs j JOIN docs d ON d.document_id = j.document_id JOIN runs r ON r.job_id = j.job_id
    WHERE j.status = 'RUNNING' AND j.current_step = 'EMBED' AND j.lease_owner = 'w0' AND j.lease_expires_at > TIMESTAMP '{NOW}' AND r.status = 'SUCCEEDED' AND r.eligible""")
def embed_targets(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return publication.embed_targets(_jobs(spark, sf_dir), _docs(spark, sf_dir), runs.select("run_id", "job_id", "status"), runs.select("run_id", "eligible"), "w0", _now())


@query(f"""WITH {STATE} SELECT r.run_id, r.verdict, r.version_id, r.job_id, r.status AS run_status, j.document_id, d.space, v.revision AS version_revision
    FROM runs r JOIN jobs j ON j.job_id = r.job_id JOIN docs d ON d.document_id = j.document_id JOIN vers v ON v.version_id = r.version_id""")
def review_context(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return publication.review_context(runs.select("run_id", "verdict", "version_id"), runs.select("run_id", "job_id", "status"), _jobs(spark, sf_dir), _docs(spark, sf_dir), _versions(spark, sf_dir))


# Every space has up to three manifests; the second is its head, the third a candidate. Some spaces have none.
MANIFESTS = f"""{STATE}, man AS (SELECT space || '-' || v AS manifest, space, v AS version, (['SUPERSEDED', 'ACTIVE', 'VERIFIED'])[v] AS status, CASE WHEN space % 2 = 0 THEN '{PROFILE}' ELSE 'p0' END AS profile FROM spaces, (SELECT unnest([1, 2, 3]) AS v) WHERE space % 5 <> 4 AND (v < 3 OR space % 3 = 0)),
    heads AS (SELECT space, manifest, version, 1 + space % 4 AS optimistic_version FROM man WHERE status = 'ACTIVE'),
    mem AS (SELECT m.manifest, d.document_id, 'v' || d.document_id AS version_id, 1 + d.document_id % 3 AS revision, 1 + (d.document_id + m.version) % 4 AS embedding_revision, 1 + d.document_id % 5 AS vector_count FROM man m JOIN docs d ON d.space = m.space WHERE d.document_id % 4 <> m.version),
    targets AS (SELECT d.space, d.document_id, v.version_id, v.revision FROM docs d JOIN vers v ON v.document_id = d.document_id WHERE d.document_id % 9 = 0 AND d.document_id < 400)"""


def _manifests(spark, sf_dir):
    v = F.col("version")
    rows = _spaces(spark, sf_dir).filter("space % 5 <> 4").select("space", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version")).filter("version < 3 OR space % 3 = 0")
    return rows.select(F.concat_ws("-", F.col("space").cast("string"), v.cast("string")).alias("manifest"), "space", "version", F.element_at(F.array(F.lit("SUPERSEDED"), F.lit("ACTIVE"), F.lit("VERIFIED")), v).alias("status"), F.when(F.col("space") % 2 == 0, PROFILE).otherwise("p0").alias("profile"))


def _heads(manifests):
    return manifests.filter("status = 'ACTIVE'").select("space", "manifest", "version", (1 + F.col("space") % 4).alias("optimistic_version"))


def _members(manifests, docs):
    d = F.col("document_id")
    rows = manifests.select("manifest", "space", "version").join(docs, "space").filter(d % 4 != F.col("version"))
    return rows.select("manifest", "document_id", F.concat(F.lit("v"), d.cast("string")).alias("version_id"), (1 + d % 3).alias("revision"), (1 + (d + F.col("version")) % 4).alias("embedding_revision"), (1 + d % 5).alias("vector_count"))


def _built(spark, sf_dir):
    docs, manifests = _docs(spark, sf_dir), _manifests(spark, sf_dir)
    targets = docs.filter("document_id % 9 = 0 AND document_id < 400").join(_versions(spark, sf_dir), "document_id")
    return publication.build_manifests(targets, manifests, _heads(manifests).select("space", "manifest"), _members(manifests, docs), _chunks(spark, sf_dir), PROFILE)


BUILT = f"""{MANIFESTS}, cnt AS (SELECT version_id, revision, count(*) AS vector_count FROM chunks WHERE granularity = 'CHILD' AND eligible GROUP BY 1, 2),
    want AS (SELECT t.*, c.vector_count FROM targets t JOIN cnt c USING (version_id, revision)),
    new AS (SELECT space, space || '-' || version AS manifest, version FROM (SELECT space, (SELECT coalesce(max(version), 0) + 1 FROM man WHERE man.space = want.space) AS version FROM want GROUP BY space)),
    listed AS (SELECT n.manifest, m.document_id, m.version_id, m.revision, m.embedding_revision + CASE WHEN o.profile = '{PROFILE}' THEN 0 ELSE 1 END AS embedding_revision, m.vector_count
            FROM heads h JOIN man o ON o.manifest = h.manifest JOIN mem m ON m.manifest = h.manifest JOIN new n ON n.space = h.space WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.space = h.space AND w.document_id = m.document_id)
        UNION ALL SELECT n.manifest, w.document_id, w.version_id, w.revision, 1 + coalesce((SELECT max(m.embedding_revision) FROM mem m JOIN man o ON o.manifest = m.manifest WHERE o.space = w.space AND m.document_id = w.document_id), 0), w.vector_count FROM want w JOIN new n ON n.space = w.space)"""


@query(f"WITH {BUILT} SELECT manifest, document_id, version_id, revision, embedding_revision, vector_count FROM listed")
def manifest_members(spark, sf_dir):
    return _built(spark, sf_dir)[1]


@query(f"WITH {BUILT} SELECT n.manifest, n.space, n.version, 'BUILDING' AS status, '{PROFILE}' AS profile, (SELECT sum(vector_count) FROM listed l WHERE l.manifest = n.manifest)::BIGINT AS expected FROM new n")
def new_manifests(spark, sf_dir):
    return _built(spark, sf_dir)[0]


@query(f"WITH {BUILT} SELECT t.space, t.document_id, 'INVALID_STATE' AS code FROM targets t WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.document_id = t.document_id)")
def refused_targets(spark, sf_dir):
    return _built(spark, sf_dir)[2]


@query(f"""WITH {MANIFESTS} SELECT m.manifest, m.document_id, m.version_id, m.revision, d.space, c.chunk_id, c.ordinal, c.content_sha256 FROM mem m JOIN docs d ON d.document_id = m.document_id
    JOIN chunks c ON c.version_id = m.version_id AND c.revision = m.revision WHERE c.granularity = 'CHILD' AND c.eligible""")
def build_input(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return publication.build_input(_members(_manifests(spark, sf_dir), docs), docs, _chunks(spark, sf_dir)).drop("granularity", "eligible")


@query(f"""WITH {MANIFESTS}, refs AS (SELECT m.manifest, c.chunk_id, 'f' || left(c.content_sha256, 3) AS fact_id FROM mem m JOIN chunks c ON c.version_id = m.version_id AND c.revision = m.revision),
    facts AS (SELECT DISTINCT 'f' || left(content_sha256, 3) AS fact_id, '{PROFILE}' AS profile, left(content_sha256, 3) AS content_sha256 FROM chunks WHERE granularity = 'CHILD')
    SELECT r.manifest, r.chunk_id, r.fact_id, n.space, c.version_id, c.ordinal, v.document_id, f.profile, f.content_sha256 FROM refs r JOIN man n ON n.manifest = r.manifest JOIN chunks c ON c.chunk_id = r.chunk_id
    JOIN vers v ON v.version_id = c.version_id JOIN docs d ON d.document_id = v.document_id JOIN facts f ON f.fact_id = r.fact_id""")
def vector_records(spark, sf_dir):
    docs, manifests, chunks = _docs(spark, sf_dir), _manifests(spark, sf_dir), _chunks(spark, sf_dir)
    name = F.left("content_sha256", F.lit(3))
    refs = _members(manifests, docs).select("manifest", "version_id", "revision").join(chunks, ["version_id", "revision"]).select("manifest", "chunk_id", F.concat(F.lit("f"), name).alias("fact_id"))
    facts = chunks.filter("granularity = 'CHILD'").select(F.concat(F.lit("f"), name).alias("fact_id"), F.lit(PROFILE).alias("profile"), name.alias("content_sha256")).distinct()
    return publication.vector_records(refs, manifests, chunks, _versions(spark, sf_dir), docs, facts)


PUBLISHED = f"""{MANIFESTS}, rdy AS (SELECT m.space, m.manifest AS new, m.version AS new_version, h.manifest AS old, h.optimistic_version FROM man m LEFT JOIN heads h ON h.space = m.space WHERE m.status = 'VERIFIED' AND m.space % 4 <> 3)"""


def _published(spark, sf_dir):
    manifests = _manifests(spark, sf_dir)
    runs = manifests.filter("status = 'VERIFIED'").select(F.concat(F.lit("r"), "manifest").alias("run"), "space", "manifest", F.when(F.col("space") % 4 != 3, "VERIFIED").otherwise("BUILDING").alias("status"))
    tasks = manifests.filter("space % 5 = 2").select(F.lit("CLEANUP_MANIFEST").alias("task_type"), "manifest")
    return publication.publish(manifests, _heads(manifests), runs, _now(), 7, tasks)


@query(f"""WITH {PUBLISHED} SELECT m.manifest, m.space, m.version, m.profile, CASE WHEN m.manifest IN (SELECT new FROM rdy) THEN 'ACTIVE' WHEN m.manifest IN (SELECT old FROM rdy) AND m.status = 'ACTIVE' THEN 'SUPERSEDED' ELSE m.status END AS status FROM man m""")
def published_manifests(spark, sf_dir):
    return _published(spark, sf_dir).manifests


@query(f"""WITH {PUBLISHED} SELECT space, manifest, version, optimistic_version FROM heads WHERE space NOT IN (SELECT space FROM rdy) UNION ALL SELECT space, new, new_version, coalesce(optimistic_version, 0) + 1 FROM rdy""")
def published_heads(spark, sf_dir):
    return _published(spark, sf_dir).heads


@query(f"""WITH {PUBLISHED} SELECT 'CLEANUP_MANIFEST' AS task_type, old AS manifest, '1995-06-24 00:00:00' AS available_at FROM rdy WHERE old IS NOT NULL AND space % 5 <> 2 UNION ALL SELECT 'RECONCILE_MANIFEST', new, '1995-06-17 00:10:00' FROM rdy""")
def maintenance_tasks(spark, sf_dir):
    """The tasks that a publication makes; where the old manifest's cleanup is planned already there is no second one."""
    return _published(spark, sf_dir).tasks.withColumn("available_at", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {PUBLISHED} SELECT unnest(['ingestion.m05_published', 'index.manifest.published', 'index.document.membership.changed', 'cache.invalidate.space']) AS event_type, 'r' || new AS key, space, new AS manifest, new_version AS version, old AS previous FROM rdy""")
def publication_events(spark, sf_dir):
    return _published(spark, sf_dir).events


# Runs of some spaces fail while they are built; each has the job of its manifest.
_FAILED = f"""{MANIFESTS}, mr AS (SELECT 'r' || manifest AS run, 'j' || manifest AS job_id, manifest, CASE WHEN status = 'VERIFIED' THEN 'VERIFIED' ELSE 'PUBLISHED' END AS status, space % 6 = 0 AS fails FROM man),
    bad AS (SELECT * FROM mr WHERE fails AND status <> 'PUBLISHED')"""


def _failures(spark, sf_dir):
    manifests = _manifests(spark, sf_dir)
    name = lambda c: F.concat(F.lit(c), "manifest")
    runs = manifests.select(name("r").alias("run"), name("j").alias("job_id"), "manifest", F.when(F.col("status") == "VERIFIED", "VERIFIED").otherwise("PUBLISHED").alias("status"))
    jobs = manifests.select(name("j").alias("job_id"), F.lit("RUNNING").alias("status"), F.lit("w1").alias("lease_owner"))
    return publication.failed(manifests, runs, jobs, manifests.filter("space % 6 = 0").select(name("r").alias("run"), F.lit("VECTOR_WRITE_FAILED").alias("code")))


@query(f"""WITH {MANIFESTS} SELECT manifest, space, version, profile, CASE WHEN status IN ('BUILDING', 'VERIFIED') AND space % 6 = 0 THEN 'FAILED' ELSE status END AS status FROM man""")
def failed_manifests(spark, sf_dir):
    return _failures(spark, sf_dir).manifests


@query(f"""WITH {_FAILED} SELECT mr.run, CASE WHEN b.run IS NULL THEN mr.status ELSE 'FAILED' END AS run_status, CASE WHEN b.run IS NULL THEN 'RUNNING' ELSE 'WAITING' END AS job_status, CASE WHEN b.run IS NULL THEN 'w1' END AS lease_owner,
    CASE WHEN b.run IS NOT NULL THEN 'VECTOR_WRITE_FAILED' END AS code FROM mr LEFT JOIN bad b ON b.run = mr.run""")
def failed_runs(spark, sf_dir):
    """Runs after their failure with their jobs and what is said of them."""
    got = _failures(spark, sf_dir)
    jobs = got.jobs.select("job_id", F.col("status").alias("job_status"), "lease_owner")
    return got.runs.join(jobs, "job_id").join(got.events.select(F.col("key").alias("run"), "code"), "run", "left").select("run", F.col("status").alias("run_status"), "job_status", "lease_owner", "code")


# Every space asks twice for another version; some of them are gone.
_ROLLED = f"""{MANIFESTS}, gone AS (SELECT manifest FROM man WHERE space % 4 = 1 AND version = 1), asked AS (SELECT k AS request, n_nationkey AS space, 1 + (n_nationkey + k * (n_nationkey % 3)) % 3 AS version FROM nation, (SELECT unnest([1, 2]) AS k)),
    ok AS (SELECT a.request, a.space, m.manifest, m.version FROM asked a JOIN man m ON m.space = a.space AND m.version = a.version WHERE m.status IN ('SUPERSEDED', 'VERIFIED', 'ACTIVE') AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.manifest = m.manifest)),
    one AS (SELECT h.space, h.manifest AS m0, h.version AS v0, coalesce(o.manifest, h.manifest) AS m1, coalesce(o.version, h.version) AS v1, h.optimistic_version AS o0 FROM heads h LEFT JOIN ok o ON o.space = h.space AND o.request = 1),
    two AS (SELECT one.*, coalesce(o.manifest, m1) AS m2, coalesce(o.version, v1) AS v2 FROM one LEFT JOIN ok o ON o.space = one.space AND o.request = 2)"""


def _rolled_back(spark, sf_dir):
    manifests = _manifests(spark, sf_dir)
    tasks = manifests.select(F.lit("CLEANUP_MANIFEST").alias("task_type"), "manifest", F.when((F.col("space") % 4 == 1) & (F.col("version") == 1), "SUCCEEDED").otherwise("PENDING").alias("status"))
    n, k = F.col("n_nationkey"), F.col("request")
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("request"))
    asked = asked.select("request", n.cast("long").alias("space"), (1 + (n + k * (n % 3)) % 3).cast("int").alias("version"))
    return publication.rollback(manifests, _heads(manifests), tasks, asked)


@query(f"""WITH {_ROLLED} SELECT space, m2 AS manifest, v2 AS version, o0 + (m1 <> m0)::INT + (m2 <> m1)::INT AS optimistic_version FROM two""")
def rolled_back_heads(spark, sf_dir):
    return _rolled_back(spark, sf_dir).heads


@query(f"""WITH {_ROLLED} SELECT m.manifest, m.space, m.version, m.profile, CASE WHEN (m1 <> m0 OR m2 <> m1) AND m.manifest = m2 THEN 'ACTIVE' WHEN (m1 <> m0 AND m.manifest IN (m0, m1) OR m2 <> m1 AND m.manifest IN (m1, m2)) THEN 'SUPERSEDED' ELSE m.status END AS status
    FROM man m LEFT JOIN two ON two.space = m.space""")
def rolled_back_manifests(spark, sf_dir):
    return _rolled_back(spark, sf_dir).manifests


@query(f"""WITH {_ROLLED}, e AS (SELECT ok.*, CASE WHEN ok.request = 1 THEN m0 ELSE CASE WHEN EXISTS (SELECT 1 FROM ok p WHERE p.space = ok.space AND p.request = 1) THEN m1 ELSE m0 END END AS previous FROM ok LEFT JOIN two ON two.space = ok.space)
    SELECT unnest(['index.manifest.rolled_back', 'cache.invalidate.space']) AS event_type, manifest || ':' || request AS key, space, manifest, version, previous FROM e""")
def rollback_events(spark, sf_dir):
    return _rolled_back(spark, sf_dir).events


@query(f"""WITH {_ROLLED} SELECT space, m2 AS manifest, 'STABLE' AS route FROM two""")
def routes_after_rollback(spark, sf_dir):
    """What readers of each space are sent to afterwards: no space may vanish."""
    got = _rolled_back(spark, sf_dir)
    none = got.heads.select("space", F.col("manifest").alias("stable"), F.col("manifest").alias("candidate"), F.lit(1).alias("percent"), F.lit("s").alias("salt")).limit(0)
    return index.routes(got.heads.select("space"), got.heads, got.manifests, none, F.lit("u"))


# Every verified candidate has a request; some were built on another head, some fail, and some canaries are promoted.
_ROLLOUTS = f"""{MANIFESTS}, c AS (SELECT 'q' || m.space AS request, m.space, m.manifest AS candidate, h.manifest AS head, CASE WHEN m.space % 9 = 0 THEN 'gone' ELSE h.manifest END AS previous, m.space % 2 = 0 AS full_, m.space % 5 <> 0 AS ok FROM man m JOIN heads h ON h.space = m.space WHERE m.status = 'VERIFIED'),
    d AS (SELECT *, CASE WHEN NOT ok THEN 'FAILED' WHEN full_ OR space % 4 = 3 THEN CASE WHEN previous = head THEN 'PUBLISHED' ELSE 'CONFLICT' END ELSE 'READY' END AS status FROM c)"""


def _rolled_out(spark, sf_dir):
    manifests = _manifests(spark, sf_dir)
    heads, k = _heads(manifests), F.col("space")
    asked = manifests.filter("status = 'VERIFIED'").select("space", F.col("manifest").alias("candidate")).join(heads.select("space", F.col("manifest").alias("head")), "space")
    asked = asked.select(
        F.concat(F.lit("q"), k.cast("string")).alias("request"), "space", "candidate", F.when(k % 9 == 0, "gone").otherwise(F.col("head")).alias("previous"), F.when(k % 2 == 0, "FULL").otherwise("CANARY").alias("mode"),
        F.lit(20).alias("percent"), F.lit("EVALUATING").alias("status"), F.lit(None).cast("string").alias("code"),
    )
    none = asked.select("space", F.col("previous").alias("stable"), "candidate", "percent", F.lit("").alias("salt")).limit(0)
    step = rollout.decided(rollout.State(asked, manifests, heads, none), asked.select("request", (k % 5 != 0).alias("ok")), _now())
    return rollout.promoted(step.state, asked.filter(k % 4 == 3).select("request"), _now())


@query(f"""WITH {_ROLLOUTS} SELECT request, space, status, CASE status WHEN 'FAILED' THEN 'OFFLINE_EVALUATION_FAILED' WHEN 'CONFLICT' THEN 'VERSION_CONFLICT' END AS code FROM d""")
def rollout_requests(spark, sf_dir):
    return _rolled_out(spark, sf_dir).state.requests.select("request", "space", "status", "code")


@query(f"""WITH {_ROLLOUTS} SELECT m.manifest, m.space, CASE WHEN m.manifest = d.candidate THEN CASE d.status WHEN 'PUBLISHED' THEN 'ACTIVE' WHEN 'FAILED' THEN 'FAILED' ELSE m.status END WHEN m.manifest = d.head AND d.status = 'PUBLISHED' THEN 'SUPERSEDED' ELSE m.status END AS status,
    h.space IS NOT NULL AS is_head FROM man m LEFT JOIN d ON d.space = m.space
    LEFT JOIN (SELECT hd.space, CASE WHEN d.status = 'PUBLISHED' THEN d.candidate ELSE hd.manifest END AS manifest FROM heads hd LEFT JOIN d ON d.space = hd.space) h ON h.manifest = m.manifest""")
def rollout_manifests(spark, sf_dir):
    """Manifests and heads after the decision on all candidates and the promotion of some canaries."""
    state = _rolled_out(spark, sf_dir).state
    heads = state.heads.select("manifest", F.lit(True).alias("is_head"))
    return state.manifests.join(heads, "manifest", "left").select("manifest", "space", "status", F.coalesce("is_head", F.lit(False)).alias("is_head"))


@query(f"""WITH {MANIFESTS} SELECT DISTINCT m.manifest, 'k' || (p.p_partkey % 50) AS object_key, sha256(p.p_type) AS sha256 FROM mem m JOIN part p ON 'v' || (p.p_partkey % 100) = m.version_id""")
def member_files(spark, sf_dir):
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), (k % 100).cast("string")).alias("version_id"), F.concat(F.lit("k"), (k % 50).cast("string")).alias("object_key"), F.sha2("p_type", 256).alias("sha256"))
    return publication.member_files(_members(_manifests(spark, sf_dir), _docs(spark, sf_dir)), files)


@query("SELECT c_custkey AS session, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'OPEN' ELSE 'COMPLETED' END AS status FROM customer")
def upload_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.lit("OPEN").alias("status"))
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("STORED").alias("status"))
    return publication.close_sessions(sessions, files)


@query(f"""WITH {STATE}, due AS (SELECT job_id FROM jobs WHERE status = 'QUEUED' ORDER BY lease_expires_at, job_id LIMIT 100)
    SELECT j.job_id, CASE WHEN d.job_id IS NULL THEN j.status ELSE 'RUNNING' END AS status, CASE WHEN d.job_id IS NULL THEN j.lease_owner ELSE 'w9' END AS lease_owner FROM jobs j LEFT JOIN due d ON d.job_id = j.job_id""")
def claimed_jobs(spark, sf_dir):
    """The first hundred queued jobs go to a worker; the others stay as they are."""
    jobs = _jobs(spark, sf_dir)
    due = jobs.filter("status = 'QUEUED'").orderBy("lease_expires_at", "job_id").limit(100).select("job_id", F.lit("RUNNING").alias("status"), F.lit("w9").alias("lease_owner"))
    return publication.updated(jobs, due, "job_id", "status", "lease_owner").select("job_id", "status", "lease_owner")


@query("SELECT conv_id AS conversation, turn, sha256(text) AS sha256 FROM conversations WHERE conv_id % 7 = 3")
def owned_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), "turn", F.sha2("text", 256).alias("sha256"))
    return publication.owned(rows, rows.select("conversation").distinct().withColumn("owner", F.concat(F.lit("u"), (F.col("conversation") % 7).cast("string"))), "u3")


# ---- lifecycles -------------------------------------------------------------------------------

_COMMAND = "(['start', 'complete', 'cancel', 'fail', 'cancelled', 'expire'])[event_id % 7 % 6 + 1]"


@query(f"""WITH RECURSIVE c AS (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {_COMMAND} AS command FROM events),
    m AS (SELECT * FROM (VALUES ('ACCEPTED', 'RUNNING'), ('ACCEPTED', 'CANCELLING'), ('ACCEPTED', 'FAILED'), ('ACCEPTED', 'EXPIRED'), ('RUNNING', 'CANCELLING'), ('RUNNING', 'COMPLETED'), ('RUNNING', 'FAILED'), ('RUNNING', 'EXPIRED'),
        ('CANCELLING', 'CANCELLED'), ('CANCELLING', 'FAILED'), ('CANCELLING', 'EXPIRED')) t(a, b)),
    t AS (SELECT *, CASE command WHEN 'start' THEN 'RUNNING' WHEN 'complete' THEN 'COMPLETED' WHEN 'fail' THEN 'FAILED' WHEN 'cancel' THEN 'CANCELLING' WHEN 'cancelled' THEN 'CANCELLED' ELSE 'EXPIRED' END AS target FROM c),
    r AS (SELECT run, 0::BIGINT AS k, 0::BIGINT AS event_id, 'ACCEPTED' AS state, false AS applied FROM t WHERE k = 1 UNION ALL
        SELECT t.run, t.k, t.event_id, CASE WHEN (r.state, t.target) IN (SELECT (a, b) FROM m) THEN t.target ELSE r.state END, (r.state, t.target) IN (SELECT (a, b) FROM m) FROM r JOIN t ON t.run = r.run AND t.k = r.k + 1)
    SELECT run, event_id, state, applied FROM r WHERE k > 0""")
def run_lifecycle(spark, sf_dir):
    k = F.col("event_id")
    command = F.element_at(F.array(*[F.lit(c) for c in ("start", "complete", "cancel", "fail", "cancelled", "expire")]), (k % 7 % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", command.alias("command"))
    return lifecycle.run_states(rows, "run", "event_id").drop("command")


_VERSIONS = "v AS (SELECT 'v' || doc_id AS version_id, 1 + doc_id % 3 AS revision, (['PROCESSING', 'SUCCEEDED', 'FAILED', 'WAITING', 'REJECTED', 'CANCELLED'])[doc_id % 6 + 1] AS status, doc_id % 5 = 0 AS asked FROM documents)"


@query(f"WITH {_VERSIONS} SELECT version_id, revision + CASE WHEN again THEN 1 ELSE 0 END AS revision, CASE WHEN again THEN 'QUEUED' ELSE status END AS status FROM (SELECT *, asked AND status NOT IN ('PROCESSING', 'WAITING') AS again FROM v)")
def reprocessed_versions(spark, sf_dir):
    k = F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("PROCESSING", "SUCCEEDED", "FAILED", "WAITING", "REJECTED", "CANCELLED")]), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("v"), k.cast("string")).alias("version_id"), (1 + k % 3).alias("revision"), status.alias("status"), (k % 5 == 0).alias("asked"))
    return lifecycle.reprocess(rows.drop("asked"), rows.filter("asked"))[0]


_GRANTS = """g AS (SELECT s_nationkey AS space, 'USER' AS subject_type, 's' || s_suppkey AS subject_id, [(['READ', 'WRITE', 'REVIEW', 'ADMIN'])[s_suppkey % 4 + 1]] AS permissions, s_suppkey FROM supplier),
    ch AS (SELECT space, subject_type, subject_id, CASE WHEN permissions = ['ADMIN'] OR s_suppkey % 2 = 0 THEN [] ELSE ['READ', 'WRITE'] END AS permissions FROM g WHERE s_suppkey % 3 = 0 AND space % 4 > 0),
    nw AS (SELECT space, subject_type, subject_id, permissions FROM g WHERE (space, subject_id) NOT IN (SELECT (space, subject_id) FROM ch) UNION ALL SELECT * FROM ch WHERE len(permissions) > 0),
    ok AS (SELECT DISTINCT space FROM ch WHERE space IN (SELECT space FROM nw WHERE list_contains(permissions, 'ADMIN')))"""


def _granted(spark, sf_dir):
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(p) for p in ("READ", "WRITE", "REVIEW", "ADMIN")])
    grants = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("space"), F.lit("USER").alias("subject_type"), F.concat(F.lit("s"), k.cast("string")).alias("subject_id"), F.array(F.element_at(kinds, (k % 4 + 1).cast("int"))).alias("permissions"), "s_suppkey")
    less = F.when(F.array_contains("permissions", "ADMIN") | (k % 2 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("READ"), F.lit("WRITE")))
    changes = grants.filter((k % 3 == 0) & (F.col("space") % 4 > 0)).withColumn("permissions", less).drop("s_suppkey")
    spaces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("space"), (1 + F.col("n_nationkey") % 3).alias("policy_version"))
    return lifecycle.apply_grants(spaces, grants.drop("s_suppkey"), changes)


@query(f"WITH {_GRANTS} SELECT space, subject_type, subject_id, array_to_string(permissions, ',') AS permissions FROM nw WHERE space IN (SELECT space FROM ok) UNION ALL SELECT space, subject_type, subject_id, array_to_string(permissions, ',') FROM g WHERE space NOT IN (SELECT space FROM ok)")
def granted_permissions(spark, sf_dir):
    return _granted(spark, sf_dir)[1].withColumn("permissions", F.array_join("permissions", ","))


@query(f"WITH {_GRANTS} SELECT n_nationkey AS space, 1 + n_nationkey % 3 + CASE WHEN n_nationkey IN (SELECT space FROM ok) THEN 1 ELSE 0 END AS policy_version FROM nation")
def policy_versions(spark, sf_dir):
    return _granted(spark, sf_dir)[0]


_INDEXED = f"""{MANIFESTS}, input AS (SELECT m.manifest, c.chunk_id, 'h' || left(c.content_sha256, 2) AS content_sha256 FROM mem m JOIN docs d ON d.document_id = m.document_id JOIN chunks c ON c.version_id = m.version_id AND c.revision = m.revision WHERE c.granularity = 'CHILD' AND c.eligible),
    old AS (SELECT DISTINCT content_sha256 FROM (SELECT 'h' || left(content_sha256, 2) AS content_sha256 FROM chunks) WHERE content_sha256 < 'h8')"""


@query(f"""WITH {_INDEXED} SELECT (SELECT count(*) FROM old) AS known, (SELECT count(DISTINCT content_sha256) FROM input WHERE content_sha256 NOT IN (SELECT content_sha256 FROM old)) AS embedded, (SELECT count(*) FROM input) AS records, 0::BIGINT AS issues,
    (SELECT sum(('0x' || left(sha256(manifest || ':' || chunk_id || ':{PROFILE}'), 10))::BIGINT) FROM input)::BIGINT AS digest""")
def index_build(spark, sf_dir):
    """Chunks to verified vectors: what was known, made, written and wrong, and a digest of the vectors' ids."""
    docs = _docs(spark, sf_dir)
    content = F.concat(F.lit("h"), F.left("content_sha256", F.lit(2)))
    chunks = _chunks(spark, sf_dir).withColumns({"content_sha256": content, "embedding_text": content})
    facts = chunks.filter("content_sha256 < 'h8'").select(F.lit(PROFILE).alias("profile"), "content_sha256").distinct().withColumn("vector", vectors.hashed(F.col("content_sha256"), 16))
    known, expected, records = lifecycle.indexed(_members(_manifests(spark, sf_dir), docs), docs, chunks, facts, PROFILE, lambda t: vectors.hashed(t, 16))
    path = new_path(spark, "vectors")
    snapshots.put_vectors(records.withColumnRenamed("manifest", "manifest_id"), path)
    records = spark.read.parquet(path).withColumn("manifest", F.col("manifest_id").cast("string"))  # what was written, and nothing else, is verified
    issues = lifecycle.verified(expected, records, PROFILE)
    zero = F.lit(0).cast("long")
    number = F.conv(F.left("vector_id", F.lit(10)), 16, 10).cast("long")
    names = ("known", "embedded", "records", "issues", "digest")

    def counted(rows, **what):
        return rows.select(*[what.get(n, zero).alias(n) for n in names])

    one = F.lit(1).cast("long")
    parts = counted(facts, known=one, embedded=-one).unionByName(counted(known, embedded=one)).unionByName(counted(records, records=one, digest=number)).unionByName(counted(issues, issues=one))
    return parts.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])


_VECTOR = f"sha256(manifest || ':' || chunk_id || ':{PROFILE}')"


@query(f"""WITH {_INDEXED}, e AS (SELECT manifest, {_VECTOR} AS id FROM input), p AS (SELECT manifest, id, row_number() OVER (PARTITION BY manifest ORDER BY id) AS i, count(*) OVER (PARTITION BY manifest) AS n FROM e),
    c AS (SELECT manifest, count(*) FILTER (id[1] = '0') AS lost, count(*) FILTER (id[1] = '2') AS extra FROM e GROUP BY 1),
    found AS (SELECT manifest, 'MISSING_PRIMARY_KEY' AS code, id AS vector_id FROM e WHERE id[1] = '0' UNION ALL SELECT manifest, 'UNEXPECTED_PRIMARY_KEY', 'x' || id FROM e WHERE id[1] = '2' UNION ALL SELECT manifest, 'CONTENT_HASH_MISMATCH', id FROM e WHERE id[1] = '1'
        UNION ALL SELECT manifest, 'PROFILE_MISMATCH', id FROM e WHERE id[1] = '3' UNION ALL SELECT manifest, 'COUNT_MISMATCH', NULL FROM c WHERE lost <> extra
        UNION ALL SELECT DISTINCT manifest, 'FIXED_QUERY_MISMATCH', NULL FROM p WHERE id[1] = '0' AND (n <= 3 OR i IN (1, n // 2 + 1, n)))
    SELECT *, code IN ('MISSING_PRIMARY_KEY', 'UNEXPECTED_PRIMARY_KEY', 'CONTENT_HASH_MISMATCH', 'COUNT_MISMATCH') AS repairable FROM found""")
def index_verified(spark, sf_dir):
    """What verification says of a written table that has lost, changed, foreign and additional records."""
    docs = _docs(spark, sf_dir)
    chunks = _chunks(spark, sf_dir).withColumn("content_sha256", F.concat(F.lit("h"), F.left("content_sha256", F.lit(2))))
    chunks = chunks.withColumn("embedding_text", F.col("content_sha256"))
    facts = chunks.limit(0).select(F.lit(PROFILE).alias("profile"), "content_sha256", F.array(F.lit(0.0)).alias("vector"))
    _, expected, records = lifecycle.indexed(_members(_manifests(spark, sf_dir), docs), docs, chunks, facts, PROFILE, lambda t: vectors.hashed(t, 4))
    first = F.left("vector_id", F.lit(1))
    kept = records.filter(first != "0").withColumns({"content_sha256": F.when(first == "1", "other").otherwise(F.col("content_sha256")), "profile": F.when(first == "3", "other").otherwise(F.col("profile"))})
    more = records.filter(first == "2").withColumn("vector_id", F.concat(F.lit("x"), "vector_id"))
    path = new_path(spark, "vectors")
    snapshots.put_vectors(kept.unionByName(more).withColumnRenamed("manifest", "manifest_id"), path)
    return lifecycle.verified(expected, spark.read.parquet(path).withColumn("manifest", F.col("manifest_id").cast("string")), PROFILE)


@query(f"""WITH {_INDEXED}, e AS (SELECT i.manifest, m.space, i.id FROM (SELECT manifest, {_VECTOR} AS id FROM input) i JOIN man m ON m.manifest = i.manifest),
    c AS (SELECT manifest, count(*) FILTER (space % 5 = 0 AND id[1] < '4') AS lost, count(*) FILTER (space % 5 = 1 AND id[1] < '4') AS changed, count(*) FILTER (space % 5 = 2 AND id[1] < '4') AS extra FROM e GROUP BY 1)
    SELECT 'c-' || manifest AS task, CASE WHEN status = 'ACTIVE' THEN 'RETRY' ELSE 'CLEANED' END AS outcome FROM man WHERE version < 3
    UNION ALL SELECT 'r-' || m.manifest, CASE WHEN m.space % 7 = 3 OR changed > 0 OR extra > 0 THEN 'MANUAL' WHEN lost > 0 THEN 'REPAIRED' ELSE 'HEALTHY' END FROM man m LEFT JOIN c ON c.manifest = m.manifest WHERE version > 1""")
def maintenance_outcomes(spark, sf_dir):
    """Cleaning and comparing all manifests of an index that has lost, changed and additional vectors in some spaces, and broken sources in others."""
    docs, manifests = _docs(spark, sf_dir), _manifests(spark, sf_dir)
    chunks = _chunks(spark, sf_dir).withColumn("content_sha256", F.concat(F.lit("h"), F.left("content_sha256", F.lit(2))))
    chunks = chunks.withColumn("embedding_text", F.col("content_sha256"))
    facts = chunks.limit(0).select(F.lit(PROFILE).alias("profile"), "content_sha256", F.array(F.lit(0.0)).alias("vector"))
    records = write_shared(lifecycle.indexed(_members(manifests, docs), docs, chunks, facts, PROFILE, lambda t: vectors.hashed(t, 4)).records, "records")
    placed, hit, k = records.join(manifests.select("manifest", "space"), "manifest"), F.left("vector_id", F.lit(1)) < "4", F.col("space") % 5
    held = placed.filter(~(hit & (k == 0))).withColumn("content_sha256", F.when(hit & (k == 1), "other").otherwise(F.col("content_sha256")))
    held = write_shared(held.unionByName(placed.filter(hit & (k == 2)).withColumn("vector_id", F.concat(F.lit("x"), "vector_id"))).drop("space"), "held")

    def task(letter, kind, which):
        return manifests.filter(which).select(F.concat(F.lit(f"{letter}-"), "manifest").alias("task"), F.lit(kind).alias("task_type"), "manifest", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), _now().alias("available_at"))

    tasks = task("c", "CLEANUP_MANIFEST", "version < 3").unionByName(task("r", "RECONCILE_MANIFEST", "version > 1"))
    return maintenance.maintained(tasks, manifests, records, held, manifests.filter("space % 7 = 3").select("manifest"), PROFILE, _now()).outcomes


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') + (SELECT count(*) FROM events WHERE event_id % 6 = 0) AS waiting, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AS any_running")
def backlog(spark, sf_dir):
    return lifecycle.backlog(_jobs(spark, sf_dir), table(spark, sf_dir, "events").select((F.col("event_id") % 6 != 0).alias("published")))


@query("""SELECT event_id, '{"a":' || (event_id % 3) || CASE WHEN event_id % 2 = 0 THEN ',"b":{"new":[1,2.5,null]}' ELSE ',"b":"old"' END || CASE WHEN event_id % 4 = 0 THEN ',"c":true' ELSE '' END || '}' AS merged FROM events""")
def merged_metrics(spark, sf_dir):
    k = F.col("event_id")
    old = F.concat(F.lit('{"b":"old","a":'), (k % 3).cast("string"), F.lit("}"))
    new = F.when(k % 4 == 0, F.lit('{"c": true, "b": {"new": [1, 2.5, null]}}')).when(k % 2 == 0, F.lit('{"b":{"new":[1,2.5,null]}}'))
    return table(spark, sf_dir, "events").select("event_id", lifecycle.merged(old, new).alias("merged"))


@query(f"""WITH {STATE} SELECT job_id, count(DISTINCT l_linenumber) FILTER (status = 'SUCCEEDED') AS ocr_pages, coalesce(sum(page_count), 0)::BIGINT AS pages, coalesce(sum(page_count) FILTER (eligible), 0)::BIGINT AS eligible_pages FROM runs GROUP BY 1""")
def run_page_sums(spark, sf_dir):
    """Distinct recognised pages and sums of pages per job; where nothing is summed it is 0."""
    rows = _runs(spark, sf_dir)
    pages = ocr.recognised_pages(rows.select("job_id", F.col("l_linenumber").alias("page_no"), F.when(F.col("status") == "SUCCEEDED", "engine").alias("ocr_engine")), "job_id")
    sums = rows.groupBy("job_id").agg(F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("page_count"))), F.lit(0)).alias("eligible_pages"))
    return sums.join(pages, "job_id", "left").select("job_id", F.coalesce("ocr_pages", F.lit(0)).alias("ocr_pages"), "pages", "eligible_pages")
