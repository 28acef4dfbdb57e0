"""Queries on vectors, access, publication, pages of rows and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import ids, numbers, secrecy, text
from pagewright.operators import access, chunking, events, index, ocr, paging, review, sparse
from pagewright.plans.registry import query
from pagewright.plans.texts import sql_pack, sql_words
from pagewright.shared import new_path, table, write_shared
from pagewright.sources import vectors
from pagewright.streaming import relay, sequences, stateful

AS_OF = "1995-06-17 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---- vectors ------------------------------------------------------------------------------

_COS = "list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v)))"
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _rounded(found):
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM e q, e WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def top_k_cosine(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _rounded(index.top_k(rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), rows, 5))


@query(f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM e q JOIN e ON q.label = e.label WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def manifest_top_k(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.filter("vec_id % 20 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return _rounded(index.top_k(asked, rows, 5, "label"))


@query("""SELECT 'm' || label AS manifest_id, 'v' || vec_id AS vector_id, sha256(label || ':' || vec_id % 2) AS content_sha256, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE label % 3 = 1 AND (label % 2 = 0 OR vec_id % 2 = 0)""")
def vector_source(spark, sf_dir):
    """Vectors through the data source: all manifests are written, the odd ones again with fewer rows, and every third is read by a pushed filter."""
    vectors.register(spark)
    path = new_path(spark, "manifest-vectors")
    rows = _vectors(spark, sf_dir).withColumn("n", F.concat_ws(":", "label", (F.col("vec_id") % 2).cast("string")))
    none = {c: F.lit(None).cast("string") for c in ("space_id", "document_id", "chunk_id", "embedding_profile_id")}
    rows = rows.withColumns(none | {"manifest_id": F.concat(F.lit("m"), "label"), "vector_id": F.concat(F.lit("v"), "vec_id"), "ordinal": F.col("vec_id"), "content_sha256": F.sha2("n", 256), "dense_vector": F.col("v"), "sparse_terms": F.lit(None).cast("array<string>"), "sparse_weights": F.lit(None).cast("array<double>")})
    names = [c.split()[0] for c in vectors.SCHEMA.split(", ")]
    rows.select(*names).write.format(vectors.FORMAT).mode("append").save(path)
    rows.filter("label % 2 = 1 AND vec_id % 2 = 0").select(*names).write.format(vectors.FORMAT).mode("append").save(path)
    wanted = [f"m{r['label']}" for r in rows.filter("label % 3 = 1").select("label").distinct().collect()]  # as many as there are labels
    read = spark.read.format(vectors.FORMAT).load(path).filter(F.col("manifest_id").isin(wanted))
    return read.select("manifest_id", "vector_id", "content_sha256", F.round(F.element_at("dense_vector", 1), 6).alias("first"))


@query(rf"""WITH t AS (SELECT doc_id, unnest({sql_words("text")}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS w FROM t GROUP BY 1, 2),
    s AS (SELECT q.doc_id AS query_id, c.doc_id AS id, sum(q.w * c.w)::DOUBLE AS score FROM c q JOIN c ON c.term = q.term WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 5""")
def sparse_top_k(spark, sf_dir):
    """Documents by the words they share, counts times counts; every twentieth is a query."""
    rows = write_shared(sparse.term_counts(table(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text"))), "term-counts")
    return sparse.top_k(rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, 5)


@query(f"""WITH {_E}, s AS (SELECT q.vec_id AS case_id, q.label AS wanted, e.vec_id, e.label, {_COS} AS score FROM e q, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, vec_id) AS rank FROM s),
    h AS (SELECT case_id, max((vec_id <> case_id AND label = wanted)::INT) AS hit FROM r WHERE rank <= 5 GROUP BY 1)
    SELECT count(*) AS cases, sum(hit)::BIGINT AS passed, round(sum(hit) / count(*), 6) AS recall, sum(hit) / count(*) >= 0.9 AS ok FROM h""")
def recall_at_k(spark, sf_dir):
    """Every vector is a case; it passes if another vector of its label is among its hits."""
    rows = _vectors(spark, sf_dir)
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    hits = index.top_k(asked, rows, 5).filter("vec_id <> query_id").join(rows.select("vec_id", "label"), "vec_id").select(F.col("query_id").alias("case_id"), F.col("label").alias("found"))
    return index.recall(hits, rows.select(F.col("vec_id").alias("case_id"), F.col("label").alias("expected")), 0.9)


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN embedding[1:60] WHEN vec_id % 13 = 0 THEN list_transform(embedding, lambda x: x * 1.5) ELSE embedding END::DOUBLE[] AS v, CASE WHEN vec_id % 11 = 0 THEN 'n' ELSE 'm' END AS model, vec_id % 19 = 0 AS bare FROM embeddings)
    SELECT vec_id, CASE WHEN model <> 'm' THEN 'response.model' WHEN len(v) <> 64 THEN 'response.denseDimension' WHEN bare THEN 'response.sparse' WHEN abs(sqrt(list_inner_product(v, v)) - 1) > 0.02 THEN 'response.normalization' END AS issue FROM e""")
def embedding_issues(spark, sf_dir):
    k, v = F.col("vec_id"), F.col("v")
    rows = _vectors(spark, sf_dir).withColumns({
        "v": F.when(k % 17 == 0, F.slice("v", 1, 60)).when(k % 13 == 0, F.transform(v, lambda x: x * 1.5)).otherwise(v),
        "model": F.when(k % 11 == 0, "n").otherwise("m"), "revision": F.lit("1"), "sparse": F.when(k % 19 != 0, F.lit("{}")),
    })
    return index.valid_embeddings(rows, 64, "m", "1", True).select("vec_id", "issue")


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 19 > 0 THEN sha256(vec_id::VARCHAR) END AS want FROM embeddings),
    a AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN sha256('x') ELSE sha256(vec_id::VARCHAR) END AS have, CASE WHEN vec_id % 17 = 0 THEN 'q' WHEN vec_id % 23 > 0 THEN 'p' END AS p FROM embeddings WHERE vec_id % 7 <> 0
          UNION ALL SELECT vec_id + 1000000, sha256('y'), 'q' FROM embeddings WHERE vec_id % 13 = 0),
    i AS (SELECT 'MISSING_PRIMARY_KEY' AS code, vec_id AS vector_id, true AS repairable FROM e WHERE vec_id NOT IN (SELECT vec_id FROM a) UNION ALL SELECT 'UNEXPECTED_PRIMARY_KEY', vec_id, true FROM a WHERE vec_id NOT IN (SELECT vec_id FROM e)
          UNION ALL SELECT 'CONTENT_HASH_MISMATCH', vec_id, true FROM e JOIN a USING (vec_id) WHERE want IS DISTINCT FROM have UNION ALL SELECT 'PROFILE_MISMATCH', vec_id, false FROM e JOIN a USING (vec_id) WHERE p IS DISTINCT FROM 'p'
          UNION ALL SELECT 'COUNT_MISMATCH', NULL, true WHERE (SELECT count(*) FROM e) <> (SELECT count(*) FROM a)
          UNION ALL SELECT 'FIXED_QUERY_MISMATCH', NULL, false WHERE (SELECT list(x ORDER BY x) FROM (SELECT vec_id % 5 AS x FROM e WHERE vec_id < 40)) <> (SELECT list(x ORDER BY x) FROM (SELECT vec_id % 5 AS x FROM e WHERE vec_id < 41)))
    SELECT code, vector_id, repairable FROM i""")
def reconcile(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    k = F.col("vec_id")
    own = F.sha2(k.cast("string"), 256)
    expected = rows.select(k.alias("vector_id"), F.when(k % 19 > 0, own).alias("content_sha256"))
    actual = rows.filter("vec_id % 7 <> 0").select(k.alias("vector_id"), F.when(k % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(own).alias("content_sha256"), F.when(k % 17 == 0, "q").when(k % 23 > 0, "p").alias("profile"))
    more = rows.filter("vec_id % 13 = 0").select((k + 1000000).alias("vector_id"), F.sha2(F.lit("y"), 256).alias("content_sha256"), F.lit("q").alias("profile"))
    probes = lambda most: rows.filter(k < most).select((k % 5).alias("id"))
    return index.reconcile(expected, actual.unionByName(more), "p", probes(40), probes(41))


@query("""WITH i AS (SELECT vec_id % 40 AS manifest, (['MISSING_PRIMARY_KEY', 'UNEXPECTED_PRIMARY_KEY', 'CONTENT_HASH_MISMATCH', 'PROFILE_MISMATCH', 'FIXED_QUERY_MISMATCH', 'COUNT_MISMATCH'])[(vec_id * 7 // 40) % 6 + 1] AS code FROM embeddings WHERE (vec_id // 40) % 4 = vec_id % 3)
    SELECT manifest, CASE WHEN bool_or(code = 'PROFILE_MISMATCH') OR (bool_or(code = 'FIXED_QUERY_MISMATCH') AND NOT bool_or(code = 'MISSING_PRIMARY_KEY')) THEN 'MANUAL' ELSE 'REPAIR' END AS action FROM i GROUP BY 1""")
def repair_plan(spark, sf_dir):
    k = F.col("vec_id")
    codes = F.array(*[F.lit(c) for c in ("MISSING_PRIMARY_KEY", "UNEXPECTED_PRIMARY_KEY", "CONTENT_HASH_MISMATCH", "PROFILE_MISMATCH", "FIXED_QUERY_MISMATCH", "COUNT_MISMATCH")])
    rows = table(spark, sf_dir, "embeddings").filter(F.floor(k / 40) % 4 == k % 3).select((k % 40).alias("manifest"), F.element_at(codes, (F.floor(k * 7 / 40) % 6 + 1).cast("int")).alias("code"))
    return index.repair_plan(rows.withColumn("repairable", ~F.col("code").isin("PROFILE_MISMATCH", "FIXED_QUERY_MISMATCH")), "manifest")


@query("""WITH e AS (SELECT vec_id AS vector_id, sha256(vec_id::VARCHAR) AS content_sha256 FROM embeddings) SELECT vector_id, content_sha256, 'p' AS profile FROM e""")
def repaired_index(spark, sf_dir):
    """An index with missing, changed and unexpected records is what it should be after its repair."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    k = F.col("vec_id")
    expected = rows.select(k.alias("vector_id"), F.sha2(k.cast("string"), 256).alias("content_sha256"), F.lit("p").alias("profile"))
    actual = expected.filter("vector_id % 7 <> 0").withColumn("content_sha256", F.when(F.col("vector_id") % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("content_sha256")))
    actual = actual.unionByName(expected.filter("vector_id % 13 = 0").withColumn("vector_id", F.col("vector_id") + 1000000))
    return index.repaired(actual, expected, index.reconcile(expected, actual, "p"))


@query("""WITH w AS (SELECT lang, sha256(text) AS h FROM documents), f AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0)
    SELECT lang, count(*) AS chunks, count(*) FILTER (f.h IS NOT NULL) AS reused, count(DISTINCT w.h) FILTER (f.h IS NULL) AS embedded FROM w LEFT JOIN f USING (h) GROUP BY lang""")
def embedding_reuse(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.lit("p").alias("profile"), F.sha2("text", 256).alias("content_sha256"))
    facts = wanted.filter("doc_id % 3 = 0").select("profile", "content_sha256")
    found = index.reuse(wanted, facts)
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("reused").alias("reused"), F.count_distinct(F.when(~F.col("reused"), F.col("content_sha256"))).alias("embedded"))


@query(f"""WITH RECURSIVE s AS (SELECT source, doc_id AS o, len({sql_words('text')}) AS s FROM documents), {sql_pack('s', 'source', '16384', 'p', 32)} SELECT source, pack, first, n, size FROM p""")
def embedding_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ordinal"), text.token_count(F.col("text")).alias("tokens"))
    return index.batches(docs, ["source"], 16384, 32)


@query("""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id FROM n WHERE n <= 3 OR i = 1 OR i = n // 2 + 1 OR i = n""")
def fixed_probes(spark, sf_dir):
    return index.probe_ids(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id")


@query("SELECT doc_id, sha256('m1:' || doc_id || ':p1') AS vector_id FROM documents")
def vector_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.vector_id(F.lit("m1"), F.col("doc_id"), F.lit("p1")).alias("vector_id"))


@query("""WITH c AS (SELECT doc_id AS document_id, source, 1 AS revision FROM documents WHERE doc_id % 4 <> 0), r AS (SELECT doc_id AS document_id, source, 2 AS revision FROM documents WHERE doc_id % 6 = 0)
    SELECT * FROM c WHERE document_id NOT IN (SELECT document_id FROM r) UNION ALL SELECT * FROM r""")
def manifest_build(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source")
    return index.next_manifest(docs.filter("document_id % 4 <> 0").withColumn("revision", F.lit(1)), docs.filter("document_id % 6 = 0").withColumn("revision", F.lit(2)))


@query("SELECT o_custkey AS space, (max(o_orderkey) + 1) AS next_version FROM orders GROUP BY 1")
def manifest_version(spark, sf_dir):
    return index.next_version(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("space"), F.col("o_orderkey").alias("version")), "space")


_BUCKET = "('0x' || left(sha256('5f0c1f86-3f0e-4c59-9a5e-0d2a7f4b6c31:' || {0}), 8))::BIGINT % 100"


@query(f"SELECT c_custkey, ({_BUCKET.format('c_custkey')})::INT AS bucket, CASE WHEN {_BUCKET.format('c_custkey')} < 20 THEN 'candidate' ELSE 'stable' END AS route FROM customer")
def canary_route(spark, sf_dir):
    salt = "5f0c1f86-3f0e-4c59-9a5e-0d2a7f4b6c31"
    return table(spark, sf_dir, "customer").select("c_custkey", ids.bucket(salt, F.col("c_custkey")).alias("bucket"), ids.canary(salt, F.col("c_custkey"), 20).alias("route"))


@query("""WITH m AS (SELECT o_orderkey AS manifest, o_custkey % 25 AS space, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'SUPERSEDED' ELSE 'VERIFIED' END AS status FROM orders),
    h AS (SELECT space, max(manifest) AS head FROM m WHERE status = 'ACTIVE' GROUP BY 1),
    c AS (SELECT m.space, CASE WHEN m.space % 5 = 1 THEN head - 1 ELSE head END AS stable, max(manifest) AS candidate, 10 + m.space * 3 AS percent, 'salt' || m.space AS salt FROM m JOIN h ON h.space = m.space WHERE (status = 'VERIFIED' OR m.space % 7 = 2) AND m.space % 3 > 0 GROUP BY ALL),
    u AS (SELECT n_nationkey AS space, 1 + n_nationkey % 4 AS policy_version, 'employee-' || c_custkey AS usr FROM nation JOIN customer ON c_nationkey = n_nationkey),
    r AS (SELECT u.*, h.head, CASE WHEN c.stable = h.head AND m.status = 'VERIFIED' AND ('0x' || left(sha256(c.salt || ':' || usr), 8))::BIGINT % 100 < c.percent THEN c.candidate END AS chosen
        FROM u JOIN h ON h.space = u.space LEFT JOIN c ON c.space = u.space LEFT JOIN m ON m.manifest = c.candidate)
    SELECT space, policy_version, usr AS user, coalesce(chosen, head) AS manifest, CASE WHEN chosen IS NULL THEN 'STABLE' ELSE 'CANARY' END AS route FROM r""")
def publication_routes(spark, sf_dir):
    """Every customer's route in the space of their nation; some canaries stand on a head that has moved on, some on a candidate that isn't verified."""
    status = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "SUPERSEDED").otherwise("VERIFIED")
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("manifest"), (F.col("o_custkey") % 25).alias("space"), status.alias("status"))
    heads = m.filter("status = 'ACTIVE'").groupBy("space").agg(F.max("manifest").alias("manifest"))
    k = F.col("space")
    tried = m.filter(((F.col("status") == "VERIFIED") | (k % 7 == 2)) & (k % 3 > 0)).groupBy("space").agg(F.max("manifest").alias("candidate")).join(heads, "space")
    tried = tried.select("space", F.when(k % 5 == 1, F.col("manifest") - 1).otherwise(F.col("manifest")).alias("stable"), "candidate", (10 + k * 3).alias("percent"), F.concat(F.lit("salt"), k.cast("string")).alias("salt"))
    users = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("space"), F.concat(F.lit("employee-"), F.col("c_custkey").cast("string")).alias("user"))
    spaces = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("space"), (1 + F.col("n_nationkey") % 4).alias("policy_version"))
    return index.routes(users.join(spaces, "space"), heads, m, tried, F.col("user")).select("space", "policy_version", "user", "manifest", "route")


# ---- access ---------------------------------------------------------------------------------

_G = """g AS (SELECT s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'USER' ELSE 'ROLE' END AS subject_type, CASE WHEN s_suppkey % 3 = 0 THEN 'u' || s_suppkey % 5 ELSE 'r' || s_suppkey % 4 END AS subject_id,
    [['READ'], ['WRITE'], ['REVIEW'], ['ADMIN']][s_suppkey % 4 + 1] AS permissions FROM supplier)"""


def _grants(spark, sf_dir):
    k = F.col("s_suppkey")
    kinds = F.array(*[F.array(F.lit(p)) for p in access.ORDER])
    return table(spark, sf_dir, "supplier").select(
        "s_nationkey",
        F.when(k % 3 == 0, "USER").otherwise("ROLE").alias("subject_type"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("r"), (k % 4).cast("string"))).alias("subject_id"),
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("permissions"),
    )


@query(f"""WITH {_G} SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM g WHERE s_nationkey = n_nationkey
    AND (subject_type = 'USER' AND subject_id = 'u1' OR subject_type = 'ROLE' AND subject_id IN ('r2', 'r3')) AND list_has_any(permissions, ['READ', 'ADMIN']))""")
def acl_semi_join(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    grants = _grants(spark, sf_dir).withColumnRenamed("s_nationkey", "n_nationkey")
    return access.visible(rows, grants, "n_nationkey", "u1", ["r2", "r3"], ["READ", "ADMIN"])


@query(f"""WITH {_G}, p AS (SELECT s_nationkey, subject_type, list_distinct(flatten(list(CASE permissions[1] WHEN 'READ' THEN ['READ'] WHEN 'WRITE' THEN ['READ', 'WRITE'] WHEN 'REVIEW' THEN ['READ', 'REVIEW']
        ELSE ['READ', 'WRITE', 'REVIEW', 'ADMIN'] END))) AS p FROM g GROUP BY 1, 2)
    SELECT s_nationkey, subject_type, array_to_string(list_filter(['READ', 'WRITE', 'REVIEW', 'ADMIN'], lambda x: list_contains(p, x)), ',') AS permissions FROM p""")
def permission_union(spark, sf_dir):
    return access.permission_union(_grants(spark, sf_dir), "s_nationkey", "subject_type").withColumn("permissions", F.array_join("permissions", ","))


@query(f"WITH {_G} SELECT s_nationkey, count(*) FILTER (list_contains(permissions, 'ADMIN')) AS admins FROM g GROUP BY 1 HAVING admins < 2")
def admin_counts(spark, sf_dir):
    return access.too_few_admins(_grants(spark, sf_dir), "s_nationkey", least=2)


@query("""WITH a AS (SELECT n_regionkey, list(n_nationkey) AS a FROM nation GROUP BY 1)
    SELECT n_nationkey, array_to_string(list_sort(list_filter(list_distinct([n_nationkey, 3, 7]), lambda x: list_contains(a, x))), ',') AS scope, list_contains(a, 3) AND list_contains(a, n_nationkey) AS allowed FROM nation JOIN a USING (n_regionkey)""")
def requested_spaces(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    both = n.join(n.groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("a")), "n_regionkey")
    asked = F.array("n_nationkey", F.lit(3), F.lit(7))
    return both.select("n_nationkey", F.array_join(F.array_sort(access.in_scope(asked, F.col("a"))), ",").alias("scope"), access.all_allowed(F.array(F.lit(3), F.col("n_nationkey")), F.col("a")).alias("allowed"))


# ---- pages of rows ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_page(spark, sf_dir):
    return paging.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50, ("1998-01-01 00:00:00", 500))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def distinct_on(spark, sf_dir):
    return paging.firsts(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT c_custkey, x.o_orderkey, x.o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) x ON x.o_custkey = c_custkey")
def lateral_latest(spark, sf_dir):
    last = paging.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey", "o_totalprice")
    c = table(spark, sf_dir, "customer")
    return c.join(last, c["c_custkey"] == last["o_custkey"], "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, rtrim(translate(base64(('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}')::BLOB), '+/', '-_'), '=') AS cursor FROM customer""")
def page_cursors(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", paging.cursor("c_custkey", "c_name").alias("cursor"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%r#0000001%'")
def name_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(paging.containing("c_name", "r#0000001")).select("c_custkey", "c_name")


@query("SELECT p_partkey, ceil(p_partkey * 1000000 / 5242880.0)::BIGINT AS parts, CASE WHEN p_partkey * 1000000 > 16777216 THEN 'MULTIPART' ELSE 'SINGLE' END AS strategy FROM part")
def upload_plan(spark, sf_dir):
    size = F.col("p_partkey") * 1000000
    return table(spark, sf_dir, "part").select("p_partkey", numbers.part_count(size, 1 << 20).alias("parts"), numbers.upload_strategy(size, 16 << 20).alias("strategy"))


# ---- event logs ----------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events")
def event_sequence(spark, sf_dir):
    return events.sequenced(_events(spark, sf_dir).select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
    l AS (SELECT user_id, sequence, coalesce(lag(sequence) OVER (PARTITION BY user_id ORDER BY sequence), 0) AS after FROM s WHERE event_id % 7 <> 0)
    SELECT user_id, after, sequence - after - 1 AS missing FROM l WHERE sequence - after > 1""")
def sequence_gaps(spark, sf_dir):
    return events.gaps(event_sequence(spark, sf_dir).filter("event_id % 7 <> 0"), ["user_id"], "sequence")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id + CASE WHEN event_id % 50 = 0 THEN 40 ELSE 0 END, event_id) AS arrival FROM s),
    r AS (SELECT user_id, event_id, sequence, arrival, sequence AS last, 'APPENDED' AS outcome FROM a WHERE arrival = 1
          UNION ALL SELECT a.user_id, a.event_id, a.sequence, a.arrival, CASE WHEN a.sequence = r.last + 1 THEN a.sequence ELSE r.last END,
                 CASE WHEN a.sequence <= r.last THEN 'DUPLICATE' WHEN a.sequence = r.last + 1 THEN 'APPENDED' ELSE 'GAP' END FROM r JOIN a ON a.user_id = r.user_id AND a.arrival = r.arrival + 1)
    SELECT user_id, event_id, sequence, arrival, outcome FROM r""")
def ordered_append(spark, sf_dir):
    rows = event_sequence(spark, sf_dir).withColumn("due", F.col("event_id") + F.when(F.col("event_id") % 50 == 0, 40).otherwise(0))
    arrived = events.sequenced(rows.withColumnRenamed("sequence", "own"), ["user_id"], ["due", "event_id"]).select("user_id", "event_id", F.col("own").alias("sequence"), F.col("sequence").alias("arrival"))
    return events.ordered_append(arrived, "user_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def head_of_line(spark, sf_dir):
    return events.heads_of_line(_events(spark, sf_dir), ["user_id"], "event_id", F.col("event_id") % 3 == 0).select("user_id", "event_id")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def short_window(spark, sf_dir):
    return events.keep_newest(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], [F.desc("turn")], 3)


@query("SELECT user_id, event_type, event_id, copy FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS copy FROM events) WHERE copy > 1")
def outbox_repeats(spark, sf_dir):
    return events.repeats(_events(spark, sf_dir).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 20 = 0) GROUP BY ALL")
def inbox_receipts(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id")
    return events.first_receipts(rows.select("user_id", "event_type"), rows.filter("event_id % 20 = 0").select("user_id", "event_type"), ["user_id", "event_type"])


_JOBS = "j AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'RUNNING' WHEN 'O' THEN 'QUEUED' ELSE 'COMPLETED' END AS status, (o_orderkey % 5)::INT AS attempt, o_orderdate + INTERVAL 30 DAY AS until FROM orders)"


def _jobs(spark, sf_dir, until):
    status = F.when(F.col("o_orderstatus") == "F", "RUNNING").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("COMPLETED")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("attempt"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias(until))


@query(f"""WITH {_JOBS} SELECT o_orderkey, CASE WHEN lost AND attempt >= 3 THEN 'WAITING' WHEN lost THEN 'QUEUED' ELSE status END AS new_status, CASE WHEN lost AND attempt < 3 THEN attempt + 1 ELSE attempt END AS new_attempt
    FROM (SELECT *, status = 'RUNNING' AND until <= TIMESTAMP '{AS_OF}' AS lost FROM j)""")
def lease_expiry(spark, sf_dir):
    return events.expire_leases(_jobs(spark, sf_dir, "lease_expires_at"), _as_of(), 3).select("o_orderkey", "new_status", "new_attempt")


# Orders stand for runs and their lines for steps.
_RUNS = "r AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'RUNNING' WHEN 'O' THEN 'CANCELLING' ELSE 'COMPLETED' END AS status, o_orderdate + INTERVAL 30 DAY AS deadline_at FROM orders)"


def _expired(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "RUNNING").when(F.col("o_orderstatus") == "O", "CANCELLING").otherwise("COMPLETED")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), status.alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("deadline_at"))
    state = F.when(F.col("l_returnflag") == "A", "QUEUED").when(F.col("l_returnflag") == "R", "RUNNING").otherwise("SUCCEEDED")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", state.alias("status"))
    return events.expire_deadlines(runs, steps, _as_of())


@query(f"WITH {_RUNS} SELECT run, CASE WHEN late THEN 'EXPIRED' ELSE status END AS new_status, CASE WHEN late THEN 'RUN_DEADLINE_EXCEEDED' END AS failure_code FROM (SELECT *, status IN ('RUNNING', 'CANCELLING') AND deadline_at <= TIMESTAMP '{AS_OF}' AS late FROM r)")
def deadline_expiry(spark, sf_dir):
    return _expired(spark, sf_dir)[0].select("run", "new_status", "failure_code")


@query(f"""WITH {_RUNS}, s AS (SELECT l_orderkey AS run, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'QUEUED' WHEN 'R' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status FROM lineitem)
    SELECT s.run, s.l_linenumber, CASE WHEN s.status IN ('QUEUED', 'RUNNING') AND r.status IN ('RUNNING', 'CANCELLING') AND r.deadline_at <= TIMESTAMP '{AS_OF}' THEN 'CANCELLED' ELSE s.status END AS new_status FROM s LEFT JOIN r ON r.run = s.run""")
def expired_steps(spark, sf_dir):
    return _expired(spark, sf_dir)[1].select("run", "l_linenumber", "new_status")


@query(f"SELECT o_orderkey, sha256(o_orderpriority) AS content_sha256, CASE WHEN o_orderdate <= TIMESTAMP '{AS_OF}' THEN 'REDACTED' ELSE 'PRESENT' END AS state, CASE WHEN o_orderdate > TIMESTAMP '{AS_OF}' THEN o_orderpriority END AS text FROM orders")
def retention_redact(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("text"), F.col("o_orderdate").alias("expires_at"))
    return events.redact_expired(rows, _as_of()).drop("expires_at")


# Events try a machine's states one after the other; SQL's list of what is allowed is on its own.
_STATES = {m: list(t) for m, (t, _) in events.MACHINES.items()}
_ALLOWED = """a AS (SELECT machine, split_part(x, '>', 1) AS from_state, unnest(string_split(split_part(x, '>', 2), ' ')) AS to_state FROM (SELECT machine, unnest(string_split(moves, ', ')) AS x FROM (VALUES
    ('DOCUMENT', 'UPLOADING>QUEUED CANCELLED REJECTED, QUEUED>PROCESSING CANCELLED REJECTED, PROCESSING>WAITING SUCCEEDED FAILED CANCELLED REJECTED, WAITING>PROCESSING FAILED CANCELLED REJECTED, SUCCEEDED>QUEUED, FAILED>QUEUED, CANCELLED>QUEUED, REJECTED>QUEUED'),
    ('JOB', 'QUEUED>RUNNING CANCELLED REJECTED, RUNNING>WAITING SUCCEEDED FAILED CANCELLED REJECTED, WAITING>QUEUED RUNNING FAILED CANCELLED REJECTED, FAILED>QUEUED'),
    ('MANIFEST', 'BUILDING>VERIFIED FAILED, VERIFIED>ACTIVE FAILED, ACTIVE>SUPERSEDED REVOKED, SUPERSEDED>ACTIVE REVOKED'),
    ('RUN', 'ACCEPTED>RUNNING CANCELLING FAILED EXPIRED, RUNNING>CANCELLING COMPLETED FAILED EXPIRED, CANCELLING>CANCELLED FAILED EXPIRED'), ('RUN_STEP', 'QUEUED>RUNNING CANCELLED SKIPPED, RUNNING>SUCCEEDED FAILED CANCELLED')) t(machine, moves)))"""
_STATE_LISTS = "l AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {s})" for m, s in _STATES.items()) + ") t(machine, states))"


@query(f"""WITH {_ALLOWED}, {_STATE_LISTS}, s AS (SELECT event_id, machine, states[event_id % len(states) + 1] AS from_state, states[event_id // len(states) % len(states) + 1] AS to_state FROM events, l)
    SELECT event_id, machine, from_state, to_state FROM s WHERE (from_state <> to_state OR machine IN ('RUN', 'RUN_STEP')) AND NOT EXISTS (SELECT 1 FROM a WHERE a.machine = s.machine AND a.from_state = s.from_state AND a.to_state = s.to_state)""")
def state_transitions(spark, sf_dir):
    machines = F.array(*[F.struct(F.lit(m).alias("machine"), F.array(*[F.lit(x) for x in s]).alias("s")) for m, s in _STATES.items()])
    rows = _events(spark, sf_dir).select("event_id", F.explode(machines).alias("m")).select("event_id", "m.machine", "m.s")
    n = F.size("s")
    at = lambda i: F.element_at("s", (i % n + 1).cast("int"))
    return events.illegal_transitions(rows.select("event_id", "machine", at(F.col("event_id")).alias("from_state"), at(F.floor(F.col("event_id") / n)).alias("to_state")))


@query("""WITH r AS (SELECT event_id, (['PASS', 'MANUAL_REVIEW', 'REJECT'])[event_id % 3 + 1] AS verdict, (['PENDING', 'NOT_REQUIRED', 'APPROVED', 'REJECTED'])[event_id // 3 % 4 + 1] AS current, (['APPROVE', 'REJECT', 'REPROCESS'])[event_id // 12 % 3 + 1] AS action FROM events),
    i AS (SELECT *, CASE WHEN current IN ('APPROVED', 'REJECTED') THEN 'ALREADY_DECIDED' WHEN verdict = 'PASS' THEN 'NOT_NEEDED' WHEN verdict = 'REJECT' AND action = 'APPROVE' THEN 'REJECTED_NOT_APPROVABLE' END AS issue FROM r)
    SELECT event_id, issue, CASE WHEN issue IS NOT NULL THEN current WHEN action = 'APPROVE' THEN 'APPROVED' WHEN action = 'REJECT' THEN 'REJECTED' ELSE 'REPROCESS_REQUESTED' END AS decision FROM i""")
def review_actions(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    rows = _events(spark, sf_dir).select("event_id", pick(("PASS", "MANUAL_REVIEW", "REJECT"), k).alias("v"), pick(("PENDING", "NOT_REQUIRED", "APPROVED", "REJECTED"), F.floor(k / 3)).alias("c"), pick(("APPROVE", "REJECT", "REPROCESS"), F.floor(k / 12)).alias("a"))
    return rows.select("event_id", review.reviewed(F.col("v"), F.col("c"), F.col("a")).alias("r")).select("event_id", "r.issue", "r.decision")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, max(ts) OVER (PARTITION BY user_id) AS last, (SELECT max(ts) FROM events) AS now FROM events) SELECT user_id, event_id FROM s WHERE n <= 4 AND last + INTERVAL 5 DAY > now""")
def retained_events(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    return events.retained(rows, ["user_id"], "event_id", 4, "ts", now, 5 * 86400).select("user_id", "event_id")


@query("""SELECT event_type, count(*) AS claimed, count(*) FILTER (event_id % 6 <> 0) AS published, count(*) FILTER (event_id % 6 = 0) AS failed, round(sum(CASE WHEN event_id % 6 <> 0 THEN greatest(0.0, event_id % 9 - 2) END), 3)::DOUBLE AS lag FROM events GROUP BY 1""")
def publish_results(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = _events(spark, sf_dir).select("event_type", (F.col("event_id") % 6 != 0).alias("ok"), at.alias("occurred_at"), (at + F.make_dt_interval(secs=F.col("event_id") % 9 - 2)).alias("published_at"))
    return events.publish_results(rows, "event_type")


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM n WHERE n <= 4""")
def recent_turns(spark, sf_dir):
    return paging.recent(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 4)


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7")
def optional_filters(spark, sf_dir):
    return paging.matching(table(spark, sf_dir, "part"), p_size=7, p_type=None).select("p_partkey", "p_name")


@query(r"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(sha256(p_name)) WHEN p_partkey % 3 = 1 THEN sha256(p_name) END AS digest, lower(replace(p_type, ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '.' END)) AS kind, CASE WHEN p_partkey % 5 = 0 THEN '9x' ELSE '_x' END AS collection FROM part)
    SELECT p_partkey, concat_ws(',', CASE WHEN NOT regexp_full_match(digest, '[a-f0-9]{64}') THEN 'digest' END, CASE WHEN NOT regexp_full_match(kind, '[a-z][a-z0-9]*(-[a-z0-9]+)*') THEN 'kind' END, CASE WHEN NOT regexp_full_match(collection, '[A-Za-z_][A-Za-z0-9_]{0,254}') THEN 'collection' END) AS unfit FROM c""")
def pattern_checks(spark, sf_dir):
    k = F.col("p_partkey")
    digest = F.when(k % 3 == 0, F.upper(F.sha2("p_name", 256))).when(k % 3 == 1, F.sha2("p_name", 256))
    kind = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.when(k % 2 == 0, "-").otherwise(".")))
    rows = table(spark, sf_dir, "part").select("p_partkey", digest.alias("digest"), kind.alias("kind"), F.when(k % 5 == 0, "9x").otherwise("_x").alias("collection"))
    return paging.unfit(rows, {"digest": "sha256", "kind": "code", "collection": "collection"}).select("p_partkey", F.array_join("unfit", ",").alias("unfit"))


@query("""WITH s AS (SELECT p_partkey, rtrim(ltrim(regexp_replace(lower(CASE WHEN p_partkey % 9 = 0 THEN ' %%' ELSE p_name || ' #' || p_type || '!' END), '[^a-z0-9._-]+', '-', 'g'), '-'), '-')[1:100] AS name FROM part)
    SELECT p_partkey, CASE WHEN name <> '' THEN 'derived/' || p_partkey || '/content-r2/parser-' || name || '/blocks.json' END AS key FROM s""")
def snapshot_keys(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 9 == 0, " %%").otherwise(F.concat("p_name", F.lit(" #"), "p_type", F.lit("!")))
    return table(spark, sf_dir, "part").select("p_partkey", ids.snapshot_key(F.col("p_partkey"), F.lit(2), name).alias("key"))


@query("""WITH b AS (SELECT l_orderkey AS doc_id, l_partkey || '.' || l_linenumber || '.' || l_suppkey AS target_id, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END AS page_no, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS slide_no, CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey % 3 END AS sheet_name, l_quantity AS y1, l_discount AS x1 FROM lineitem)
    SELECT doc_id, target_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page_no, slide_no) NULLS LAST, coalesce(sheet_name, ''), y1, x1, target_id)::INT AS place FROM b""")
def ocr_order(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws(".", F.col("l_partkey").cast("string"), n.cast("string"), F.col("l_suppkey").cast("string")).alias("target_id"), F.when(n % 3 > 0, n).alias("page_no"), F.when(n % 2 == 0, n).alias("slide_no"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string"))).alias("sheet_name"), F.col("l_quantity").alias("y1"), F.col("l_discount").alias("x1"),
    )
    return ocr.in_order(rows).select("doc_id", "target_id", "place")


@query("""WITH p AS (SELECT c_custkey AS profile, 'm' || c_custkey % 5 AS m, CASE WHEN c_custkey % 2 = 0 THEN 'v1' END AS sparse, 100 + c_custkey % 7 AS most FROM customer)
    SELECT profile, concat_ws(',', CASE WHEN m <> 'm1' THEN 'modelId' END, CASE WHEN sparse IS DISTINCT FROM CASE WHEN profile % 4 = 0 THEN 'v1' END THEN 'sparseFormatVersion' END, CASE WHEN most > 103 THEN 'maxInputTokens' END,
        CASE WHEN profile % 3 = 0 THEN 'capability:document' END, CASE WHEN sparse IS NOT NULL AND profile % 3 <> 1 THEN 'capability:sparse' END) AS mismatches FROM p""")
def profile_mismatches(spark, sf_dir):
    k = F.col("c_custkey")
    same = {f: F.lit("x") for f in review.PROFILE_FIELDS}
    wanted = same | {"profile": k, "modelId": F.concat(F.lit("m"), (k % 5).cast("string")), "sparseFormatVersion": F.when(k % 2 == 0, "v1"), "maxInputTokens": 100 + k % 7}
    able = F.when(k % 3 == 0, F.array(F.lit("query"), F.lit("dense"))).when(k % 3 == 1, F.array(F.lit("query"), F.lit("document"), F.lit("dense"), F.lit("sparse"))).otherwise(F.array(F.lit("query"), F.lit("document"), F.lit("dense")))
    given = same | {"profile": k, "modelId": F.lit("m1"), "sparseFormatVersion": F.when(k % 4 == 0, "v1"), "maxInputTokens": F.lit(103), "capabilities": able}
    rows = table(spark, sf_dir, "customer")
    found = review.profile_mismatches(*(rows.select(*[c.alias(n) for n, c in side.items()]) for side in (wanted, given)))
    return found.select("profile", F.array_join("mismatches", ",").alias("mismatches"))


# Lines of orders stand for the ten steps of jobs: those returned have succeeded, those of even quantity know their units only.
@query("""WITH w AS (SELECT * FROM (VALUES ('SECURITY_SCAN', 8), ('PARSE', 20), ('OCR', 12), ('NORMALIZE', 10), ('CHUNK', 15), ('QUALITY_GATE', 10), ('EMBED', 12), ('INDEX', 8), ('VERIFY', 3), ('PUBLISH', 2)) AS t(step, weight)),
    n AS (SELECT *, (['SECURITY_SCAN', 'PARSE', 'OCR', 'NORMALIZE', 'CHUNK', 'QUALITY_GATE', 'EMBED', 'INDEX', 'VERIFY', 'PUBLISH'])[((l_linenumber + l_orderkey) % 10 + 1)::INT] AS step FROM lineitem),
    s AS (SELECT l_orderkey, weight, CASE WHEN l_returnflag = 'R' THEN 100.0 WHEN l_quantity % 2 = 1 THEN l_quantity * 2 WHEN l_linenumber % 3 = 0 THEN 0 ELSE round(least(100, 100.0 * l_quantity / 37), 2) END AS percent FROM n JOIN w USING (step))
    SELECT l_orderkey, round(least(100.0, sum(weight * percent::DECIMAL(12, 6))::DECIMAL(24, 6) * 0.01::DECIMAL(3, 2)), 2)::DOUBLE AS overall FROM s GROUP BY 1""")
def weighted_progress(spark, sf_dir):
    quantity = F.col("l_quantity").cast("double")
    names = F.element_at(F.array(*[F.lit(s) for s in numbers.STEP_WEIGHTS]), ((F.col("l_linenumber") + F.col("l_orderkey")) % 10 + 1).cast("int"))
    steps = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", names.alias("step"), F.when(F.col("l_returnflag") == "R", "SUCCEEDED").otherwise("RUNNING").alias("status"),
        F.when(quantity % 2 == 1, quantity * 2).alias("percent"), quantity.alias("processed"), F.when(F.col("l_linenumber") % 3 != 0, 37).alias("total"),
    )
    return events.progress(steps, numbers.STEP_WEIGHTS, "l_orderkey")


@query("""WITH f AS (SELECT *, sha256(props) AS h, first_value(sha256(props)) OVER w AS first, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
    SELECT user_id, event_type, event_id, CASE WHEN n = 1 THEN 'CREATED' WHEN h = first THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome FROM f""")
def idempotent_replay(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id", F.sha2("props", 256).alias("request_sha256"))
    return events.replays(rows, ["user_id", "event_type"], "event_id").drop("request_sha256")


@query("""SELECT event_type, le::INT AS le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1, 10, 50, 100, 1000000000]) AS le) GROUP BY event_type, le""")
def publish_lag(spark, sf_dir):
    rows = events.lag_histogram(_events(spark, sf_dir), F.col("value"), (1, 10, 50, 100), "event_type")
    return rows.select("event_type", F.least("le", F.lit(1e9)).cast("int").alias("le"), "n")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def redacted_props(spark, sf_dir):
    found = F.from_json("props", "map<string,string>")
    with_secret = F.map_concat(found, F.create_map(F.lit("api_token"), F.lit("t"), F.lit("Cookie"), F.lit("c")))
    kept = secrecy.redact(with_secret)
    return _events(spark, sf_dir).select("event_id", F.when(F.size(kept) == F.size(found), kept["k"]).alias("k"))


@query("SELECT conv_id, turn, text, sha256(text) AS sha256 FROM conversations")
def protected_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", secrecy.protect(F.col("text"), F.lit("0123456789abcdef0123456789abcdef")).alias("p"))
    return rows.select("conv_id", "turn", secrecy.reveal(F.col("p"), F.lit("0123456789abcdef0123456789abcdef")).alias("text"), F.col("p.sha256").alias("sha256"))


@query("""WITH s AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events)
    SELECT key, sequence, event_id, 'APPENDED' AS outcome FROM s UNION ALL SELECT key, sequence, event_id, 'DUPLICATE' FROM s WHERE event_id % 10 = 0""")
def streaming_sequence(spark, sf_dir):
    rows = event_sequence(spark, sf_dir).select(F.col("user_id").alias("key"), "sequence", "event_id")
    path = new_path(spark, "stream-in")
    again = rows.filter("event_id % 10 = 0")
    rows.unionByName(again).write.parquet(path)
    out = new_path(spark, "stream-out")
    with stateful.state_store(spark):
        sequences.run_available(stateful.bounded_log(spark.readStream.schema(rows.schema).parquet(path), 100), sequences.batch_sink(out), new_path(spark, "stream-log"))
    return spark.read.parquet(out).drop("batch").withColumn("key", F.col("key").cast("long"))


@query("""SELECT event_type, date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS n FROM events GROUP BY 1, 2""")
def streaming_windows(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    kept = write_shared(rows, "stream-in")
    out = new_path(spark, "stream-out")
    stream = spark.readStream.schema(kept.schema).parquet(kept.inputFiles()[0].rsplit("/", 1)[0])
    counts = sequences.windowed_counts(stream, "ts", "1 hour", "1 hour", "event_type")
    sequences.run_available(counts, sequences.batch_sink(out), new_path(spark, "stream-log"), "update")
    done = spark.read.parquet(out).groupBy("event_type", "window").agg(F.max_by("n", "batch").alias("n"))
    return done.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
    f AS (SELECT user_id, min(sequence) AS first FROM s WHERE event_id % 13 <> 0 GROUP BY 1), g AS (SELECT s.user_id, min(sequence) AS gap FROM s JOIN f ON f.user_id = s.user_id WHERE event_id % 13 = 0 AND sequence > first GROUP BY 1),
    l AS (SELECT s.user_id, coalesce(max(CASE WHEN event_id % 13 <> 0 AND sequence < coalesce(gap, 1000000000) THEN sequence END), 0) AS last, max(gap) AS gap FROM s LEFT JOIN g ON g.user_id = s.user_id GROUP BY 1)
    SELECT s.user_id::VARCHAR AS key, sequence, event_id, CASE WHEN sequence < coalesce(gap, 1000000000) THEN 'APPENDED' ELSE 'GAP' END AS outcome FROM s JOIN l ON l.user_id = s.user_id WHERE event_id % 13 <> 0
    UNION ALL SELECT s.user_id::VARCHAR, sequence, event_id, CASE WHEN sequence <= last THEN 'DUPLICATE' ELSE 'APPENDED' END FROM s JOIN l ON l.user_id = s.user_id
    UNION ALL SELECT user_id::VARCHAR, sequence, event_id, 'RETAINED' FROM (SELECT *, max(sequence) OVER (PARTITION BY user_id) - sequence AS back FROM s) WHERE back < 5""")
def streaming_log(spark, sf_dir):
    """Events with some missing, then, after a restart, all of them: what became of each, and what the logs hold in the end."""
    rows = event_sequence(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "sequence", "event_id")
    path, out, log = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    for part in (rows.filter("event_id % 13 <> 0"), rows):
        part.write.mode("append").parquet(path)
        with stateful.state_store(spark):
            sequences.run_available(stateful.bounded_log(spark.readStream.schema(rows.schema).parquet(path), 5), sequences.batch_sink(out), log)
    return spark.read.parquet(out).drop("batch").unionByName(stateful.retained(spark, log).withColumn("outcome", F.lit("RETAINED")))


_LEASES = """e AS (SELECT 'j' || (user_id % 40) AS key, (['lease', 'renew', 'lease', 'done', 'renew'])[event_id % 5 + 1] AS action, 1000000 + event_id * 7 AS t, CASE WHEN event_id % 5 <> 3 THEN 1000000 + event_id * 7 + 60 + (event_id % 11) * 90 END AS until FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS k FROM (SELECT * FROM e UNION ALL SELECT DISTINCT key, 'end', (SELECT max(t) FROM e), NULL FROM e)),
    r AS (SELECT key, 0::BIGINT AS k, NULL::BIGINT AS until, 1 AS attempt, NULL::BIGINT AS gone, 0 AS tried FROM n WHERE k = 1 UNION ALL
        SELECT n.key, n.k, CASE WHEN n.action = 'lease' AND (r.until IS NULL OR r.until <= n.t) THEN n.until WHEN n.action = 'renew' AND r.until > n.t THEN n.until WHEN n.action = 'done' OR r.until <= n.t THEN NULL ELSE r.until END,
            CASE WHEN r.until <= n.t THEN least(r.attempt + 1, 3) ELSE r.attempt END, CASE WHEN r.until <= n.t THEN r.until END, r.attempt FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)"""


def _lease_log(spark, sf_dir):
    k = F.col("event_id")
    at = 1_000_000 + k * 7
    action = F.element_at(F.array(*[F.lit(a) for a in ("lease", "renew", "lease", "done", "renew")]), (k % 5 + 1).cast("int"))
    until = F.when(k % 5 != 3, at + 60 + (k % 11) * 90)
    return _events(spark, sf_dir).select(F.concat(F.lit("j"), (F.col("user_id") % 40).cast("string")).alias("key"), action.alias("action"), F.timestamp_seconds(at).alias("at"), F.timestamp_seconds(until).alias("until"))


_LEASES_GONE = f"WITH RECURSIVE {_LEASES} SELECT key, gone AS expired_at, tried AS attempt, CASE WHEN tried >= 3 THEN 'WAITING' ELSE 'QUEUED' END AS next_status FROM r WHERE gone IS NOT NULL"


@query(_LEASES_GONE)
def lease_timers(spark, sf_dir):
    """Leases that run out on a stream, by timers, in two runs of the query."""
    log = _lease_log(spark, sf_dir)
    half = log.agg(F.timestamp_seconds(F.floor((F.min(F.unix_seconds("at")) + F.max(F.unix_seconds("at"))) / 2)).alias("h")).first()["h"]
    path, out, state = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    for part in (log.filter(F.col("at") < F.lit(half)), log.filter(F.col("at") >= F.lit(half))):
        part.write.mode("append").parquet(path)
        with stateful.state_store(spark):
            sequences.run_available(stateful.expiring_leases(spark.readStream.schema(log.schema).parquet(path), 3), sequences.batch_sink(out), state)
    return spark.read.parquet(out).select("key", F.unix_seconds("expired_at").alias("expired_at"), "attempt", "next_status")


@query(_LEASES_GONE)
def lease_log_expiry(spark, sf_dir):
    """The same log as a batch."""
    log = _lease_log(spark, sf_dir)
    last = log.agg(F.max("at").alias("last")).first()["last"]
    found = stateful.expired_leases(log, 3, F.lit(last))
    return found.select("key", F.unix_seconds("expired_at").alias("expired_at"), "attempt", "next_status")


@query("""WITH e AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'PARSE' WHEN 'assistant' THEN 'PROJECT' END AS stage, role NOT IN ('user', 'assistant') OR (conv_id * 31 + turn) % 11 = 0 AS stuck FROM conversations),
    f AS (SELECT conv_id, min(turn) AS first FROM e WHERE stuck GROUP BY 1)
    SELECT e.conv_id || '.' || turn AS event_id, e.conv_id::VARCHAR AS run, turn AS sequence, stage, CASE WHEN first IS NULL OR turn < first THEN 'DELIVERED' WHEN turn = first AND stage IS NOT NULL THEN 'RETRIED' ELSE 'WAITING' END AS state
    FROM e LEFT JOIN f ON f.conv_id = e.conv_id""")
def outbox_relay(spark, sf_dir):
    """Turns of conversations as events: what was delivered, what failed and waits to be tried again, and what is behind it or has no sink."""
    kind = F.when(F.col("role") == "user", "ingestion.requested.v1").when(F.col("role") == "assistant", "index.built").otherwise("other")
    name = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("run"), F.col("turn").cast("long").alias("sequence"), name.alias("event_id"), kind.alias("event_type"), F.sha2("text", 256).alias("payload"))
    source, path = new_path(spark, "outbox"), new_path(spark, "relay")
    rows.write.parquet(source)
    most = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0

    def sink(part):
        return part.select("event_id", ((F.col("run").cast("long") * 31 + F.col("sequence")) % 11 != 0).alias("ok"))

    step = relay.relay(path, {"PARSE": sink, "PROJECT": sink}, rounds=most)
    sequences.run_available(spark.readStream.schema(rows.schema).parquet(source), step, new_path(spark, "stream-log"))
    stage = events.stage_of(F.col("event_type"))
    left = relay.waiting(spark, path, 0).select("event_id", "run", "sequence", F.when(stage.isin("PARSE", "PROJECT"), stage).alias("stage"), F.when(F.col("attempts") > 0, "RETRIED").otherwise("WAITING").alias("state"))
    return relay.ledger(spark, path).select("event_id", "run", "sequence", "stage", F.lit("DELIVERED").alias("state")).unionByName(left)
