"""Embeddings, vector search, reconciliation and publication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import ids, vectors
from pagewright.operators.chunking import pack_blocks
from pagewright.shared import new_path, write_shared

MOST_QUERIES = 4096
AT_ONCE = 256  # queries that a task multiplies at a time


def _matrices(vectors_: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors of that length, and their rows made unit length (zero stays zero)."""
    flat = vectors_.combine_chunks() if isinstance(vectors_, pa.ChunkedArray) else vectors_
    sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        x = flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width) if width else np.zeros((len(at), 1))
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[width] = (at, np.divide(x, length, out=np.zeros_like(x), where=length > 0))
    return out


def _best_rows(asked: Broadcast, k: int):
    """Per task: the k best rows of each query of a block, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = asked.value
        who, scopes = table.column("query_id").to_numpy(), table.column("scope").to_pandas().to_numpy()
        mine = _matrices(table.column("q"))
        queries, ids_, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(who), -2.0)  # what k rows of a query have reached

        def found(part: pa.RecordBatch, theirs: dict, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of queries, places of rows and scores: what may be among the best of some queries, from ``begin`` on."""
            end = min(begin + AT_ONCE, len(who))
            score = np.full((end - begin, part.num_rows), -1.0)
            for width, (at, x) in theirs.items():
                if width and width in mine:
                    asked_, q = mine[width]
                    here = slice(*np.searchsorted(asked_, [begin, end]))
                    s = q[here] @ x.T
                    s[~q[here].any(axis=1)] = -1.0
                    s[:, ~x.any(axis=1)] = -1.0
                    score[np.ix_(asked_[here] - begin, at)] = s
            if part.column(2).null_count < part.num_rows:
                score[scopes[begin:end, None] != part.column(2).to_pandas().to_numpy()[None, :]] = -2.0
            bound = np.partition(score, score.shape[1] - k, axis=1)[:, -k] if score.shape[1] > k else np.full(end - begin, -2.0)
            l, h = np.nonzero((score >= np.maximum(bound, floor[begin:end])[:, None] - 1e-12) & (score > -1.5))
            return l + begin, h, score[l, h]

        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                theirs, ids = _matrices(part.column(1)), part.column(0).to_numpy()
                new = [found(part, theirs, begin) for begin in range(0, len(who), AT_ONCE)]
                new = [np.concatenate(x) for x in zip(*new, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                queries, ids_, scores = (np.concatenate(pair) for pair in zip((queries, ids_, scores), (new[0], ids[new[1]], new[2]), strict=True))
                order = np.lexsort((ids_, -scores, queries))
                queries, ids_, scores = queries[order], ids_[order], scores[order]
                place = np.arange(len(queries)) - np.searchsorted(queries, queries, side="left")
                floor[queries[place == k - 1]] = scores[place == k - 1]
                kept = place < k
                queries, ids_, scores = queries[kept], ids_[kept], scores[kept]
        yield pa.RecordBatch.from_arrays([pa.array(who[queries]), pa.array(ids_), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: exact cosine search of a stated set of queries.

    ``queries`` has query_id and q, ``rows`` vec_id and v. With ``scope`` a query only sees rows of its own scope. Queries
    travel in packed blocks of at most ``MOST_QUERIES``, each of which passes over the rows once; a task multiplies ``AT_ONCE`` of
    them with a batch of rows as matrices and keeps k rows of each query, so nothing but these is shuffled. Scores are -1 for vectors of
    another length or without one.
    """
    spark = rows.sparkSession
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), *([F.col(scope).alias("scope")] if scope else [F.lit(None).cast("int").alias("scope")]))
    held = rows.select("vec_id", F.col("v").cast("array<double>").alias("v"), *([F.col(scope).alias("scope")] if scope else [F.lit(None).cast("int").alias("scope")]))
    n = max(1, -(-asked.count() // MOST_QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    placed = write_shared(asked.withColumn("block", block), "asked")
    path, schema = new_path(spark, "nearest"), "query_id long, vec_id long, score double"
    for b in range(n):  # a block is one broadcast and one pass over the rows; what a pass has found is written
        sent = spark.sparkContext.broadcast(placed.filter(F.col("block") == b).orderBy("query_id").toArrow())
        held.mapInArrow(_best_rows(sent, k), schema).write.parquet(f"{path}/block={b}")
        sent.unpersist()
    out = spark.read.schema(schema).parquet(*[f"{path}/block={b}" for b in range(n)])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def valid_embeddings(rows: DataFrame, dimensions: int, model: str, revision: str, sparse: bool, normal: bool = True, slack: float = 0.02) -> DataFrame:
    """Add issue: what is wrong with an embedder's output (model, revision, v, sparse), or null."""
    norm = vectors.norm(F.col("v"))
    off = norm.isNull() | F.isnan(norm) | (norm == float("inf")) | (F.abs(norm - 1) > slack)
    bad = F.when(~(F.col("model").eqNullSafe(F.lit(model)) & F.col("revision").eqNullSafe(F.lit(revision))), "response.model")
    bad = bad.when(F.coalesce(F.size("v"), F.lit(-1)) != dimensions, "response.denseDimension").when(F.lit(sparse) & F.col("sparse").isNull(), "response.sparse")
    return rows.withColumn("issue", bad.when(F.lit(normal) & off, "response.normalization"))


def reuse(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """Add reused: whether the content's vector is already known for its profile."""
    known = facts.select("profile", "content_sha256").distinct().withColumn("reused", F.lit(True))
    return wanted.join(known, ["profile", "content_sha256"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def new_facts(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """Contents to embed: each once."""
    return wanted.select("profile", "content_sha256", "text").dropDuplicates(["profile", "content_sha256"]).join(facts, ["profile", "content_sha256"], "left_anti")


def batches(items: DataFrame, by: list[str], max_tokens: int, max_items: int) -> DataFrame:
    """Embedding batches in order, under limits of tokens and of items."""
    return pack_blocks(items, by, "tokens", max_tokens, max_items)


def in_manifests(rows: DataFrame) -> DataFrame:
    """Rows whose vectors are told apart by manifest: vector_id under the name ``key``."""
    return rows.withColumnRenamed("vector_id", "key")


def reconcile(expected: DataFrame, actual: DataFrame, profile: str, asked: DataFrame | None = None, returned: DataFrame | None = None) -> DataFrame:
    """code, vector_id, repairable: how a written index differs from what it should hold, by code and vector.

    ``asked`` and ``returned`` have the ids (id) that fixed queries should and do find, with repeats.
    """
    one = lambda f: None if f is None else f.withColumn("manifest", F.lit(0))
    got = reconcile_manifests(one(in_manifests(expected)), one(in_manifests(actual)), profile, one(asked), one(returned))
    return got.drop("manifest")


def reconcile_manifests(expected: DataFrame, actual: DataFrame, profile: str, asked: DataFrame | None = None, returned: DataFrame | None = None) -> DataFrame:
    """manifest, code, vector_id, repairable for many manifests at once; all four tables have manifest, the first two key."""
    # The issues' codes.
    e = expected.select("manifest", "key", F.col("content_sha256").alias("want"), F.lit(True).alias("e"))
    a = actual.select("manifest", "key", F.col("content_sha256").alias("have"), F.col("profile").alias("p"), F.lit(True).alias("a"))
    both = e.join(a, ["manifest", "key"], "full")
    met = F.col("e") & F.col("a")
    codes = F.array_compact(
        F.array(
            F.when(F.col("a").isNull(), F.struct(F.lit("MISSING_PRIMARY_KEY").alias("code"), F.lit(True).alias("repairable"))),
            F.when(F.col("e").isNull(), F.struct(F.lit("UNEXPECTED_PRIMARY_KEY").alias("code"), F.lit(True).alias("repairable"))),
            F.when(met & ~F.col("want").eqNullSafe(F.col("have")), F.struct(F.lit("CONTENT_HASH_MISMATCH").alias("code"), F.lit(True).alias("repairable"))),
            F.when(met & ~F.col("p").eqNullSafe(F.lit(profile)), F.struct(F.lit("PROFILE_MISMATCH").alias("code"), F.lit(False).alias("repairable"))),
        )
    )
    found = both.select("manifest", F.explode(codes).alias("i"), F.col("key").alias("vector_id")).select("manifest", "i.code", "vector_id", "i.repairable")
    none = F.lit(None).cast(found.schema["vector_id"].dataType)
    uneven = both.groupBy("manifest").agg((F.count("e") != F.count("a")).alias("differ")).filter("differ").select("manifest", F.lit("COUNT_MISMATCH").alias("code"), none.alias("vector_id"), F.lit(True).alias("repairable"))
    found = found.unionByName(uneven)
    if asked is not None and returned is not None:
        sides = asked.select("manifest", "id", F.lit(1).alias("n")).unionByName(returned.select("manifest", "id", F.lit(-1).alias("n")))
        missed = sides.groupBy("manifest", "id").agg(F.sum("n").alias("n")).filter("n <> 0").select("manifest").distinct()
        found = found.unionByName(missed.select("manifest", F.lit("FIXED_QUERY_MISMATCH").alias("code"), none.alias("vector_id"), F.lit(False).alias("repairable")))
    return found


def repair_plan(issues: DataFrame, *by: str) -> DataFrame:
    """by, action: REPAIR where every issue can be mended by writing or deleting vectors, else MANUAL.

    A fixed query that misses what it should find is no issue of its own while vectors are missing.
    """
    code = F.col("code")
    missing = F.count_if(code == "MISSING_PRIMARY_KEY") > 0
    unsafe = F.count_if(~F.col("repairable") & (code != "FIXED_QUERY_MISMATCH")) > 0
    probes = F.count_if(code == "FIXED_QUERY_MISMATCH") > 0
    return issues.groupBy(*by).agg(F.when(unsafe | (probes & ~missing), "MANUAL").otherwise("REPAIR").alias("action"))


def repaired(actual: DataFrame, expected: DataFrame, issues: DataFrame) -> DataFrame:
    """The index's records after a repair: unexpected ones go, missing and changed ones come from ``expected`` (of the same columns)."""
    gone = issues.filter(F.col("code").isin("UNEXPECTED_PRIMARY_KEY", "CONTENT_HASH_MISMATCH")).select("vector_id").distinct()
    wanted = issues.filter(F.col("code").isin("MISSING_PRIMARY_KEY", "CONTENT_HASH_MISMATCH")).select("vector_id").distinct()
    return actual.join(gone, "vector_id", "left_anti").unionByName(expected.join(wanted, "vector_id", "left_semi").select(*actual.columns))


def issues_in_order(issues: DataFrame) -> DataFrame:
    """Issues by code and vector as one text."""
    return issues.orderBy(F.concat_ws(":", "code", F.coalesce(F.col("vector_id").cast("string"), F.lit(""))))


def probe_ids(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """First, middle and last of each group; all if there are up to three."""
    # places by counts of key ranges, so that no task orders a whole group
    flat = rows.select(*by, key)
    ranged = write_shared(flat.repartitionByRange(*by, key).withColumn("__part", F.spark_partition_id()), "probe-ranges")
    counts = ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*by).orderBy("__part")
    counts = counts.withColumns({"__before": F.sum("__c").over(upto) - F.col("__c"), "__n": F.sum("__c").over(Window.partitionBy(*by))})
    middle = F.floor(F.col("__n") / 2) + 1
    holds = (F.col("__n") <= 3) | (F.col("__before") == 0) | ((F.col("__before") < middle) & (middle <= F.col("__before") + F.col("__c"))) | (F.col("__before") + F.col("__c") == F.col("__n"))
    place = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(key)) + F.col("__before")
    numbered = ranged.join(counts.filter(holds), [*by, "__part"]).withColumn("__i", place)
    return numbered.filter((F.col("__n") <= 3) | (F.col("__i") == 1) | (F.col("__i") == middle) | (F.col("__i") == F.col("__n"))).select(*by, key)


def recall(hits: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """cases, passed, recall, ok: a case passes if one of its hits is what it should find."""
    per = truth.join(hits, "case_id", "left").groupBy("case_id").agg(F.max((F.col("found") == F.col("expected")).cast("int")).alias("hit"))
    got = per.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum("hit"), F.lit(0)).alias("passed"))
    rate = F.when(F.col("cases") == 0, 0.0).otherwise(F.round(F.col("passed") / F.col("cases"), 6))
    return got.select("cases", "passed", rate.alias("recall"), (rate >= least).alias("ok"))


def next_manifest(current: DataFrame, replaced: DataFrame) -> DataFrame:
    """Members of the next manifest: those of the current one whose document isn't replaced, and the replacements."""
    kept = current.join(replaced.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(replaced)


def next_version(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def routes(spaces: DataFrame, heads: DataFrame, manifests: DataFrame, canaries: DataFrame, user: Column) -> DataFrame:
    """The spaces' columns, manifest and route of each run: the active head's manifest, or the candidate for the canary's share.

    ``spaces``: space and policy_version; ``heads``: space, manifest; ``canaries``: space, stable, candidate, percent (1 to 99)
    and salt, a row for each space that tries a candidate. A canary holds only as long as its stable manifest is the head and its
    candidate is verified.
    """
    stable = spaces.join(heads.select("space", F.col("manifest").alias("head")), "space")
    stable = stable.join(manifests.filter("status = 'ACTIVE'").select(F.col("manifest").alias("head")), "head")
    tried = canaries.join(manifests.filter("status = 'VERIFIED'").select(F.col("manifest").alias("candidate")), "candidate")
    both = stable.join(tried.select("space", F.col("stable").alias("head"), "candidate", "percent", "salt"), ["space", "head"], "left")
    chosen = F.when(ids.bucket(F.col("salt"), user) < F.col("percent"), F.col("candidate"))
    return both.select(*spaces.columns, F.coalesce(chosen, "head").alias("manifest"), F.when(chosen.isNotNull(), "CANARY").otherwise("STABLE").alias("route"))


def publish(heads: DataFrame, space_to_manifest: DataFrame) -> DataFrame:
    """The head table with some pointers moved; a space has one head."""
    return heads.join(space_to_manifest.select("space"), "space", "left_anti").unionByName(space_to_manifest)
