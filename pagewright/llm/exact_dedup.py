"""Exact deduplication as a stateful stream.

The documents' fingerprints (digest, identifier, length, content locator) run
through a Structured Streaming aggregation without a watermark, so its keyed
state never expires; RocksDB keeps that state on disk. Per digest the state
retains how many rows had it and the identifier and locator of the row that
stays. A digest that is hit more than once is only believed after the full
bytes of its texts have been compared; texts that share a digest and differ
are then told apart by their bytes.

Only DataFrame and SQL functions are used.

Defined cases: a null text equals an empty one; texts are equal when they are
the same after deleting every character of ``[\\x20\\x09-\\x0D]``; of equal
texts the one with most code points in the original stays, then the smallest
doc_id (null last), then an arbitrary but single row among repeated rows; an
empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.rows import from_files, placed
from pagewright.shared import discard, new_path, write_shared

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside ahead of writes
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def with_locator(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, at)``: ``at`` says in which file and row the content lies.

    A frame that doesn't come straight from files is written to the shared folder first.
    """
    return placed(from_files(docs)).select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"), "at")


def fingerprints(located: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """``(doc_id, digest, points, at)``; works on batch and streaming frames."""
    return located.select(
        "doc_id",
        F.substring(F.unhex(F.sha2(normalised(F.col("text")), 256)), 1, digest_bytes).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        "at",
    )


def _best() -> Column:
    """Most code points, then smallest doc_id, then one row of those that are left."""
    return F.max(F.struct("points", F.bitwise_not("doc_id").alias("order"), "doc_id", "at"))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful aggregation: per digest, rows seen and the row that stays so far."""
    return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))


def run_stream(spark: SparkSession, prints: DataFrame, path: str, files_per_batch: int = 256) -> DataFrame:
    """Stream the fingerprints at ``path`` through the state; return its last value per digest."""
    out, log = new_path(spark, "dedup-groups"), new_path(spark, "dedup-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        query = keyed_state(stream).writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    schema = keyed_state(prints).schema.add("batch", T.IntegerType())
    made = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made):  # no rows, no batch
        return spark.createDataFrame([], keyed_state(prints).schema)
    groups = spark.read.schema(schema).parquet(out)
    return groups.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("last")).select("digest", "last.*")


def exact_groups(docs: DataFrame, digest_bytes: int = 32, files_per_batch: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, at, text_sha256, keep_id, group_size, kept.

    ``digest_bytes`` shortens the digest; only tests do so, to make digests collide.
    """
    spark = docs.sparkSession
    located = with_locator(docs)
    path = new_path(spark, "dedup-prints")
    made = fingerprints(located, digest_bytes)
    made.write.option("compression", "zstd").parquet(path)
    prints = spark.read.schema(made.schema).parquet(path)
    groups = write_shared(run_stream(spark, prints, path, files_per_batch), "dedup-state-values")

    # Hits: compare the full bytes. Each task sends on at most two texts per digest.
    hits = prints.join(groups.filter("group_size > 1").select("digest"), "digest", "left_semi").select("at", "digest")
    content = located.join(hits.hint("shuffle_hash"), "at").select("doc_id", "at", "digest", normalised(F.col("text")).alias("content"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"))
    differ = write_shared(
        content.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select("digest"),
        "dedup-collisions",
    )
    sha = F.lower(F.hex("digest"))
    rows = prints
    told_apart = None
    if not differ.isEmpty():
        clash = content.join(differ, "digest", "left_semi")
        apart = clash.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
        told_apart = clash.select("doc_id", "at", "digest", "content").join(apart, ["digest", "content"]).withColumn("text_sha256", F.sha2("content", 256))
        rows = prints.join(differ, "digest", "left_anti")
    if digest_bytes < 32:
        rows = rows.join(located.select("at", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "at")
        sha = F.col("text_sha256")
    rows = rows.join(groups, "digest").withColumn("text_sha256", sha)
    columns = ["doc_id", "at", "text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("best.at")).alias("kept")]
    found = rows.select(*columns)
    return found if told_apart is None else found.unionByName(told_apart.select(*columns))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a kept row has; all columns stay, whatever their names."""
    docs = from_files(docs)
    gone = exact_groups(docs).filter(~F.col("kept")).select("at")
    return placed(docs).join(gone.hint("shuffle_hash"), "at", "left_anti").select("doc.*")


__all__ = ["discard", "drop_copies", "exact_groups", "fingerprints", "keyed_state", "normalised", "run_stream", "with_locator"]
