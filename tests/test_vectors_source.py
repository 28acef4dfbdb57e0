"""The data source of vectors: pushed filters, replacement by manifest, and failures that leave nothing to read."""

import pytest
from pyspark.sql import functions as F

from pagewright.shared import new_path
from pagewright.sources import vectors


def spark_of(frame):
    return frame.sparkSession


@pytest.fixture
def written(spark):
    vectors.register(spark)
    path = new_path(spark, "source")

    def rows(ids, tag):
        m = F.concat(F.lit("m"), (F.col("id") % 4).cast("string"))
        flat = spark.range(*ids).withColumns({
            "manifest_id": m, "vector_id": F.concat(F.lit(tag), F.col("id").cast("string")), "space_id": F.lit("s"), "document_id": F.lit("d"), "chunk_id": F.lit("c"), "ordinal": F.col("id"),
            "content_sha256": F.lit(tag), "embedding_profile_id": F.lit("p"), "dense_vector": F.array(F.col("id").cast("double")), "sparse_terms": F.array(F.lit("t")), "sparse_weights": F.array(F.lit(0.5))})
        return flat.drop("id").repartition(3)

    def put(frame, mode="append"):
        frame.write.format(vectors.FORMAT).mode(mode).save(path)

    return path, rows, put, lambda: spark.read.format(vectors.FORMAT).load(path)


def test_filters_reach_the_reader(written, capsys):
    path, rows, put, load = written
    assert load().count() == 0
    put(rows((0, 100), "a"))
    one = load().filter("manifest_id = 'm1' AND ordinal > 50")
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [EqualTo(manifest_id,m1)]" in plan and "manifest_id#" in plan and "= m1" not in plan.split("Condition")[1]
    assert {r["ordinal"] for r in one.collect()} == {i for i in range(51, 100) if i % 4 == 1}
    assert load().filter(F.col("manifest_id").isin("m0", "m2")).count() == 50 and load().filter("manifest_id = 'none'").count() == 0
    got = load().filter("vector_id = 'a7'").first()
    assert (got["manifest_id"], got["dense_vector"], got["sparse_terms"]) == ("m3", [7.0], ["t"])
    narrow = "vector_id string, manifest_id string"  # a schema with fewer columns reads no others
    assert {r["vector_id"] for r in spark_of(load()).read.format(vectors.FORMAT).schema(narrow).load(path).filter("manifest_id = 'm0'").collect()} == {f"a{i}" for i in range(0, 100, 4)}
    reader = vectors.VectorReader(path, ["manifest_id"])
    assert list(reader.pushFilters([vectors.EqualTo(("manifest_id",), "m1"), vectors.EqualTo(("ordinal",), 1)])) == [vectors.EqualTo(("ordinal",), 1)]
    assert all(p.manifests == ["m1"] for p in reader.partitions())


def test_commits_replace_their_manifests(written):
    _, rows, put, load = written
    put(rows((0, 40), "a"))
    put(rows((0, 40), "b").filter("manifest_id = 'm2'"))
    assert {tuple(r) for r in load().groupBy("manifest_id", "content_sha256").count().collect()} == {("m0", "a", 10), ("m1", "a", 10), ("m2", "b", 10), ("m3", "a", 10)}
    put(rows((0, 8), "c").filter("manifest_id = 'm1'"), "overwrite")
    assert {tuple(r) for r in load().groupBy("manifest_id", "content_sha256").count().collect()} == {("m1", "c", 2)}


def test_failed_jobs_leave_nothing_to_read(written):
    _, rows, put, load = written
    put(rows((0, 40), "a"))
    bad = rows((0, 40), "x").withColumn("vector_id", F.when(F.col("ordinal") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("vector_id")))
    with pytest.raises(Exception, match="broken"):
        put(bad)
    with pytest.raises(Exception, match="needs a manifest"):
        put(rows((0, 4), "x").withColumn("manifest_id", F.when(F.col("ordinal") > 1, "m1")))
    assert {tuple(r) for r in load().groupBy("content_sha256").count().collect()} == {("a", 40)}
