"""Frames of every origin: other file formats number no rows, so they are copied first."""

import pytest
from conftest_llm import documents

from pagewright.llm import exact_dedup, jaccard, mixing, rows, secrets


@pytest.mark.parametrize("kind", ["json", "orc", "parquet"])
def test_scans_of_any_format(spark, awkward, tmp_path, kind):
    docs = documents(spark, awkward, tmp_path / kind, kind)
    assert (rows.from_files(docs) is docs) == (kind == "parquet")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == 6
    assert jaccard.keep_one(docs).count() < len(awkward)
    assert {r["source"] for r in mixing.mixed(docs).select("source").collect()} <= {s for _, _, s in awkward}
    assert secrets.report(secrets.scan(docs)).count() == len(awkward)


def test_csv_and_frames_that_are_no_plain_scan(spark, tmp_path):
    spark.createDataFrame([(1, "same text"), (2, "same text")], "doc_id long, text string").write.csv(str(tmp_path / "c"))
    docs = spark.read.schema("doc_id long, text string").csv(str(tmp_path / "c"))
    assert exact_dedup.drop_copies(docs).count() == 1
    docs.createOrReplaceTempView("scanned")
    assert exact_dedup.drop_copies(spark.table("scanned")).count() == 1
