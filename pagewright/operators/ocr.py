"""Which pages need recognition, and how its blocks replace the parser's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def low_coverage(pages: DataFrame, least: float) -> DataFrame:
    """Pages that are only an image, or whose text covers less than ``least``; each once."""
    return pages.filter(F.col("image_only") | (F.col("text_coverage") < least)).select("doc_id", "page_no").distinct()


def targets(candidates: DataFrame, pages: DataFrame, least: float) -> DataFrame:
    """doc_id, page_no, target, origin: the parser's candidates and the pages found here; the parser's win, and a page whose
    whole image is a candidate needs no target of its own."""
    found = low_coverage(pages, least).select("doc_id", "page_no", F.lit("PAGE").alias("target"), F.lit("COVERAGE").alias("origin"))
    own = candidates.select("doc_id", "page_no", "target", F.lit("PARSER").alias("origin"))
    whole = own.filter("target = 'WHOLE_IMAGE'").select("doc_id", "page_no")
    found = found.join(whole, ["doc_id", "page_no"], "left_anti")
    rank = Window.partitionBy("doc_id", "page_no", "target").orderBy(F.desc("origin"))
    return own.unionByName(found).withColumn("__n", F.row_number().over(rank)).filter("__n = 1").drop("__n")


def replace(native: DataFrame, recognised: DataFrame, page_targets: DataFrame) -> DataFrame:
    """The parser's blocks of pages that weren't recognised as a whole, and the recognised blocks."""
    kept = native.join(page_targets.filter("target = 'PAGE'").select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")
    return kept.withColumn("origin", F.lit("NATIVE")).unionByName(recognised.withColumn("origin", F.lit("OCR")))


def in_order(found: DataFrame) -> DataFrame:
    """Targets by page or slide (unknown last), sheet, top edge, left edge and id: add place, from 1, per document."""
    order = [F.coalesce("page_no", "slide_no").asc_nulls_last(), F.coalesce("sheet_name", F.lit("")), F.col("y1").asc_nulls_last(), F.col("x1").asc_nulls_last(), "target_id"]
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def recognised_pages(blocks: DataFrame, *by: str) -> DataFrame:
    """How many pages recognition has read, per run."""
    return blocks.filter("ocr_engine IS NOT NULL").groupBy(*by).agg(F.count_distinct("page_no").alias("ocr_pages"))
