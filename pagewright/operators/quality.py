"""Document quality: metrics, findings and verdict; and the file security gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.functions.numbers import ratio


@dataclass(frozen=True)
class Thresholds:
    """The default policy."""

    min_non_empty: float = 0.6
    reject_non_empty: float = 0.2
    min_ocr: float = 0.75
    max_garbled: float = 0.03
    reject_garbled: float = 0.15
    max_duplicate: float = 0.4
    heading_after: int = 20


# The findings that reject a document.
HARD = ("QUALITY_OWNER_MISSING", "QUALITY_VERSION_CONFLICT", "QUALITY_PARSE_COVERAGE_CRITICAL", "QUALITY_GARBLED_CRITICAL")


def malformed(cells: Column, header_rows: Column) -> Column:
    """A table without rows, with more header rows than rows, without columns, or with rows of different widths."""
    width = F.coalesce(F.size(F.get(cells, F.lit(0))), F.lit(0))
    ragged = F.exists(cells, lambda r: F.size(r) != width)
    return cells.isNull() | (F.size(cells) == 0) | (F.coalesce(header_rows, F.lit(0)) > F.size(cells)) | (width == 0) | F.coalesce(ragged, F.lit(True))


def block_metrics(blocks: DataFrame, *by: str) -> DataFrame:
    """Per document: ``blocks`` has text, type, page_no, ocr_engine, confidence, cells and header_rows."""
    body = F.coalesce("text", F.lit(""))
    read = F.col("ocr_engine").isNotNull() & F.col("confidence").isNotNull()
    table = F.col("type") == "TABLE"
    got = blocks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(text.trimmed(body) != "").alias("filled"),
        F.round(F.avg(F.when(read, F.col("confidence"))), 5).alias("ocr_confidence"),
        F.sum(text.garbled_count(body)).alias("garbled"),
        F.sum(F.char_length(body)).alias("chars"),
        F.count_if(F.col("type") == "TITLE").alias("headings"),
        F.count_if(table).alias("tables"),
        F.count_if(table & malformed(F.col("cells"), F.col("header_rows"))).alias("malformed_tables"),
        F.array_sort(F.collect_set("page_no")).alias("pages"),
    )
    return got.withColumns({"observed_pages": F.size("pages"), "non_empty_ratio": ratio(F.col("filled"), F.col("blocks")), "garbled_ratio": ratio(F.col("garbled"), F.col("chars"))})


def chunk_metrics(chunks: DataFrame, *by: str) -> DataFrame:
    """Per document: children, those that repeat another, and those that are suppressed; ``chunks`` has granularity and dedup_status."""
    child, status = F.col("granularity") == "CHILD", F.col("dedup_status")
    return chunks.groupBy(*by).agg(F.count_if(child).alias("children"), F.count_if(child & (status != "UNIQUE")).alias("repeated"), F.count_if(child & (status == "SUPPRESSED_DUPLICATE")).alias("suppressed"))


def metrics(blocks: DataFrame, chunks: DataFrame, *by: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Both, and the share of children that repeat another; a document without chunks has none. ``carry``: columns of the blocks that depend on the document."""
    both = block_metrics(blocks, *by, *carry).join(chunk_metrics(chunks, *by), list(by), "left").na.fill(0, ["children", "repeated", "suppressed"])
    return both.withColumn("duplicate_ratio", ratio(F.col("repeated"), F.col("children")))


def missing_numbers(seen: Column, most: Column) -> Column:
    """The numbers 1..most that aren't in the array; nothing for most < 1."""
    return F.when(most < 1, F.array().cast("array<int>")).otherwise(F.array_except(F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int")), seen))


def verdict(measured: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add missing_pages, findings (codes, in the order of the rules) and verdict; ``measured`` also has expected_pages, owner_ok and version_ok."""
    c = F.col
    # The findings' codes.
    rules = [
        (~c("owner_ok"), "QUALITY_OWNER_MISSING"),
        (~c("version_ok"), "QUALITY_VERSION_CONFLICT"),
        (c("non_empty_ratio") < t.reject_non_empty, "QUALITY_PARSE_COVERAGE_CRITICAL"),
        ((c("non_empty_ratio") >= t.reject_non_empty) & (c("non_empty_ratio") < t.min_non_empty), "QUALITY_PARSE_COVERAGE_LOW"),
        (c("garbled_ratio") >= t.reject_garbled, "QUALITY_GARBLED_CRITICAL"),
        ((c("garbled_ratio") < t.reject_garbled) & (c("garbled_ratio") > t.max_garbled), "QUALITY_GARBLED_HIGH"),
        (c("ocr_confidence") < t.min_ocr, "QUALITY_OCR_CONFIDENCE_LOW"),
        (F.size("missing_pages") > 0, "QUALITY_MISSING_PAGES"),
        (c("malformed_tables") > 0, "QUALITY_TABLE_MALFORMED"),
        (c("duplicate_ratio") > t.max_duplicate, "QUALITY_DUPLICATE_RATIO_HIGH"),
        ((c("blocks") >= t.heading_after) & (c("headings") == 0), "QUALITY_STRUCTURE_WEAK"),
    ]
    measured = measured.withColumn("missing_pages", missing_numbers(F.col("pages"), F.col("expected_pages")))
    findings = F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in rules]))
    hard = F.arrays_overlap("findings", F.array(*[F.lit(x) for x in HARD]))
    return measured.withColumn("findings", findings).withColumn("verdict", F.when(hard, "REJECT").when(F.size("findings") > 0, "MANUAL_REVIEW").otherwise("PASS"))


def in_order(findings: DataFrame) -> DataFrame:
    """A report's findings: by severity as text, falling, then time and id."""
    return findings.orderBy(F.desc("severity"), "created_at", "id")


@dataclass(frozen=True)
class Limits:
    max_archive_depth: int = 1
    max_compression_ratio: float = 100.0
    max_pages: int = 2000
    max_total_pixels: int = 500_000_000
    max_table_cells: int = 5_000_000


def security_gate(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add findings and verdict to inspection rows; limits on what isn't known don't apply."""
    c = F.col
    packed, raw = c("compressed_size_bytes"), c("uncompressed_size_bytes")
    too_dense = F.when(packed == 0, raw > 0).otherwise(raw / packed > limits.max_compression_ratio)
    # The findings' codes.
    rejects = [
        (c("malware"), "MALWARE_DETECTED"), (c("encrypted"), "PASSWORD_PROTECTED"), (c("has_macros"), "ACTIVE_MACRO"),
        (c("archive_depth") > limits.max_archive_depth, "ARCHIVE_DEPTH_EXCEEDED"), (too_dense, "COMPRESSION_RATIO_EXCEEDED"),
        (c("page_count") > limits.max_pages, "PAGE_LIMIT_EXCEEDED"), (c("total_pixels") > limits.max_total_pixels, "PIXEL_LIMIT_EXCEEDED"),
        (c("table_cell_count") > limits.max_table_cells, "TABLE_CELL_LIMIT_EXCEEDED"),
    ]
    reviews = [(c("embedded_object_count") > 0, "EMBEDDED_OBJECT_FOUND"), (c("external_link_count") > 0, "EXTERNAL_LINK_FOUND")]
    findings = F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in rejects + reviews]))
    hard = F.arrays_overlap("findings", F.array(*[F.lit(n) for _, n in rejects]))
    return files.withColumn("findings", findings).withColumn("verdict", F.when(hard, "REJECTED").when(F.size("findings") > 0, "MANUAL_REVIEW").otherwise("CLEAN"))
