"""Decisions on chunks and pages: eligibility, review, line bands and low-confidence issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(granularity: Column, dedup_status: Column, verdict: Column, review: Column) -> Column:
    """Whether a chunk may be indexed: a child that isn't a suppressed duplicate, of a document that passed or was approved."""
    good = (verdict == "PASS") | F.coalesce(review == "APPROVED", F.lit(False))
    return (granularity == "CHILD") & (dedup_status != "SUPPRESSED_DUPLICATE") & good & (verdict != "REJECT")


def decided(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reports with their latest review; a rejected document can't be approved, and a reviewer isn't the owner."""
    last = reviews.groupBy("report_id").agg(F.max_by(F.struct("decision", "reviewer"), "decided_at").alias("r"))
    both = reports.join(last, "report_id", "left").withColumns({"decision": F.col("r.decision"), "reviewer": F.col("r.reviewer")}).drop("r")
    issue = F.when((F.col("verdict") == "REJECT") & (F.col("decision") == "APPROVED"), "REJECTED_NOT_APPROVABLE").when(F.col("reviewer") == F.col("owner"), "SELF_REVIEW")
    return both.withColumn("issue", issue).withColumn("decision", F.when(F.col("issue").isNull(), F.col("decision")))


def line_bands(lines: DataFrame, *by: str) -> DataFrame:
    """Add y1 and y2: a page's lines as bands of equal height."""
    w = Window.partitionBy(*by)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("position"))
    return lines.withColumns({"y1": (i - 1) / n, "y2": i / n})


def issues(warnings: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """doc_id, code, block: a document's warnings and its recognised blocks of low confidence."""
    own = warnings.select("doc_id", F.explode("warnings").alias("code"), F.lit(None).cast("int").alias("block"))
    low = blocks.filter(F.col("ocr_engine").isNotNull() & (F.col("confidence") < least)).select("doc_id", F.lit("OCR_LOW_CONFIDENCE").alias("code"), F.col("ordinal").alias("block"))
    return own.unionByName(low)


def summary_fits(summary: Column, most: int = 16_384) -> Column:
    """Whether a summary's JSON is within its limit."""
    return F.octet_length(F.to_json(summary)) <= most


# What of a profile an embedder must agree with, and what it must be able to do.
PROFILE_FIELDS = ("modelId", "revision", "protocolVersion", "tokenizerRevision", "denseDimension", "normalizeDense", "sparseFormatVersion")
CAPABILITIES = ("query", "document", "dense")


def profile_mismatches(profiles: DataFrame, providers: DataFrame) -> DataFrame:
    """profile, mismatches: the fields in which a profile and its provider differ, and the capabilities that are lacking.

    Both have profile, the fields and maxInputTokens; providers also have capabilities. Input limits may be larger than asked.
    """
    a, b = profiles.alias("a"), providers.alias("b")
    has = F.col("b.capabilities")
    tests = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in PROFILE_FIELDS]
    tests.append(F.when(F.col("a.maxInputTokens") > F.col("b.maxInputTokens"), "maxInputTokens"))
    tests += [F.when(~F.array_contains(has, c), F.lit(f"capability:{c}")) for c in CAPABILITIES]
    tests.append(F.when((F.coalesce("a.sparseFormatVersion", F.lit("")) != "") & ~F.array_contains(has, "sparse"), "capability:sparse"))
    return a.join(b, F.col("a.profile") == F.col("b.profile")).select(F.col("a.profile").alias("profile"), F.array_compact(F.array(*tests)).alias("mismatches"))


def reviewed(verdict: Column, current: Column, action: Column) -> Column:
    """struct(decision, issue) of a reviewer's action: only open reports that didn't pass are decided, and a rejected one can't be approved."""
    issue = F.when(~current.isin("PENDING", "NOT_REQUIRED"), "ALREADY_DECIDED").when(verdict == "PASS", "NOT_NEEDED").when((verdict == "REJECT") & (action == "APPROVE"), "REJECTED_NOT_APPROVABLE")
    new = F.when(action == "APPROVE", "APPROVED").when(action == "REJECT", "REJECTED").otherwise("REPROCESS_REQUESTED")
    return F.struct(F.when(issue.isNull(), new).otherwise(current).alias("decision"), issue.alias("issue"))


def slide_number(name: Column) -> Column:
    """The number in a part's name, for natural order."""
    return F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).cast("int")


def metric_totals(events: DataFrame, *by: str) -> DataFrame:
    """Counters: how many events of each kind, and the sum of their values."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
