"""Ratios, limits and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The steps of an ingestion job and their weights.
STEP_WEIGHTS = {"SECURITY_SCAN": 8, "PARSE": 20, "OCR": 12, "NORMALIZE": 10, "CHUNK": 15, "QUALITY_GATE": 10, "EMBED": 12, "INDEX": 8, "VERIFY": 3, "PUBLISH": 2}


def ratio(part: Column, whole: Column, digits: int = 5) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, digits))


def clamp01(x: Column) -> Column:
    """Bounded to 0..1; what isn't finite is 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def part_count(size: Column, part: int, least: int = 5 << 20) -> Column:
    """Parts of an upload."""
    return F.ceil(size / max(part, least)).cast("long")


def upload_strategy(size: Column, threshold: int) -> Column:
    return F.when(size > threshold, "MULTIPART").otherwise("SINGLE")


def stage_percent(done: Column, total: Column) -> Column:
    """Null where the total isn't known."""
    return F.when(total.isNull() | (total <= 0), None).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * done / total)), 2))


def backoff_seconds(attempts: Column, most: int = 300, highest: int = 8) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2), F.least(attempts, F.lit(highest)))).cast("int")


def task_backoff_seconds(attempts: Column, first: int = 30, most: int = 3_600) -> Column:
    """Half a minute after the first attempt, twice as long after each further one, an hour at most."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(30)))).cast("int")
