"""Keyset pages, cursors and firsts of groups."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, newest: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """One page in descending order of (newest, key), and the row after it, by which a next page is known to exist."""
    if after is not None:
        rows = rows.filter(F.struct(newest, key) < F.struct(F.lit(after[0]).cast(rows.schema[newest].dataType), F.lit(after[1]).cast(rows.schema[key].dataType)))
    return rows.orderBy(F.desc(newest), F.desc(key)).limit(size + 1)


def ordinal_page(rows: DataFrame, ordinal: str, size: int, after: int = 0) -> DataFrame:
    return rows.filter(F.col(ordinal) > after).orderBy(ordinal).limit(size + 1)


def cursor(*columns: str) -> Column:
    """A row's cursor: its keys as JSON in base64url."""
    text = F.base64(F.to_json(F.struct(*columns)).cast("binary"))
    return F.regexp_replace(F.translate(text, "+/", "-_"), "[=\r\n]", "")


def read_cursor(text: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))


def firsts(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def latest(rows: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """The last row of each group, by partial aggregation."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("x")).select(*by, "x.*")


def containing(column: str, pattern: str) -> Column:
    """Case-insensitive containment; the pattern's % and _ keep their meaning."""
    return F.col(column).ilike(f"%{pattern}%")


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that have the wanted values; a value that is None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def recent(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Each key's newest ``n`` rows, numbered (place) from the oldest of them."""
    w = Window.partitionBy(*by)
    kept = rows.withColumn("__n", F.row_number().over(w.orderBy(F.desc(order)))).filter(F.col("__n") <= n).drop("__n")
    return kept.withColumn("place", F.row_number().over(w.orderBy(order)))


# How texts of some columns must look.
CHECKS = {"sha256": "^[0-9a-f]{64}$", "event_type": "^[a-z][a-z0-9_.-]{1,99}$", "code": "^[a-z][a-z0-9]*(-[a-z0-9]+)*$", "collection": "^[A-Za-z_][A-Za-z0-9_]{0,254}$"}


def unfit(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add unfit: the columns whose value doesn't look as the check named for it asks; nulls pass."""
    tests = [F.when(~F.col(c).rlike(CHECKS[check]), F.lit(c)) for c, check in columns.items()]
    return rows.withColumn("unfit", F.array_compact(F.array(*tests)))
