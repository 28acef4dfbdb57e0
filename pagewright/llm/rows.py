"""Rows of a frame under names that none of its own columns can clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.shared import write_shared


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` as it is if it is a plain scan of Parquet files, else a copy of it in the shared folder.

    Only in a plain scan do a file and a row number surely name one row, and of all formats only Parquet numbers its rows.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
        if plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
            return docs
    return write_shared(docs, "input")


def placed(docs: DataFrame) -> DataFrame:
    """``(at, doc)`` of a scan of files: where each row lies, and all its columns in one struct."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("at"), F.struct("*").alias("doc"))
