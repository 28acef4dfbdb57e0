"""Texts to typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import ids, text


def _numbered(docs: DataFrame, parts: Column, *more: str) -> DataFrame:
    each, some = text.exploded(F.filter(parts, lambda p: p != ""), "pos", "text")
    found = docs.select("doc_id", *more, each).filter(some)
    return found.select("doc_id", *more, (F.col("pos") + 1).alias("ordinal"), "text")


def paragraphs(docs: DataFrame, by: str = r"(?:\r?\n){2,}", *more: str) -> DataFrame:
    """doc_id, more, ordinal (from 1), text: the parts of a text, normalised, blank ones left out."""
    return _numbered(docs, F.transform(F.split("text", by), text.normalize_block_text), *more)


def lines(docs: DataFrame) -> DataFrame:
    """Like paragraphs, a block for each line."""
    return lines_with(docs)


def lines_with(docs: DataFrame, *more: str) -> DataFrame:
    """Lines that carry columns of their document along."""
    # What a line may need is looked for once in the whole text, and a line end of one character is split at without a regex.
    t = F.col("text")
    spaced = F.when(t.contains("\t") | t.contains("  "), F.regexp_replace(t, "[\t ]{2,}|\t", " ")).otherwise(t)
    parts = F.transform(F.split(spaced, "\n"), text.trimmed)
    # a carriage return that is left is a line end inside a block
    parts = F.when(t.contains("\r"), F.transform(F.split(t, "\n"), text.normalize_block_text)).otherwise(parts)
    return _numbered(docs.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n"))), parts, *more)


# What a block may know of its place and its table; a parser fills in what it has.
POSITIONS = {
    "heading_level": "int", "page_no": "int", "sheet_name": "string", "slide_no": "int", "bbox": "struct<x1:double,y1:double,x2:double,y2:double>", "parent_block_id": "string",
    "cells": "array<array<string>>", "header_rows": "int", "merged_cells": "array<struct<row:int,column:int,row_span:int,column_span:int>>", "ocr_engine": "string", "confidence": "double",
}


def completed(blocks: DataFrame) -> DataFrame:
    """Blocks with every positional column; those they don't have are null."""
    return blocks.withColumns({c: F.lit(None).cast(t) for c, t in POSITIONS.items() if c not in blocks.columns})


def identified(blocks: DataFrame, version: Column, revision: int = 1) -> DataFrame:
    """Blocks with the hash of their content and their id; a block without a type is a paragraph."""
    kind = F.col("type") if "type" in blocks.columns else F.lit("PARAGRAPH")
    hashed = blocks.withColumn("content_sha256", ids.sha(kind, F.col("text")))
    return hashed.withColumn("block_id", ids.block_id(version, F.lit(revision), F.col("ordinal"), F.col("content_sha256")))


def reading_order(blocks: DataFrame, *by: str) -> DataFrame:
    """Number blocks by page or slide (null last), then top edge, left edge and position."""
    from pyspark.sql import Window

    place = F.coalesce("page_no", "slide_no")
    order = Window.partitionBy(*by).orderBy(place.asc_nulls_last(), F.col("y1").asc_nulls_last(), F.col("x1").asc_nulls_last(), "position")
    return blocks.withColumn("reading_ordinal", F.row_number().over(order))
