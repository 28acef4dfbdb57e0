"""Headings, kinds and boundaries of blocks, as running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text

# How clauses and questions begin, on trimmed texts.
CLAUSE = r"^(?:第[一二三四五六七八九十百千0-9]+[编章节条款项]|[0-9]+(?:\.[0-9]+)+[.、\s])"
QUESTION = r"^(?:[Qq]|问|问题)\s*[:：]"
LEVELS = 6


def _upto(*by: str):
    return Window.partitionBy(*by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _with_titles(blocks: DataFrame) -> DataFrame:
    """Add __title and __level, which only titles have."""
    titled = F.col("type") == "TITLE"
    named = text.trimmed(F.coalesce("text", F.lit("")))
    title = F.when(named == "", F.concat(F.lit("未命名标题 "), F.col("ordinal").cast("string"))).otherwise(named)
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(1))))
    return blocks.withColumns({"__title": F.when(titled, title), "__level": F.when(titled, level)})


def _slots(w) -> dict[str, Column]:
    """The newest title of each level."""
    here = F.struct(F.col("ordinal").alias("o"), F.col("__title").alias("t"))
    return {f"__s{k}": F.max(F.when(F.col("__level") == k, here)).over(w) for k in range(1, LEVELS + 1)}


def _with_path(rows: DataFrame) -> DataFrame:
    slots: list[Column] = []
    newest = F.lit(-1).cast("long")
    for k in range(1, LEVELS + 1):
        here = F.col(f"__s{k}")
        slots.append(F.when(here["o"] > newest, here["t"]))
        newest = F.greatest(newest, here["o"].cast("long"))
    return rows.withColumn("heading_path", F.array_compact(F.array(*slots))).drop("__title", "__level", *[f"__s{k}" for k in range(1, LEVELS + 1)])


def _with_signs(blocks: DataFrame) -> DataFrame:
    """Add __blank, __clause and __question: all that kinds needs to know of the texts."""
    t, body = F.col("type"), F.col("__body")
    other = t.isin("TITLE", "HEADER", "FOOTER", "FOOTNOTE", "TABLE", "TABLE_ROW", "CODE")
    # few texts begin with a character that a clause or a question begins with, and only these are looked at by regex
    first = F.left(body, F.lit(1))
    clause = F.when(other, False).otherwise(first.isin("第", *"0123456789") & body.rlike(CLAUSE))
    question = ~other & first.isin("Q", "q", "问") & body.rlike(QUESTION)
    rows = blocks.withColumn("__body", text.trimmed(F.coalesce("text", F.lit(""))))
    return rows.withColumns({"__blank": body == "", "__clause": clause, "__question": question}).drop("__body")


def _marks(w) -> dict[str, Column]:
    """The newest question, its end, and the newest title."""
    t, here = F.col("type"), F.struct("ordinal", "block_id")
    plain = ~t.isin("TITLE", "HEADER", "FOOTER", "FOOTNOTE", "TABLE", "TABLE_ROW", "CODE")
    return {
        "__asked": F.max(F.when(plain & ~F.col("__clause") & F.col("__question"), here)).over(w),
        "__ended": F.max(F.when(t.isin("TITLE", "TABLE", "TABLE_ROW", "CODE") | (plain & F.col("__clause")), F.col("ordinal"))).over(w),
        "__titled": F.max(F.when(t == "TITLE", here)).over(w),
    }


def _with_kinds(rows: DataFrame) -> DataFrame:
    t, clause = F.col("type"), F.col("__clause")
    faq = F.col("__asked").isNotNull() & (F.col("__asked.ordinal") > F.coalesce("__ended", F.lit(-1)))
    kind = (
        F.when(t == "TITLE", "TITLE").when(t.isin("HEADER", "FOOTER"), "DECORATION").when(t == "FOOTNOTE", "FOOTNOTE")
        .when(t.isin("TABLE", "TABLE_ROW"), "TABLE").when(t == "CODE", "CODE").when(clause, "CLAUSE").when(faq, "FAQ")
        .when(t == "LIST", "LIST").otherwise("PROSE")
    )
    k = F.col("kind")
    boundary = (
        F.when(k == "TABLE", F.concat(F.lit("table:"), F.coalesce("parent_block_id", "block_id")))
        .when(k == "FAQ", F.concat(F.lit("faq:"), F.col("__asked.block_id")))
        .when(k.isin("DECORATION", "FOOTNOTE", "CODE", "CLAUSE"), F.concat_ws(":", F.lower(k), "block_id"))
        .when((k != "TITLE") & (F.coalesce("sheet_name", F.lit("")) != ""), F.concat(F.lit("sheet:"), F.col("sheet_name")))
        .when((k != "TITLE") & (F.coalesce("slide_no", F.lit(0)) != 0), F.concat(F.lit("slide:"), F.col("slide_no").cast("string")))
        .otherwise(F.coalesce(F.concat(F.lit("heading:"), F.col("__titled.block_id")), F.lit("document-root")))
    )
    include = F.when(k.isin("TITLE", "DECORATION", "FOOTNOTE"), False).when(k.isin("TABLE", "CODE", "CLAUSE", "FAQ"), True).otherwise(~F.col("__blank"))
    return rows.withColumn("kind", kind).withColumns({"boundary": boundary, "include": include}).drop("__asked", "__ended", "__titled", "__blank", "__clause", "__question")


def heading_stack(blocks: DataFrame, *by: str) -> DataFrame:
    """Add heading_path. A title of level L cuts the stack to L levels; slot k counts only if it is younger than all slots above it."""
    return _with_path(_with_titles(blocks).withColumns(_slots(_upto(*by))))


def kinds(blocks: DataFrame, *by: str) -> DataFrame:
    """Add kind, boundary and include; ``blocks`` also has block_id, parent_block_id, sheet_name and slide_no.

    An answer belongs to the question before it until a title, table, code or clause. Other texts belong to their sheet, their
    slide, or the title before them.
    """
    return _with_kinds(_with_signs(blocks).withColumns(_marks(_upto(*by))))


def outlined(blocks: DataFrame, *by: str) -> DataFrame:
    """``kinds(heading_stack(blocks))`` by one window. Texts are read before the rows are dealt out and sorted, so that a use that doesn't return them doesn't send them."""
    w = _upto(*by)
    return _with_kinds(_with_path(_with_signs(_with_titles(blocks)).withColumns(_slots(w) | _marks(w))))


def compatible_kind(kind: Column, file_format: Column) -> Column:
    """Blocks are packed together if they are of one boundary and have this in common."""
    return F.when(kind.isin("TABLE", "CODE", "CLAUSE", "FAQ"), kind).when(file_format == "PPTX", "SLIDE").when(file_format.isin("XLSX", "CSV"), "SHEET").otherwise(kind)


def content_type(kind: Column, file_format: Column) -> Column:
    """What a chunk of these blocks is called."""
    own = kind.isin("TABLE", "CODE", "CLAUSE", "FAQ", "LIST")
    return F.when(own, kind).when(file_format == "PPTX", "SLIDE").when(file_format.isin("XLSX", "CSV"), "SHEET").otherwise("PROSE")


def islands(rows: DataFrame, key: Column, by: list[str], order: list[str]) -> DataFrame:
    """Add island: a number that grows where ``key`` changes from one row to the next."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = ~key.eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__new", changed.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def carried(rows: DataFrame, opens: Column, closes: Column, by: list[str], order: str) -> DataFrame:
    """Add opened: the order value of the opener that is still open, else null."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened, closed = F.max(F.when(opens, F.col(order))).over(w), F.max(F.when(closes, F.col(order))).over(w)
    return rows.withColumn("opened", F.when(opened > F.coalesce(closed, opened - 1), opened))
