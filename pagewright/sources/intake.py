"""Files to blocks: integrity, detection, scanner, inspection and security gate, the parser of each format, and recognition.

A file that its parser can't read is a row with a code, whatever is wrong with it; the other files of the batch aren't touched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators import ocr, quality
from pagewright.operators.blocks import completed, identified, paragraphs
from pagewright.shared import batches_of, write_shared
from pagewright.sources import files, markup, office, pdf

TEXTS = {"HTML": markup.html_blocks_of, "MARKDOWN": markup.markdown_blocks_of, "CSV": markup.csv_blocks_of}
APART = (*office.PARSERS, "PDF")  # formats that a parser must open before the gate
EMBEDS = r"<(?i:object|embed|iframe)[\s/>]"
CELLS = r"<(?i:td|th)[\s/>]"


@dataclass(frozen=True)
class Intake:
    """Limits of the intake."""

    most_bytes: int = 256 << 20
    limits: quality.Limits = quality.Limits()
    batch: int = 256  # files that a task's Python holds at a time
    least_coverage: float = 0.02  # pages whose text covers less are to be recognised


class Processed(NamedTuple):
    """What became of the files of a batch."""

    outcomes: DataFrame  # doc_id, format, outcome (COMPLETED, MANUAL_REVIEW, REJECTED or FAILED), code, warnings, n_blocks
    blocks: DataFrame  # of completed files, as the chunk builder takes them
    targets: DataFrame  # doc_id, page_no, target, origin: what is to be recognised


def checked(rows: DataFrame, intake: Intake = Intake()) -> DataFrame:
    """``rows`` (doc_id, file_name, declared_mime, declared_size, declared_sha256, content) with what detection and scanner say: format, warnings, code, outcome.

    Code and outcome are null for files that may be parsed.
    """
    header = F.substring("content", 1, files.HEADER)
    rows = rows.withColumns({"size_bytes": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "found": files.detection(header, F.col("file_name"))})
    mime = files.mime_issue(F.col("declared_mime"), F.col("found.format"))
    changed = F.when(F.col("size_bytes") != F.col("declared_size"), "OBJECT_SIZE_CHANGED").when(F.col("sha256") != F.col("declared_sha256"), "OBJECT_HASH_CHANGED")
    failed = F.coalesce(changed, F.col("found.code"), F.when(mime == "MIME_MAGIC_MISMATCH", mime))
    infected = files.malware(F.col("content"))
    large = F.when(F.col("size_bytes") > intake.most_bytes, "PARSER_INPUT_TOO_LARGE")
    code = F.coalesce(failed, F.when(infected, "MALWARE_DETECTED"), large)
    outcome = F.when(failed.isNotNull(), "FAILED").when(infected, "REJECTED").when(large.isNotNull(), "FAILED")
    return rows.select("doc_id", "file_name", "content", "sha256", F.col("found.format").alias("format"), F.when(F.col("found.format").isNotNull() & (mime == "DECLARED_MIME_GENERIC"), F.array(mime)).otherwise(F.array().cast("array<string>")).alias("warnings"), code.alias("code"), outcome.alias("outcome"))


def _seen_at_once() -> dict[str, Column]:
    """What ``inspection`` says of files that no parser need open, of their own row's format and content."""
    none = lambda t: F.lit(None).cast(t)
    page = F.when(F.col("format") == "HTML", files.decoded(F.col("content")))
    urls = F.regexp_extract_all(page, F.lit(markup.LINK), F.lit(1))
    leaving = F.size(F.filter(urls, lambda u: markup.leaves(F.substring(u, F.lit(2), F.length(u) - 2))))
    return {
        "issue": none("string"), "encrypted": F.lit(False), "has_macros": F.lit(False), "embedded_object_count": F.coalesce(F.regexp_count(page, F.lit(EMBEDS)), F.lit(0)),
        "external_link_count": F.coalesce(leaving, F.lit(0)), "archive_depth": none("int"), "compressed_size_bytes": none("long"), "uncompressed_size_bytes": none("long"),
        "table_cell_count": F.regexp_count(page, F.lit(CELLS)).cast("long"), "total_pixels": files.image_size(F.col("content"))["width"] * files.image_size(F.col("content"))["height"], "page_count": none("int"),
    }


def inspection(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """What the security gate asks of files (doc_id, format, content): counts of objects, links, pages and cells, and what archives hold; ``issue`` says why a file can't be read."""
    plain = rows.filter(~F.col("format").isin(*APART)).select("doc_id", *[c.alias(n) for n, c in _seen_at_once().items()])
    packed = office.inspected(rows.filter(F.col("format").isin(*office.PARSERS)).select(F.col("doc_id").cast("string").alias("path"), "format", "content"))
    packed = packed.select(F.col("path").cast(rows.schema["doc_id"].dataType).alias("doc_id"), *[c for c in packed.columns if c != "path"])
    refused = pages.filter("code IS NOT NULL").select("doc_id", F.col("code").alias("issue"), F.lit(0).alias("embedded_object_count"))
    paged = pdf.inspection(rows.filter("format = 'PDF'"), pages).unionByName(refused, allowMissingColumns=True).withColumns({"encrypted": F.lit(False), "has_macros": F.lit(False)})
    return plain.unionByName(packed, allowMissingColumns=True).unionByName(paged, allowMissingColumns=True).withColumn("malware", F.lit(False))


def blocks(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of files (doc_id, format, content) by the parser of their format, in their order, with file_format; a row with a code instead of a type for those that can't be read."""
    text = rows.filter(F.col("format").isin(*TEXTS, "TEXT")).select("doc_id", "format", files.decoded(F.col("content")).alias("text"))
    of = lambda found, name: found.withColumn("file_format", F.lit(name))
    parts = [of(markup.blocks(text.filter(F.col("format") == name), parse), name) for name, parse in TEXTS.items()]
    parts.append(of(paragraphs(text.filter("format = 'TEXT'")).withColumn("type", F.lit("PARAGRAPH")), "TEXT"))
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 1.0), ("y2", 1.0))])
    image = rows.filter("format = 'IMAGE'").select("doc_id", F.lit(1).alias("ordinal"), F.lit("IMAGE").alias("type"), F.lit("").alias("text"), F.lit(1).alias("page_no"), box.alias("bbox"))
    packed = rows.filter(F.col("format").isin(*office.PARSERS))
    archives = office.parsed(packed).join(packed.select("doc_id", F.col("format").alias("file_format")), "doc_id")
    paged = pdf.blocks(pages.join(rows.filter("format = 'PDF'").select("doc_id"), "doc_id", "left_semi"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [archives, *parts, of(image, "IMAGE"), of(paged, "PDF")])


def process(rows: DataFrame, intake: Intake = Intake(), recognise: Callable[[DataFrame], DataFrame] | None = None) -> Processed:
    """Every file from its bytes to its outcome.

    ``recognise`` gets the targets of a batch (doc_id, page_no, target) and returns blocks (doc_id, page_no, text, ocr_engine,
    confidence); those of a whole page replace the parser's. Without it targets are only listed, and their files say so. Whatever
    runs Python is written here, in batches of ``intake.batch`` files.
    """
    with batches_of(rows.sparkSession, intake.batch):
        return _processed(rows, intake, recognise)


def _processed(rows: DataFrame, intake: Intake, recognise: Callable[[DataFrame], DataFrame] | None) -> Processed:
    def gated() -> tuple[Column, Column]:
        gate = F.when(F.col("issue").isNotNull(), "FAILED").when(F.col("verdict") == "CLEAN", "COMPLETED").otherwise(F.col("verdict"))
        return gate.alias("gate"), F.coalesce("issue", F.get("findings", F.lit(0))).alias("gate_code")

    # most formats pass the gate by what their own row says, so that their content isn't sent to meet its verdict
    apart = F.col("format").isin(*APART)
    first = checked(rows, intake)
    names, may = first.columns, F.col("outcome").isNull() & ~apart
    looked = quality.security_gate(first.withColumns(_seen_at_once() | {"malware": F.lit(False)}), intake.limits)
    seen = write_shared(looked.select(*names, *[F.when(may, c).alias(n) for n, c in zip(("gate", "gate_code"), gated(), strict=True)]), "intake-checked")
    held = seen.filter("outcome IS NULL")
    closed = held.filter(apart).select("doc_id", "format", "content")
    pages = write_shared(pdf.pages(closed.filter("format = 'PDF'"), intake.limits.max_pages), "intake-pages")
    opened = quality.security_gate(inspection(closed, pages), intake.limits)
    judged = write_shared(held.filter(~apart).select("doc_id", "gate", "gate_code").unionByName(opened.select("doc_id", *gated())), "intake-judged")
    seen = seen.drop("gate", "gate_code")
    good = held.filter(~apart & (F.col("gate") == "COMPLETED")).select("doc_id", "format", "content")
    good = good.unionByName(closed.join(judged.filter("gate = 'COMPLETED'").select("doc_id"), "doc_id", "left_semi"))
    parsed = completed(blocks(good, pages))
    read = pages.join(good.filter("format = 'PDF'").select("doc_id"), "doc_id", "left_semi")
    whole = good.filter("format = 'IMAGE'").select("doc_id", F.lit(1).alias("page_no"), F.lit("WHOLE_IMAGE").alias("target"))
    targets = write_shared(ocr.targets(whole.unionByName(pdf.targets(read).select("doc_id", "page_no", "target")), pdf.coverage(read), intake.least_coverage), "intake-targets")
    if recognise is not None:
        found = recognise(targets.select("doc_id", "page_no", "target")).withColumns({"type": F.lit("PARAGRAPH"), "ordinal": F.lit(None).cast("int")})
        found = found.select([F.col(c) if c in found.columns else F.lit(None).cast(t).alias(c) for c, t in parsed.dtypes])
        both = ocr.replace(parsed, found, targets).drop("origin")
        # files that were recognised are numbered anew, by page and then as they came
        order = Window.partitionBy("doc_id").orderBy(F.col("page_no").asc_nulls_last(), F.col("ordinal").asc_nulls_last(), "text")
        again = both.join(found.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("ordinal", F.row_number().over(order))
        parsed = both.join(found.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(again)
        parsed = parsed.drop("file_format").join(seen.select("doc_id", F.col("format").alias("file_format")), "doc_id")
    done = write_shared(identified(parsed, F.col("doc_id")), "intake-blocks")
    broken = done.filter("code IS NOT NULL").select("doc_id", F.col("code").alias("broken"))
    counts = done.filter("code IS NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    waiting = targets.select("doc_id").distinct().withColumn("waiting", F.lit(recognise is None))
    outcomes = seen.drop("content").join(judged, "doc_id", "left").join(broken, "doc_id", "left").join(counts, "doc_id", "left").join(waiting, "doc_id", "left")
    said: Column = F.coalesce("outcome", F.when(F.col("broken").isNotNull(), "FAILED"), "gate")
    warned = F.when(F.col("waiting"), F.array_append("warnings", "RECOGNITION_REQUIRED")).otherwise(F.col("warnings"))
    outcomes = outcomes.select("doc_id", "format", said.alias("outcome"), F.coalesce("code", "broken", "gate_code").alias("code"), warned.alias("warnings"), F.coalesce("n", F.lit(0)).alias("n_blocks"))
    return Processed(outcomes, done.filter("code IS NULL").drop("code"), targets)
