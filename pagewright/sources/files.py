"""Files as rows: detection of their format, the content scanner and decoding, as expressions on ``spark.read.format("binaryFile")``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text

# Magic numbers, extensions and media types.
IMAGES = (("PNG", "89504E470D0A1A0A"), ("JPEG", "FFD8FF"), ("GIF", "47494638"), ("TIFF", "49492A00"), ("TIFF", "4D4D002A"), ("BMP", "424D"))
EXTENSIONS = {
    "pdf": "PDF", "docx": "DOCX", "xlsx": "XLSX", "pptx": "PPTX", "html": "HTML", "htm": "HTML", "md": "MARKDOWN",
    "markdown": "MARKDOWN", "txt": "TEXT", "csv": "CSV", "png": "IMAGE", "jpg": "IMAGE", "jpeg": "IMAGE", "gif": "IMAGE",
    "tif": "IMAGE", "tiff": "IMAGE", "bmp": "IMAGE", "webp": "IMAGE",
}
OFFICE = "application/vnd.openxmlformats-officedocument."
TYPES = {
    "PDF": ("application/pdf",),
    "DOCX": (OFFICE + "wordprocessingml.document",),
    "XLSX": (OFFICE + "spreadsheetml.sheet",),
    "PPTX": (OFFICE + "presentationml.presentation",),
    "HTML": ("text/html",),
    "MARKDOWN": ("text/markdown", "text/plain"),
    "TEXT": ("text/plain",),
    "CSV": ("text/csv", "text/plain"),
    "IMAGE": ("image/png", "image/jpeg", "image/gif", "image/tiff", "image/bmp", "image/webp"),
}
EXECUTABLES = ("4D5A", "7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "2321")
HEADER = 8192
EICAR = "EICAR-STANDARD-ANTIVIRUS-TEST-FILE"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def observed(files: DataFrame) -> DataFrame:
    """Add file_name, sha256, size_bytes and the first 8 KiB."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"file_name": name, "sha256": F.sha2("content", 256), "size_bytes": F.octet_length("content").cast("long"), "header": F.substring("content", 1, HEADER)})


def integrity(files: DataFrame) -> DataFrame:
    """Add issue: what changed against the declared size and hash, or null."""
    issue = F.when(F.col("size_bytes") != F.col("declared_size"), "OBJECT_SIZE_CHANGED").when(F.col("sha256") != F.col("declared_sha256"), "OBJECT_HASH_CHANGED")
    return files.withColumn("issue", issue)


def _begins(content: Column, magic: str) -> Column:
    return F.startswith(content, F.to_binary(F.lit(magic), F.lit("hex")))


def image_kind(header: Column) -> Column:
    kind = F.when(_begins(header, "52494646") & (F.substring(header, 9, 4) == F.lit(b"WEBP")), "WEBP")
    for name, magic in IMAGES:
        kind = kind.when(_begins(header, magic), name)
    return kind


def detection(header: Column, file_name: Column) -> Column:
    """A struct of the format that content and extension agree on (or null) and, where a file is refused, why."""
    extension = F.lower(F.element_at(F.split(file_name, r"\."), -1))
    named = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension]
    # a header of full length may end inside a character
    whole = [F.is_valid_utf8(F.substring(header, F.lit(1), F.length(header) - n).cast("string")) for n in range(4)]
    textual = (whole[0] | (F.length(header) == HEADER) & (whole[1] | whole[2] | whole[3])) & ~F.contains(header, F.lit(b"\x00"))
    page = F.lower(text.trimmed(header.cast("string"))).rlike(r"^(<!doctype html|<html)")

    def said(name: Column | None = None, code: str | None = None) -> Column:
        return F.struct((F.lit(None).cast("string") if name is None else name).alias("format"), F.lit(code).cast("string").alias("code"))

    # Why a file is refused.
    return (
        F.when(_begins(header, "255044462D"), F.when(named == "PDF", said(named)).otherwise(said(code="EXTENSION_MAGIC_MISMATCH")))
        .when(_begins(header, "504B0304"), F.when(named.isin("DOCX", "XLSX", "PPTX"), said(named)).otherwise(said(code="UNSUPPORTED_ZIP_CONTAINER")))
        .when(image_kind(header).isNotNull(), F.when(named == "IMAGE", said(named)).otherwise(said(code="EXTENSION_MAGIC_MISMATCH")))
        .when(~textual, said(code="UNSUPPORTED_BINARY_FORMAT"))
        .when(named == "HTML", F.when(page, said(named)).otherwise(said(code="HTML_SIGNATURE_MISMATCH")))
        .when(named.isin("MARKDOWN", "TEXT", "CSV"), said(named))
        .otherwise(said(code="UNSUPPORTED_TEXT_EXTENSION"))
    )


def file_format(header: Column, file_name: Column) -> Column:
    """The format that content and extension agree on, else null."""
    return detection(header, file_name)["format"]


def mime_issue(declared: Column, detected: Column) -> Column:
    """DECLARED_MIME_GENERIC for an empty or generic type, MIME_MAGIC_MISMATCH for one that the format doesn't have."""
    base = F.trim(F.lower(F.split_part(F.coalesce(declared, F.lit("")), F.lit(";"), F.lit(1))))
    accepted = F.create_map(*[x for f, types in TYPES.items() for x in (F.lit(f), F.array(*[F.lit(t) for t in types]))])[detected]
    return F.when(base.isin("", "application/octet-stream"), "DECLARED_MIME_GENERIC").when(~F.array_contains(accepted, base), "MIME_MAGIC_MISMATCH")


def malware(content: Column) -> Column:
    """The test signature anywhere, or an executable's beginning."""
    found = F.contains(content, F.lit(EICAR.encode()))
    for magic in EXECUTABLES:
        found = found | _begins(content, magic)
    return found


def decoded(content: Column) -> Column:
    """UTF-8 with or without mark, UTF-16 with mark; null for anything else."""
    return (
        F.when(_begins(content, "EFBBBF"), F.try_validate_utf8(F.substring(content, 4, F.lit(2**31 - 1)).cast("string")))
        .when(_begins(content, "FFFE"), F.decode(F.substring(content, 3, F.lit(2**31 - 1)), "UTF-16LE"))
        .when(_begins(content, "FEFF"), F.decode(F.substring(content, 3, F.lit(2**31 - 1)), "UTF-16BE"))
        .otherwise(F.try_validate_utf8(content.cast("string")))
    )


def _number(content: Column, at: int, n: int, little: bool = False) -> Column:
    """An unsigned number of n bytes at an offset."""
    digits = F.hex(F.substring(content, at + 1, n))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("long")


def image_size(content: Column) -> Column:
    """struct(width, height) of PNG, GIF and BMP; null otherwise."""
    png = F.struct(_number(content, 16, 4).alias("width"), _number(content, 20, 4).alias("height"))
    gif = F.struct(_number(content, 6, 2, True).alias("width"), _number(content, 8, 2, True).alias("height"))
    bmp = F.struct(_number(content, 18, 4, True).alias("width"), _number(content, 22, 4, True).alias("height"))
    kind = image_kind(content)
    return F.when(kind == "PNG", png).when(kind == "GIF", gif).when(kind == "BMP", bmp)
