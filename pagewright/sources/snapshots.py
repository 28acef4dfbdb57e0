"""Sinks and scans of versioned tables: block snapshots and vectors by manifest, as partitioned Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or an empty one."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return like.limit(0)


def put_snapshots(blocks: DataFrame, path: str) -> None:
    """Write blocks by (document_version_id, content_revision); revisions whose content is there already are skipped.

    A revision's content is a hash over its blocks' hashes in any order, so no task holds a revision.
    """
    keys = ["document_version_id", "content_revision"]

    def contents(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("ordinal", "content_sha256")).alias("h"))

    there = existing(blocks.sparkSession, path, blocks)
    new = contents(blocks).join(contents(there), [*keys, "n", "h"], "left_anti").select(*keys)
    overwrite(blocks.join(new, keys, "left_semi"), path, *keys)


def overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``rows`` has, and no others; repeating it changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def put_vectors(records: DataFrame, path: str) -> None:
    """Write vectors by manifest; of records with one vector_id one stays."""
    overwrite(records.dropDuplicates(["manifest_id", "vector_id"]), path, "manifest_id")


def scan_vectors(spark: SparkSession, path: str, manifest: str, *columns: str) -> DataFrame:
    """One manifest's rows, by partition and column pruning."""
    return spark.read.parquet(path).filter(F.col("manifest_id") == manifest).select(*(columns or ("vector_id", "content_sha256", "embedding_profile_id")))


def drop_vectors(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows of all manifests but the given ones."""
    return records.join(manifests.select("manifest_id").distinct(), "manifest_id", "left_anti")


# How an external layout parser names its items.
LABELS = {"title": "TITLE", "section_header": "TITLE", "paragraph": "PARAGRAPH", "text": "PARAGRAPH", "list_item": "LIST", "code": "CODE", "caption": "CAPTION", "footnote": "FOOTNOTE", "page_header": "HEADER", "page_footer": "FOOTER"}
LAYOUT = "texts array<struct<label:string,text:string,level:int,prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>>>, pages map<string,struct<size:struct<width:double,height:double>>>"


def layout_blocks(results: DataFrame) -> DataFrame:
    """doc_id, ordinal, type, text, heading_level, page_no, bbox of an external layout parser's JSON (``doc_id``, ``json``).

    Boxes measured from the bottom are turned over; all are scaled to 0..1 with the origin at the top left.
    """
    from pagewright.functions.numbers import clamp01

    parsed = results.select("doc_id", F.from_json("json", f"struct<{LAYOUT.replace('texts ', 'texts:').replace('pages ', 'pages:')}>").alias("j"))
    items = parsed.select("doc_id", F.posexplode("j.texts").alias("at", "x"), F.col("j.pages").alias("pages"))
    names = F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair])
    place = F.element_at("x.prov", 1)
    size = F.col("pages")[place["page_no"].cast("string")]["size"]
    box = place["bbox"]
    up = box["coord_origin"] == "BOTTOMLEFT"
    top, bottom = F.when(up, size["height"] - box["t"]).otherwise(box["t"]), F.when(up, size["height"] - box["b"]).otherwise(box["b"])
    scaled = F.struct(clamp01(box["l"] / size["width"]).alias("x1"), clamp01(top / size["height"]).alias("y1"), clamp01(box["r"] / size["width"]).alias("x2"), clamp01(bottom / size["height"]).alias("y2"))
    kind = F.coalesce(names[F.col("x.label")], F.lit("PARAGRAPH"))
    return items.select("doc_id", (F.col("at") + 1).alias("ordinal"), kind.alias("type"), F.col("x.text").alias("text"), F.when(kind == "TITLE", F.coalesce("x.level", F.lit(1))).alias("heading_level"), place["page_no"].alias("page_no"), F.when(box.isNotNull(), scaled).alias("bbox"))
