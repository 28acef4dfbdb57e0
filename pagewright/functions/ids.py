"""Deterministic identifiers and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def block_id(version: Column, revision: Column, ordinal: Column, content_sha: Column) -> Column:
    text = F.concat_ws(":", version.cast("string"), revision.cast("string"), ordinal.cast("string"), content_sha)
    return F.concat(F.lit("block-"), F.left(F.sha2(text, 256), F.lit(32)))


def chunk_id(version: Column, revision: Column, granularity: Column, block_ids: Column, part: Column, embedding_text: Column) -> Column:
    """The part's number is hashed too, so that equal parts of one block differ."""
    return chunk_id_of(version, revision, granularity, block_ids, part, F.sha2(embedding_text, 256))


def chunk_id_of(version: Column, revision: Column, granularity: Column, block_ids: Column, part: Column, content_sha: Column) -> Column:
    """``chunk_id`` where the embedding text's hash is at hand."""
    return F.concat(F.lit("chunk:"), sha(version, revision, granularity, F.array_join(block_ids, "\x1f"), part, content_sha))


def vector_id(manifest: Column, chunk: Column, profile: Column) -> Column:
    return F.sha2(F.concat_ws(":", manifest.cast("string"), chunk.cast("string"), profile.cast("string")), 256)


def bucket(salt: Column | str, key: Column, n: int = 100) -> Column:
    """A stable bucket from the first 32 bits of a salted hash."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return (F.conv(F.left(F.sha2(F.concat_ws(":", salt, key.cast("string")), 256), F.lit(8)), 16, 10).cast("long") % n).cast("int")


def canary(salt: Column | str, key: Column, percent: int) -> Column:
    """``candidate`` for the buckets below ``percent`` (1 to 99), else ``stable``."""
    if not 1 <= percent <= 99:
        raise ValueError("percent must be 1 to 99")
    return F.when(bucket(salt, key) < percent, "candidate").otherwise("stable")


def snapshot_key(version: Column, revision: Column, parser_profile: Column) -> Column:
    """Where a version's blocks are kept; null where nothing of the profile's name can stand in a path."""
    name = F.regexp_replace(F.regexp_replace(F.lower(parser_profile), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    name = F.left(name, F.lit(100))
    path = F.concat(F.lit("derived/"), version.cast("string"), F.lit("/content-r"), revision.cast("string"), F.lit("/parser-"), name, F.lit("/blocks.json"))
    return F.when(name != "", path)
