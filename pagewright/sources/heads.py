"""State tables under one pointer that moves by compare-and-set.

A commit writes its tables to a folder of its own and then creates the pointer of the next version, which is there once or not
at all: of two writers that began with the same version one wins, and the other gets ``Conflict`` and has changed nothing.
Readers take all tables from the folder of one pointer, so they never see a mix. Pointers are small files; there is no table
format beneath them.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.shared import discard


class Conflict(Exception):
    """Another writer has made the version that was to be made."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its content unless it is there; whole or not at all."""
    system, where = _fs(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    _, there = _fs(spark, draft)
    out = system.create(there, False)
    out.write(bytearray(text.encode()))
    out.close()
    if system.getScheme() == "file":  # a local rename would replace; a link doesn't
        try:
            os.link(there.toUri().getPath(), where.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            system.delete(there, False)
        return True
    if system.exists(where) or not system.rename(there, where):  # renames onto what is there fail
        system.delete(there, False)
        return False
    return True


def _name(version: int) -> str:
    return f"{version:020d}.json"


def version(spark: SparkSession, path: str) -> int:
    """The version that readers see; 0 before the first commit."""
    system, folder = _fs(spark, f"{path}/heads")
    if not system.exists(folder):
        return 0
    return max((int(f.getPath().getName()[:20]) for f in system.listStatus(folder) if f.getPath().getName().endswith(".json")), default=0)


def read(spark: SparkSession, path: str, at: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """(version, tables) of the head, or of an older version."""
    at = version(spark, path) if at is None else at
    if not at:
        return 0, {}
    system, where = _fs(spark, f"{path}/heads/{_name(at)}")
    stream = system.open(where)
    said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return at, {name: spark.read.parquet(f"{path}/{said['folder']}/{name}") for name in said["tables"]}


def commit(spark: SparkSession, path: str, expected: int, tables: dict[str, DataFrame]) -> int:
    """Make ``tables`` the next version after ``expected``; its number. Raises ``Conflict`` if that isn't the head any more."""
    folder = f"state-{uuid.uuid4().hex}"
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{folder}/{name}")
    system, heads = _fs(spark, f"{path}/heads")
    system.mkdirs(heads)
    if version(spark, path) != expected or not _create_new(spark, f"{path}/heads/{_name(expected + 1)}", json.dumps({"folder": folder, "tables": sorted(tables)})):
        discard(spark, f"{path}/{folder}")
        raise Conflict(f"version {expected} isn't the head any more")
    return expected + 1
