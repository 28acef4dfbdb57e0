"""Vectors of manifests as a data source: ``spark.read.format("manifest_vectors").load(path)``.

A table is a folder of data files and a folder of commits. A task writes one file; a commit names the files of a whole job and
the manifests in each, so what a failed or aborted job has left is never read. A commit replaces the manifests that it holds, or
with ``overwrite`` the whole table; of commits that hold the same manifest the last one counts. Filters on ``manifest_id``
(equal, in) are pushed into the reader, which opens only the files that hold such rows; a schema with fewer columns makes it read
no others.

Paths are those of pyarrow's file systems (``file``, ``hdfs``, ``s3``, ...). Register with ``register(spark)``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "manifest_vectors"
SCHEMA = "manifest_id string, vector_id string, space_id string, document_id string, chunk_id string, ordinal long, content_sha256 string, embedding_profile_id string, dense_vector array<double>, sparse_terms array<string>, sparse_weights array<double>"


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorSource)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


def _commits(system: fs.FileSystem, root: str) -> list[dict]:
    """All commits, the oldest first."""
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return out


def current(path: str) -> dict[str, list[str]]:
    """Of each manifest the files that hold its rows now."""
    system, root = _opened(path)
    held: dict[str, list[str]] = {}
    for commit in _commits(system, root):
        new: dict[str, list[str]] = {}
        for file, manifests in commit["files"].items():
            for m in manifests:
                new.setdefault(m, []).append(file)
        held = new if commit["whole"] else held | new
    return held


@dataclass
class Part(InputPartition):
    file: str
    manifests: list[str]


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorReader(self.options["path"], schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VectorWriter(self.options["path"], overwrite)


class VectorReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns
        self.wanted: set[str] | None = None  # None: all manifests

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("manifest_id",):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f  # Spark's own

    def partitions(self) -> list[Part]:
        files: dict[str, list[str]] = {}
        for manifest, names in current(self.path).items():
            if self.wanted is None or manifest in self.wanted:
                for name in names:
                    files.setdefault(name, []).append(manifest)
        return [Part(f, m) for f, m in sorted(files.items())] or [Part("", [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, root = _opened(self.path)
        keep = pa.array(part.manifests, pa.string())  # a file may hold manifests that a later commit has replaced
        with system.open_input_file(f"{root}/{part.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.columns):
                yield batch.filter(pc.is_in(batch.column(batch.schema.get_field_index("manifest_id")), value_set=keep))


@dataclass
class Written(WriterCommitMessage):
    file: str
    manifests: list[str]


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.whole = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        name, manifests, out = f"data/{uuid.uuid4().hex}.parquet", set(), None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                column = batch.column(batch.schema.get_field_index("manifest_id"))
                if column.null_count or batch.column(batch.schema.get_field_index("vector_id")).null_count:
                    raise ValueError("a vector needs a manifest and an id")
                manifests |= set(pc.unique(column).to_pylist())
                if out is None:
                    system.create_dir(f"{root}/data", recursive=True)
                    out = pq.ParquetWriter(system.open_output_stream(f"{root}/{name}"), batch.schema, compression="zstd")
                out.write_batch(batch)
        finally:
            if out is not None:
                out.close()
        return Written(name if manifests else "", sorted(manifests))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        files = {m.file: m.manifests for m in messages if m is not None and m.file}
        if not files and not self.whole:
            return
        system.create_dir(f"{root}/commits", recursive=True)
        final = f"{root}/commits/{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{final}.tmp") as f:
            f.write(json.dumps({"whole": self.whole, "files": files}).encode())
        system.move(f"{final}.tmp", final)  # readers see a commit whole or not at all

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/{m.file}")
