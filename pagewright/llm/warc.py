"""A dictionary-compressed WARC writer and its reader.

Every archive begins with a skippable frame that holds a Zstandard dictionary
built from the archive's own records; each record follows as a frame of its
own, so that records can be read one by one. Of records with equal payloads
the one with the largest page_id is a response, the others are revisits that
carry no payload and refer to it.

Archives are written by the tasks, through pyarrow's file systems, to a shared
folder under names that no other attempt uses; the names of committed archives
come back as a table, and only those are read. A task holds one archive
(``Config.archive_bytes`` of records) in memory.

Defined cases: a null html is an empty payload; a null url is written as
``about:blank`` and control characters and spaces in urls are escaped; a null
page_id is written as empty and is never the largest unless all are null; rows
with the largest page_id of their payload repeated are all responses; payloads
below ``Config.revisit_least`` bytes are all responses; an empty table writes
no archive and reads no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.rows import from_files, placed
from pagewright.shared import new_path, write_shared

# Fixed values of the formats: the skippable frame's magic number, the revisit profile.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Config:
    """Parameters of the writer."""

    archive_bytes: int = 16 << 20
    dictionary_bytes: int = 32 << 10
    sample_bytes: int = 2 << 20
    level: int = 3
    revisit_least: int = 0
    date: str = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare base32 of the SHA-1."""
    return base32(hashlib.sha1(payload).hexdigest())


def base32(digits: str) -> str:
    """Hex digits in base32."""
    return base64.b32encode(bytes.fromhex(digits)).decode()


def record_id(row: str) -> str:
    """A record's name from 32 hex digits that stand for the place of its row, so that repeated pages have names of their own."""
    return f"<urn:uuid:{uuid.UUID(hex=row, version=5)}>"


def _safe(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None, row: str, other: str, date: str) -> bytes:
    """One WARC record; a revisit, which has no payload here, has the response's HTTP header alone."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(other)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes], config: Config) -> bytes:
    """A trained dictionary from evenly spaced records; where there are too few to train on, their bytes as they are."""
    total, step = sum(map(len, records)), 1
    while total // step > config.sample_bytes and step < len(records):
        step += 1
    some = records[::step]
    try:
        return zstandard.train_dictionary(config.dictionary_bytes, some, level=config.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[: config.dictionary_bytes]


def archive(records: list[bytes], config: Config) -> Iterator[bytes]:
    """The parts of an archive: the dictionary's frame, then a frame for each record."""
    words = dictionary(records, config)
    yield struct.pack("<II", SKIPPABLE, len(words)) + words
    press = zstandard.ZstdCompressor(level=config.level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True)
    for r in records:
        yield press.compress(r)


def records_of(stream, piece: int = 64 << 10) -> Iterator[bytes]:
    """The records of an open archive, read piece by piece."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the archive's start")
    words = stream.read(size)
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    rest, got, frame = b"", [], open_.decompressobj()
    while True:
        data = rest or stream.read(piece)
        rest = b""
        if not data:
            break
        got.append(frame.decompress(data))
        if frame.eof:
            rest = frame.unused_data
            yield b"".join(got)
            got, frame = [], open_.decompressobj()
    if any(got):
        raise ValueError("the archive ends within a record")


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, type and page referred to; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't the one that was written")
    number = {k: int(v) if (v := fields.get(k, "").strip()) else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    return number["X-Page-Id"], size, digest, fields["WARC-Type"], number["X-Refers-To-Page-Id"]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def planned(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """page_id, url, payload (null for a revisit), size, sha1, refers_to, row (32 hex digits), other (those of the response).

    Which page is the response is decided on narrow rows; the payloads are then dealt out by their rows' places, so that a
    payload that many pages share doesn't gather in one task.
    """
    place = F.left(F.sha1(F.concat_ws(":", "at.file", "at.row")), F.lit(32))
    html = F.coalesce(F.col("doc.html").cast("string"), F.lit("")).cast("binary")
    rows = placed(from_files(pages)).select(F.col("doc.page_id").cast("long").alias("page_id"), F.col("doc.url").cast("string").alias("url"), html.alias("payload"), place.alias("row"))
    narrow = rows.select("page_id", "row", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1"))
    narrow = write_shared(narrow, "warc-rows")
    most = narrow.groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("most")).select("key", F.col("most.page_id").alias("response"), F.col("most.row").alias("other"))
    revisit = F.coalesce((F.coalesce(F.col("page_id"), F.col("response") - 1) < F.col("response")) & (F.col("size") >= config.revisit_least), F.lit(False))
    said = narrow.join(most, "key").select("row", "size", "sha1", revisit.alias("revisit"), "response", "other")
    joined = rows.join(said, "row")
    return joined.select("page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "sha1", F.when(F.col("revisit"), F.col("response")).alias("refers_to"), "row", "other")


def write(pages: DataFrame, folder: str | None = None, config: Config = Config()) -> DataFrame:
    """Write all rows; returns the committed archives: (uri, records, bytes)."""
    where = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(where)
        system.create_dir(path, recursive=True)

        def put(records: list[bytes]) -> pa.RecordBatch:
            name, size = f"{uuid.uuid4().hex}.warc.zst", 0
            with system.open_output_stream(f"{path}/{name}") as out:
                for part in archive(records, config):
                    out.write(part)
                    size += len(part)
            return pa.RecordBatch.from_pydict({"uri": [f"{where}/{name}"], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([size], pa.int64())})

        records, total = [], 0
        for b in batches:
            for fields in zip(*(c.to_pylist() for c in b.columns), strict=True):
                records.append(record(*fields, config.date))
                total += len(records[-1])
                if total >= config.archive_bytes:
                    yield put(records)
                    records, total = [], 0
        if records:
            yield put(records)

    return write_shared(planned(pages, config).mapInArrow(run, "uri string, records long, bytes long"), "warc-archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of the archives named by ``archives``: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = _filesystem(uri)
                with system.open_input_stream(path) as stream:
                    rows: list[tuple] = []
                    for raw in records_of(stream):
                        rows.append(parsed(raw))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    n = max(1, min(archives.count(), 100_000))
    return archives.select("uri").repartition(n, "uri").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
