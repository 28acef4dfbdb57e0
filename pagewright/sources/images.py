"""Width and height of images from their headers, for the kinds whose headers must be walked; see files.image_size for the others."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def jpeg(b: bytes) -> tuple[int, int] | None:
    """The first start-of-frame segment."""
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            return None
        kind, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def tiff(b: bytes) -> tuple[int, int] | None:
    """Tags 256 and 257 of the first directory."""
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", b, 4)[0]
    found: dict[int, int] = {}
    for k in range(struct.unpack_from(order + "H", b, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", b, at + 2 + 12 * k)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, at + 10 + 12 * k)[0]
    return (found[256], found[257]) if len(found) == 2 else None


def webp(b: bytes) -> tuple[int, int] | None:
    """Extended, lossy and lossless files."""
    if b[12:16] == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if b[12:16] == b"VP8 ":
        return tuple(x & 0x3FFF for x in struct.unpack_from("<HH", b, 26))
    if b[12:16] == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


KINDS = {"JPEG": jpeg, "TIFF": tiff, "WEBP": webp}


def sizes(files: DataFrame) -> DataFrame:
    """``files`` has path, kind and content; headers that can't be read have no size."""

    def size(kind: str, content: bytes) -> tuple:
        try:
            return KINDS[kind](bytes(content)) or (None, None)
        except (KeyError, IndexError, TypeError, struct.error):
            return None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [size(k, c) for k, c in zip(f["kind"], f["content"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "width": pd.array([w for w, _ in found], "Int64"), "height": pd.array([h for _, h in found], "Int64")})

    return files.select("path", "kind", "content").mapInPandas(run, "path string, width long, height long")
