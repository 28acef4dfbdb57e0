"""Office archives: their inspection, and their text as blocks. Archives are read member by member, within limits."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.markup import BLOCKS, MERGED

PLACES = ", sheet_name string, slide_no int, bbox struct<x1:double,y1:double,x2:double,y2:double>, formulas array<struct<cell:string,formula:string,result:string>>"

INSPECTION = "path string, issue string, encrypted boolean, has_macros boolean, embedded_object_count int, external_link_count int, archive_depth int, compressed_size_bytes long, uncompressed_size_bytes long"
CORE = {"DOCX": "word/document.xml", "XLSX": "xl/workbook.xml", "PPTX": "ppt/presentation.xml"}
READ = re.compile(r".*\.(?:xml|rels)|(?:word|xl|ppt)/media/.*", re.S)  # what parsers may read


@dataclass(frozen=True)
class Limits:
    """The default limits of an archive."""

    entries: int = 20_000
    entry_bytes: int = 32 << 20
    read_bytes: int = 256 << 20
    ratio: float = 100.0
    depth: int = 3


def _issue(infos: list[zipfile.ZipInfo], expected: str | None, limits: Limits) -> str | None:
    """Why an archive isn't read, by its directory alone: the first entry that breaks a rule tells."""
    seen: set[str] = set()
    packed = raw = read = 0
    # The codes of the rules.
    for n, i in enumerate(infos, 1):
        name = i.filename
        if "\0" in name or "\\" in name or name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
            return "OOXML_UNSAFE_ENTRY_PATH"
        if name in seen:
            return "OOXML_DUPLICATE_ENTRY"
        seen.add(name)
        if n > limits.entries:
            return "ARCHIVE_ENTRY_LIMIT_EXCEEDED"
        if i.flag_bits & 1:
            return "OOXML_ENCRYPTED_UNSUPPORTED"
        packed, raw = packed + i.compress_size, raw + i.file_size
        if i.file_size > limits.ratio * i.compress_size or raw > limits.ratio * packed:
            return "COMPRESSION_RATIO_EXCEEDED"
        if READ.fullmatch(name):
            read += i.file_size
            if i.file_size > limits.entry_bytes:
                return "OOXML_ENTRY_TOO_LARGE"
            if read > limits.read_bytes:
                return "OOXML_MATERIALIZED_SIZE_EXCEEDED"
    kinds = [kind for kind, core in CORE.items() if core in seen]
    if len(kinds) != 1:
        return "OOXML_FORMAT_AMBIGUOUS"
    if expected is not None and kinds != [expected]:
        return "OOXML_INTERNAL_FORMAT_MISMATCH"
    return None


def inspect(content: bytes, expected: str | None = None, limits: Limits = Limits()) -> tuple:
    """issue, encrypted, macros, embedded objects, external links, depth, packed and unpacked bytes.

    ``expected`` is the format that the file was detected as; nothing is unpacked unless the directory keeps all limits.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            names = [i.filename.lower() for i in infos]
            depth = 2 if any(re.search(r"\.(zip|docx|xlsx|pptx)$", n) for n in names) else 1
            issue = _issue(infos, expected, limits) or ("ARCHIVE_DEPTH_EXCEEDED" if depth > limits.depth else None)
            external = 0
            if issue is None:
                for i in infos:
                    if i.filename.endswith(".rels"):
                        try:
                            external += sum((e.get("TargetMode") or "").lower() == "external" for e in ElementTree.fromstring(z.read(i)).iter())
                        except ElementTree.ParseError:
                            issue = "OOXML_RELATIONSHIP_XML_INVALID"
            return (
                issue, any(i.flag_bits & 1 for i in infos), any(n.endswith("/vbaproject.bin") or "/macrosheets/" in n or "/activex/" in n for n in names),
                sum("/embeddings/" in n or "/activex/" in n for n in names), external, depth, sum(i.compress_size for i in infos), sum(i.file_size for i in infos),
            )
    except Exception:  # whatever a broken file does to the reader is this file's failure, not the job's
        return ("OOXML_ZIP_INVALID", False, False, 0, 0, 0, 0, 0)


def inspected(files: DataFrame) -> DataFrame:
    """``files`` has path and content, and may have format, what they were detected as."""
    kind = F.col("format") if "format" in files.columns else F.lit(None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *inspect(c, k)) for p, k, c in zip(f["path"], f["format"], f["content"], strict=True)], columns=[c.split()[0] for c in INSPECTION.split(", ")])

    return files.select("path", kind.cast("string").alias("format"), "content").mapInPandas(run, INSPECTION)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x.tag) == "t")


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _find(e: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x.tag) in names)


def _block(kind: str, text: str, level: int | None = None, cells: list | None = None, heads: int | None = None, merged: list | None = None, sheet: str | None = None, slide: int | None = None, bbox: tuple | None = None, formulas: list | None = None) -> tuple:
    return kind, text, level, cells, heads, merged, sheet, slide, bbox, formulas


def _as_table(cells: list[list[str]], heads: int = 1, **more) -> tuple:
    return _block("TABLE", "\n".join(" | ".join(r) for r in cells), None, cells, heads, **more)


def _grid(rows: list[list[tuple[str, int, bool]]]) -> tuple[list[list[str]], list[tuple[int, int, int, int]]]:
    """Cells and merges of rows of (text, columns, whether the cell goes on from the one above)."""
    cells: list[list[str]] = []
    merged: dict[tuple[int, int], list[int]] = {}
    open_: dict[int, tuple[int, int]] = {}  # column to the merge that may go on there
    for r, row in enumerate(rows):
        line: list[str] = []
        for body, columns, goes_on in row:
            at = len(line)
            line += ["" if goes_on else body] + [""] * (columns - 1)
            if goes_on and at in open_:
                merged[open_[at]][0] += 1
            else:
                open_[at] = (r, at)
                merged[(r, at)] = [1, columns]
        cells.append(line)
    width = max(map(len, cells), default=0)
    return [c + [""] * (width - len(c)) for c in cells], [(r, c, *s) for (r, c), s in merged.items() if s != [1, 1]]


def _word_table(e: ElementTree.Element) -> tuple:
    rows = []
    for tr in (x for x in e if _local(x.tag) == "tr"):
        row = []
        for tc in (x for x in tr if _local(x.tag) == "tc"):
            span = next((_attr(x, "val") for x in _find(tc, "gridSpan")), "1")
            below = next((_attr(x, "val") != "restart" for x in _find(tc, "vMerge")), False)
            row.append((" ".join(_text(tc).split()), int(span), below))
        rows.append(row)
    cells, merged = _grid(rows)
    return _as_table(cells, merged=merged)


def docx_blocks(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Titles by style, list items, paragraphs, tables with merges, and images: those in the text, then what media is left."""
    body = next(_find(_part(z, CORE["DOCX"]), "body"))
    pictures = 0
    for e in body:
        if _local(e.tag) == "p":
            style = next((_attr(s, "val") or "" for s in _find(e, "pStyle")), "")
            level = re.match(r"(?:Heading|heading )(\d)", style)
            text = " ".join(_text(e).split())
            if text:
                yield _block("TITLE", text, int(level[1])) if level else _block("LIST" if next(_find(e, "numPr"), None) is not None else "PARAGRAPH", text)
            for picture in _find(e, "drawing", "pict"):
                pictures += 1
                yield _block("IMAGE", next((_attr(x, "descr") or "" for x in _find(picture, "docPr")), ""))
        elif _local(e.tag) == "tbl":
            yield _word_table(e)
    for _ in [n for n in z.namelist() if n.startswith("word/media/")][pictures:]:
        yield _block("IMAGE", "")


def _size(z: zipfile.ZipFile) -> tuple[int, int]:
    """A slide's width and height."""
    for e in _find(_part(z, CORE["PPTX"]), "sldSz"):
        width, height = int(e.get("cx") or 0), int(e.get("cy") or 0)
        if width > 0 and height > 0:
            return width, height
    return 12_192_000, 6_858_000


Place = tuple[float, float, float, float]  # scale and shift of x, scale and shift of y


def _rectangle(e: ElementTree.Element, off: str = "off", ext: str = "ext") -> tuple[int, int, int, int] | None:
    """x, y, width and height that the first such elements tell."""
    at, size = next(_find(e, off), None), next(_find(e, ext), None)
    if at is None or size is None or not (size.get("cx") and size.get("cy")):
        return None
    return int(at.get("x") or 0), int(at.get("y") or 0), int(size.get("cx")), int(size.get("cy"))


def _shapes(e: ElementTree.Element, place: Place = (1.0, 0.0, 1.0, 0.0)) -> Iterator[tuple[ElementTree.Element, Place]]:
    """Texts, tables and pictures with what brings their places onto the slide: a group's children have coordinates of their own."""
    for child in e:
        kind = _local(child.tag)
        if kind in ("sp", "graphicFrame", "pic"):
            yield child, place
        elif kind == "grpSp":
            inner, own = place, next((x for x in child if _local(x.tag) == "grpSpPr"), None)
            outside, inside = (_rectangle(own), _rectangle(own, "chOff", "chExt")) if own is not None else (None, None)
            if outside and inside:
                sx, sy = outside[2] / inside[2], outside[3] / inside[3]
                inner = (place[0] * sx, place[0] * (outside[0] - inside[0] * sx) + place[1], place[2] * sy, place[2] * (outside[1] - inside[1] * sy) + place[3])
            yield from _shapes(child, inner)
        else:
            yield from _shapes(child, place)


def _box(shape: ElementTree.Element, place: Place, width: int, height: int) -> tuple[float, float, float, float] | None:
    """x1, y1, x2, y2 of a shape, from 0 to 1."""
    found = _rectangle(shape)
    if found is None:
        return None
    x, y, w, h = place[0] * found[0] + place[1], place[2] * found[1] + place[3], place[0] * found[2], place[2] * found[3]
    return tuple(min(1.0, max(0.0, v)) for v in (x / width, y / height, (x + w) / width, (y + h) / height))


def pptx_blocks(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Slides in the order of their numbers: texts, tables and pictures with their places."""
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    width, height = _size(z)
    for number, name in slides:
        for e, onto in _shapes(_part(z, name)):
            place = {"slide": number, "bbox": _box(e, onto, width, height)}
            grid = next(_find(e, "tbl"), None)
            if grid is not None:
                rows = [[(" ".join(_text(c).split()), 1, False) for c in r if _local(c.tag) == "tc"] for r in grid if _local(r.tag) == "tr"]
                if rows:
                    yield _as_table(_grid(rows)[0], **place)
            elif _local(e.tag) == "pic":
                yield _block("IMAGE", next((x.get("descr") or x.get("name") or "" for x in _find(e, "cNvPr")), ""), **place)
            else:
                text = "\n".join(x.text or "" for x in _find(e, "t"))
                title = any((x.get("type") or "").lower() in ("title", "ctrtitle") for x in _find(e, "ph"))
                if text.strip():
                    yield _block("TITLE", text, 1, **place) if title else _block("PARAGRAPH", text, **place)


def column_number(letters: str) -> int:
    """A is 1, AA is 27."""
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


# The numbers of built-in date and time formats.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = _part(z, "xl/styles.xml")
    own = {int(e.get("numFmtId")) for e in _find(root, "numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]|\\\\.', "", (e.get("formatCode") or "").lower()))}
    xfs = next(_find(root, "cellXfs"), ())
    return {i for i, x in enumerate(xfs) if int(x.get("numFmtId") or 0) in DATE_FORMATS | own}


def _value(c: ElementTree.Element, shared: list[str], dates: set[int]) -> tuple[str, tuple[str, str, str | None] | None]:
    """A cell's text, and its formula with what it came to."""
    kind, raw = c.get("t"), next((x.text or "" for x in c if _local(x.tag) == "v"), None)
    if kind == "s" and raw:
        value = shared[int(raw)]
    elif kind == "inlineStr":
        value = _text(c)
    elif kind == "b":
        value = "true" if raw == "1" else "false"
    elif raw and kind in (None, "n") and int(c.get("s") or 0) in dates:
        moment = datetime(1899, 12, 30) + timedelta(days=float(raw))
        value = moment.isoformat(timespec="milliseconds") + "Z"
    else:
        value = raw or ""
    formula = next((x.text or "" for x in c if _local(x.tag) == "f"), None)
    if formula is None:
        return value, None
    return (value if raw is not None else f"={formula}"), (c.get("r") or "", formula, raw)


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Of a part's relationships the parts that they lead to."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    targets = {e.get("Id") or "": e.get("Target") or "" for e in _find(_part(z, rels), "Relationship") if (e.get("TargetMode") or "").lower() != "external"}
    return {i: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}") for i, t in targets.items()}


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order, by its relationships; a workbook without them has its parts in the order of their numbers."""
    listed = [(e.get("name") or "", _attr(e, "id")) for e in _find(_part(z, CORE["XLSX"]), "sheet")]
    parts = _relations(z, CORE["XLSX"])
    if parts:
        return [(name, parts[own]) for name, own in listed if parts.get(own, "").startswith("xl/worksheets/")]
    numbers = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    return [(listed[k][0] if k < len(listed) else f"sheet {k + 1}", n) for k, (_, n) in enumerate(numbers)]


def xlsx_blocks(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Each sheet's name as a title, then its cells: rows without cells are left out, merged cells have their text once."""
    shared = [_text(e) for e in _part(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    dates = _date_styles(z)
    for name, part in _sheets(z):
        root = _part(z, part)
        ranges = [(column_number(m[1]), int(m[2]), column_number(m[3]), int(m[4])) for e in _find(root, "mergeCell") if (m := re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", e.get("ref") or ""))]
        rows, formulas, place = [], [], {}
        for row in _find(root, "row"):
            number = int(row.get("r") or len(rows) + 1)
            cells: list[str] = []
            for c in row:
                at = column_number(re.match(r"[A-Z]+", c.get("r") or "A")[0])
                value, formula = _value(c, shared, dates)
                inside = any(a <= at <= b and i <= number <= j and (at, number) != (a, i) for a, i, b, j in ranges)
                cells += [""] * (at - 1 - len(cells)) + ["" if inside else value]
                formulas += [formula] if formula else []
            if cells:
                place[number] = len(rows)
                rows.append(cells)
        width = max(map(len, rows), default=0)
        yield _block("TITLE", name, 1, sheet=name)
        if width:
            merged = [(place[i], a - 1, j - i + 1, b - a + 1) for a, i, b, j in ranges if i in place]
            yield _as_table([r + [""] * (width - len(r)) for r in rows], sheet=name, merged=merged, formulas=formulas)


TARGETS = "doc_id long, target_id string, sheet_name string, slide_no int, bbox struct<x1:double,y1:double,x2:double,y2:double>, entry string"


def _images(z: zipfile.ZipFile, kind: str) -> Iterator[tuple]:
    """target, sheet, slide, box and archive entry of the images of a file; an image whose entry isn't told has none."""
    embedded = lambda e: next((_attr(x, "embed") or "" for x in _find(e, "blip")), "")
    if kind == "DOCX":
        for k, entry in enumerate(sorted(n for n in z.namelist() if n.startswith("word/media/")), 1):
            yield f"docx-image-{k}", None, None, None, entry
    elif kind == "PPTX":
        width, height = _size(z)
        for number, name in sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))):
            parts = _relations(z, name)
            pictures = [(e, onto) for e, onto in _shapes(_part(z, name)) if _local(e.tag) == "pic"]
            for k, (e, onto) in enumerate(pictures, 1):
                yield f"pptx-slide-{number}-image-{k}", None, number, _box(e, onto, width, height), parts.get(embedded(e))
    elif kind == "XLSX":
        for number, (sheet, part) in enumerate(_sheets(z), 1):
            root = _part(z, part)
            rows = max((int(r.get("r") or k) for k, r in enumerate(_find(root, "row"), 1)), default=0)
            columns = max((column_number(re.match(r"[A-Z]+", c.get("r") or "A")[0]) for c in _find(root, "c")), default=0)
            drawings = [p for p in _relations(z, part).values() if re.fullmatch(r"xl/drawings/[^/]+\.xml", p) and p in z.namelist()]
            k = 0
            for drawing in drawings:
                parts = _relations(z, drawing)
                for anchor in _find(_part(z, drawing), "twoCellAnchor", "oneCellAnchor"):
                    if next(_find(anchor, "pic"), None) is None:
                        continue
                    k += 1
                    ends = {_local(x.tag): {_local(v.tag): int(v.text or 0) for v in x if _local(v.tag) in ("col", "row")} for x in anchor if _local(x.tag) in ("from", "to")}
                    box = None
                    if len(ends) == 2 and columns and rows:
                        box = tuple(min(1.0, max(0.0, v)) for v in (ends["from"].get("col", 0) / columns, ends["from"].get("row", 0) / rows, ends["to"].get("col", 0) / columns, ends["to"].get("row", 0) / rows))
                    yield f"xlsx-{number}-image-{k}", sheet, None, box, parts.get(embedded(anchor))


def image_targets(files: DataFrame) -> DataFrame:
    """What recognition may be asked for in office files (doc_id, format, content): each embedded image with its place; files that don't open have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for d, kind, content in zip(f["doc_id"], f["format"], f["content"], strict=True):
                if inspect(content, kind)[0] is None:
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            found += [(d, *t) for t in list(_images(z, kind))]
                    except Exception:  # the parser says what is wrong with the file
                        continue
            yield pd.DataFrame(found, columns=["doc_id", "target_id", "sheet_name", "slide_no", "bbox", "entry"]).astype({"slide_no": "Int32"})

    return files.select("doc_id", "format", "content").mapInPandas(run, TARGETS)


PARSERS = {"DOCX": docx_blocks, "XLSX": xlsx_blocks, "PPTX": pptx_blocks}


def parsed(files: DataFrame) -> DataFrame:
    """``files`` has doc_id, format and content; the blocks of each, or one row with the code of its failure, so that a broken file ends nothing but itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for d, kind, content in zip(f["doc_id"], f["format"], f["content"], strict=True):
                code = inspect(content, kind)[0] if kind in PARSERS else "PARSER_FORMAT_UNSUPPORTED"
                if code is None:
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            found += [(d, k, *b, None) for k, b in enumerate(list(PARSERS[kind](z)), 1)]
                        continue
                    except Exception:
                        code = f"{kind}_CONTENT_INVALID"
                found.append((d, 0, None, None, None, None, None, None, None, None, None, None, code))
            out = pd.DataFrame(found, columns=["doc_id", "ordinal", "type", "text", "heading_level", "cells", "header_rows", "merged_cells", "sheet_name", "slide_no", "bbox", "formulas", "code"])
            yield out.astype({"heading_level": "Int32", "header_rows": "Int32", "slide_no": "Int32"})

    return files.select("doc_id", "format", "content").mapInPandas(run, BLOCKS + MERGED + PLACES + ", code string")


def blocks(files: DataFrame) -> DataFrame:
    """``files`` has doc_id, format and content; archives that don't open have no blocks."""
    return parsed(files).filter("code IS NULL").drop("code")
