"""PDF files written here, read page by page."""

import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.sources import files, intake, pdf


def obj(n, body):
    return b"%d 0 obj\n%s\nendobj\n" % (n, body)


def stream(body, more=b"", pack=False):
    body = zlib.compress(body) if pack else body
    return b"<</Length %d%s%s>>\nstream\n%s\nendstream" % (len(body), b"/Filter/FlateDecode" if pack else b"", more, body)


def with_table(objects, root=b"1 0 R", more=b""):
    """Objects (number to body) with a cross-reference table."""
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += obj(n, body)
    at, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 %s \n" % (places.get(n, 0), b"n" if n in places else b"f")
    return bytes(out) + b"trailer\n<</Size %d/Root %s%s>>\nstartxref\n%d\n%%%%EOF" % (size, root, more, at)


def with_streams(objects, packed):
    """Some objects inside an object stream, and a cross-reference stream with a row predictor."""
    bodies, heads, at = b"", b"", 0
    for n in packed:
        heads += b"%d %d " % (n, at)
        bodies += objects[n] + b" "
        at += len(objects[n]) + 1
    holder, table = max(objects) + 1, max(objects) + 2
    plain = {n: b for n, b in objects.items() if n not in packed} | {holder: stream(heads + bodies, b"/Type/ObjStm/N %d/First %d" % (len(packed), len(heads)), True)}
    out, rows = bytearray(b"%PDF-1.5\n"), {0: (0, 0, 0)} | {n: (2, holder, k) for k, n in enumerate(packed)}
    for n, body in plain.items():
        rows[n] = (1, len(out), 0)
        out += obj(n, body)
    rows[table] = (1, len(out), 0)
    lines = [bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in (rows.get(n, (0, 0, 0)) for n in range(table + 1))]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(line, before, strict=True)) for line, before in zip(lines, [bytes(5), *lines], strict=False))
    body = stream(up, b"/Type/XRef/Size %d/W[1 3 1]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 5>>" % (table + 1), True)
    return bytes(out) + obj(table, body) + b"startxref\n%d\n%%%%EOF" % rows[table][1]


def document(contents, fonts=b"<</F 3 0 R>>", more=None, page=b""):
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(contents)))
    made = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]/Count %d/Resources<</Font%s/XObject<</X 5 0 R>>>>>>" % (kids, len(contents), fonts)}
    made |= {3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1/Adieresis/fi/uni20AC 200/eacute]>>>>"} | (more or {})
    for k, body in enumerate(contents):
        made[10 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (11 + 2 * k, page)
        made[11 + 2 * k] = stream(body, pack=k % 2 == 0)
    return made


LINES = b"BT /F 10 Tf 12 TL 50 700 Td (one \\(a\\) l\\151ne) Tj T* [(sp) -400 (aced) 20 (out)] TJ 0 -12 Td (\\001\\002\\003\\310) Tj (\\374ber) ' ET"
FORM = {5: stream(b"BT /F 8 Tf 10 20 Td (inside a form) Tj ET", b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 5 5]")}
LINK = {6: b"<</Type/Annot/Subtype/Link/A<</S/URI/URI(https://x)>>>>", 7: b"<</Type/Annot/Subtype/Link/Dest[1]>>"}
PAGES = [LINES, b"q 1 0 0 1 0 300 cm /X Do Q BT /F 9 Tf 300 100 Td (far) Tj ET BT /F 9 Tf 330 100 Td (cell) Tj ET", b"q 10 0 0 10 0 0 cm BI /W 1 /H 1 ID x(y EI Q"]
WANT = ["one (a) line\nsp acedout\nÄﬁ€é\nüber", "inside a form\nfar\tcell", ""]


@pytest.fixture(scope="module")
def samples():
    made = document(PAGES, more=FORM | LINK, page=b"/Annots[6 0 R 7 0 R]")
    table, streams = with_table(made), with_streams(made, [1, 2, 3, 10, 12, 14])
    cid = document([b"BT /F 10 Tf 1 0 0 1 0 0 Tm <0001000300050009> Tj ET"], more={
        3: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R/DescendantFonts[<</DW 600/W[1[500 700] 5 9 400]>>]>>",
        4: stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <65E5672C> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0009> [<00410042> <0043> <0044> <0045> <D83DDE00>] endbfrange", pack=True)})
    return {
        "table": table, "streams": streams, "cid": with_table(cid), "lost": table.replace(b"startxref", b"startxxxx"), "lost streams": streams.replace(b"startxref", b"startxxxx"), "moved": b"%PDF-1.4\n% more\n" + table[9:], "locked": with_table(made, more=b"/Encrypt<</V 1>>"),
        "broken": table[:60], "cut": with_table(document([LINES])).replace(b"/FlateDecode", b"/JPXDecodeXX"), "empty": b"%PDF-1.4", "incremental": table + obj(11, stream(b"BT /F 1 Tf (new) Tj ET")) + b"xref\n11 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R/Size 20/Prev %d>>\nstartxref\n%d\n" % (len(table), int(table.split(b"startxref\n")[1].split()[0]), len(table) + len(obj(11, stream(b"BT /F 1 Tf (new) Tj ET")))),
    }


def test_pages(samples):
    for name in ("table", "streams", "lost", "lost streams", "moved"):
        assert [t for t, _ in pdf.read(samples[name])] == WANT, name
        assert [n for _, n in pdf.read(samples[name])] == [1, 1, 1]
    assert pdf.read(samples["cid"]) == [("日本bAB\U0001f600", 0)]
    assert [t for t, _ in pdf.read(samples["incremental"])] == ["new", *WANT[1:]]
    assert [pdf.glyph(x) for x in ("a", "odieresis", "Ccaron", "uni00410042", "u1F600", "fi.alt", "nothing")] == ["a", "ö", "Č", "AB", "\U0001f600", "ﬁ", ""]


def test_rows_and_failures(spark, samples):
    names = list(samples)
    df = spark.createDataFrame([(i, bytearray(samples[n])) for i, n in enumerate(names)], "doc_id long, content binary").repartition(3)
    got = pdf.pages(df).collect()
    codes = {names[r["doc_id"]]: r["code"] for r in got if r["code"]}
    assert codes == {"locked": "PDF_PASSWORD_PROTECTED", "broken": "PDF_CONTENT_INVALID", "cut": "PDF_CONTENT_INVALID", "empty": "PDF_CONTENT_INVALID"}
    assert {r["code"] for r in pdf.pages(df, most_pages=2).collect() if names[r["doc_id"]] == "table"} == {"PAGE_LIMIT_EXCEEDED"}
    read = pdf.pages(df.filter(F.col("doc_id") == names.index("table")))
    rows = pdf.blocks(read).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["page_no"], r["text"]) for r in rows] == [(1, 1, "one (a) line"), (2, 1, "sp acedout"), (3, 1, "Äﬁ€é"), (4, 1, "über"), (5, 2, "inside a form"), (6, 2, "far cell")]
    assert [tuple(r["bbox"]) for r in rows[:4]] == [(0.0, k / 4, 1.0, (k + 1) / 4) for k in range(4)]
    assert [tuple(r) for r in pdf.coverage(read).select("page_no", "text_characters", "text_coverage", "image_only").orderBy("page_no").collect()] == [(1, 30, 0.015, False), (2, 21, 0.0105, False), (3, 0, 0.0, True)]
    assert [tuple(r)[1:] for r in pdf.targets(read).collect()] == [(3, "PAGE", "page-3", "NO_NATIVE_TEXT")]


def test_intake_keeps_good_files_beside_broken_ones(spark, samples):
    """PDFs and archives of every fate in one batch; recognition replaces the pages that it was asked for."""
    from test_sources import DOCX, XLSX, archive

    word = files.OFFICE + "wordprocessingml.document"
    dense = bytes(1 << 20)
    import io
    import zipfile

    def packed(parts, kind=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as z:
            for name, body in parts:
                z.writestr(name, body)
        return out.getvalue()

    locked = bytearray(archive(DOCX))
    for sign in (b"PK\x03\x04", b"PK\x01\x02"):
        at = locked.find(sign)
        locked[at + (6 if sign == b"PK\x03\x04" else 8)] |= 1
    plain = with_table(document([b"BT /F 10 Tf 0 0 Td (" + b"long text " * 30 + b") Tj ET", b""]))
    cases = {
        "good.docx": archive(DOCX), "xml.docx": archive({"word/document.xml": "<w:document><w:body>"}), "sheet.docx": archive(XLSX), "locked.docx": bytes(locked), "dense.docx": packed([("word/document.xml", DOCX["word/document.xml"]), ("word/media/a.bin", dense)]),
        "twice.docx": packed([*DOCX.items(), *DOCX.items()]), "both.docx": archive(DOCX | XLSX), "rels.docx": archive(DOCX | {"word/_rels/document.xml.rels": "<r"}), "up.docx": archive(DOCX | {"../x": "y"}), "body.docx": archive({"word/document.xml": "<a/>"}),
        "index.xlsx": archive(XLSX | {"xl/sharedStrings.xml": "<sst/>"}), "good.xlsx": archive(XLSX), "not.docx": b"PK\x03\x04zz",
        "plain.pdf": plain, "linked.pdf": samples["table"], "broken.pdf": samples["broken"], "locked.pdf": samples["locked"],
    }
    names = list(cases)
    df = spark.createDataFrame([(i, n, "", bytearray(cases[n]), None, None) for i, n in enumerate(names)], "doc_id long, file_name string, declared_mime string, content binary, declared_size long, declared_sha256 string")
    assert word
    outcomes, blocks, targets = intake.process(df)
    got = {names[r["doc_id"]]: (r["outcome"], r["code"], r["n_blocks"]) for r in outcomes.collect()}
    assert got == {
        "good.docx": ("COMPLETED", None, 3), "xml.docx": ("FAILED", "DOCX_CONTENT_INVALID", 0), "sheet.docx": ("FAILED", "OOXML_INTERNAL_FORMAT_MISMATCH", 0), "locked.docx": ("FAILED", "OOXML_ENCRYPTED_UNSUPPORTED", 0), "dense.docx": ("FAILED", "COMPRESSION_RATIO_EXCEEDED", 0),
        "twice.docx": ("FAILED", "OOXML_DUPLICATE_ENTRY", 0), "both.docx": ("FAILED", "OOXML_FORMAT_AMBIGUOUS", 0), "rels.docx": ("FAILED", "OOXML_RELATIONSHIP_XML_INVALID", 0), "up.docx": ("FAILED", "OOXML_UNSAFE_ENTRY_PATH", 0), "body.docx": ("FAILED", "DOCX_CONTENT_INVALID", 0),
        "index.xlsx": ("FAILED", "XLSX_CONTENT_INVALID", 0), "good.xlsx": ("COMPLETED", None, 2), "not.docx": ("FAILED", "OOXML_ZIP_INVALID", 0),
        "plain.pdf": ("COMPLETED", None, 1), "linked.pdf": ("MANUAL_REVIEW", "EXTERNAL_LINK_FOUND", 0), "broken.pdf": ("FAILED", "PDF_CONTENT_INVALID", 0), "locked.pdf": ("FAILED", "PDF_PASSWORD_PROTECTED", 0),
    }
    assert {tuple(r) for r in blocks.groupBy("doc_id").count().collect()} == {(names.index(n), k) for n, (_, _, k) in got.items() if k}
    assert [(names[r["doc_id"]], r["page_no"], r["target"], r["origin"]) for r in targets.collect()] == [("plain.pdf", 2, "PAGE", "PARSER")]
    warned = {names[r["doc_id"]]: "RECOGNITION_REQUIRED" in r["warnings"] for r in outcomes.collect()}
    assert [n for n, w in warned.items() if w] == ["plain.pdf"]

    def recognise(asked):
        return asked.select("doc_id", "page_no", F.lit("seen").alias("text"), F.lit("engine").alias("ocr_engine"), F.lit(0.9).alias("confidence"))

    outcomes, blocks, _ = intake.process(df.filter("file_name like '%.pdf'"), recognise=recognise)
    kept = blocks.filter(F.col("doc_id") == names.index("plain.pdf")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["page_no"], r["text"][:9], r["ocr_engine"]) for r in kept] == [(1, 1, "long text", None), (2, 2, "seen", "engine")]


def test_sheets_follow_their_relationships(spark):
    """Parts of a workbook whose order isn't that of their numbers, and sheets that aren't worksheets."""
    from test_sources import XLSX, archive

    from pagewright.sources import office

    book = XLSX | {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Second" r:id="rId2"/><sheet name="Chart" r:id="rId9"/><sheet name="First" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="rId9" Target="chartsheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row r="1"><c r="A1"><v>2</v></c></row></sheetData></worksheet>',
    }
    rows = office.blocks(spark.createDataFrame([(1, "XLSX", bytearray(archive(book)))], "doc_id long, format string, content binary")).orderBy("ordinal").collect()
    assert [(r["type"], r["sheet_name"], r["text"]) for r in rows] == [("TITLE", "Second", "Second"), ("TABLE", "Second", "2"), ("TITLE", "First", "First"), ("TABLE", "First", "h |  | 3\n | 5 | ")]
