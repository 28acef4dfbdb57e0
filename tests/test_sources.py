"""File detection, decoding and parsers on generated files."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.sources import files, intake, markup, office


@pytest.mark.parametrize(
    ("name", "header", "expected"),
    [
        ("policy.pdf", bytes.fromhex("255044462d312e370a"), "PDF"), ("policy.docx", bytes.fromhex("504b030414000000"), "DOCX"),
        ("matrix.xlsx", bytes.fromhex("504b030414000000"), "XLSX"), ("a.zip", bytes.fromhex("504b030414000000"), None),
        ("scan.png", bytes.fromhex("89504e470d0a1a0a"), "IMAGE"), ("handbook.html", b"<!doctype html><p>", "HTML"), ("h.html", b"<p>no doctype", None),
        ("handbook.md", b"# t", "MARKDOWN"), ("notice.txt", b"n", "TEXT"), ("owners.csv", b"a,b", "CSV"), ("x.png", b"%PDF-1.7", None),
        ("nul.txt", b"a\x00b", None), ("bad.txt", b"\xff\xfea\xff", None), ("w.webp", b"RIFF\x00\x00\x00\x00WEBP", "IMAGE"), ("page.txt", b"<html><p>", "TEXT"), ("page.md", b"<!doctype html>", "MARKDOWN"),
    ],
)
def test_format(spark, name, header, expected):
    df = spark.createDataFrame([(name, bytearray(header))], "n string, h binary")
    assert df.select(files.file_format(F.col("h"), F.col("n"))).first()[0] == expected


def test_refusals_say_why(spark):
    rows = [("x.png", b"%PDF-1"), ("a.zip", b"PK\x03\x04"), ("a.txt", b"GIF89a"), ("b.bin", b"a\x00"), ("c.htm", b"<p>"), ("d", b"text"), ("e.csv", b"a")]
    df = spark.createDataFrame([(n, bytearray(h)) for n, h in rows], "n string, h binary")
    want = ["EXTENSION_MAGIC_MISMATCH", "UNSUPPORTED_ZIP_CONTAINER", "EXTENSION_MAGIC_MISMATCH", "UNSUPPORTED_BINARY_FORMAT", "HTML_SIGNATURE_MISMATCH", "UNSUPPORTED_TEXT_EXTENSION", None]
    assert [r[0] for r in df.select(files.detection(F.col("h"), F.col("n"))["code"]).collect()] == want


def test_files_become_outcomes_and_blocks(spark):
    """Every format in one table; a file is told by its first problem, and only completed ones have blocks."""
    from pagewright.sources import intake

    long_text = ("x" * 8191 + "ä rest").encode()
    rows = [("page.html", "text/html", b"<!doctype html><h1>t</h1><p>p"), ("out.html", "text/html", b"<html><a href='//x'>y</a>"), ("obj.html", "text/html", b"<html><embed src=x>"), ("n.md", "", b"# t\n\np"), ("n.txt", "text/plain", b"a\n\nb\nc"),
            ("n.csv", "text/csv", b"a,b\n1,2"), ("x.txt", "text/plain", b"MZ"), ("y.txt", "image/png", b"y"), ("d.docx", files.OFFICE + "wordprocessingml.document", archive(DOCX)), ("bad.docx", "", b"PK\x03\x04zz"), ("long.txt", "", long_text), ("p.png", "image/png", bytes.fromhex("89504e470d0a1a0a") + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 30000, 30000)), ("e.txt", "", b"")]
    df = spark.createDataFrame([(i, n, m, bytearray(c), None, None) for i, (n, m, c) in enumerate(rows)], "doc_id long, file_name string, declared_mime string, content binary, declared_size long, declared_sha256 string")
    outcomes, blocks, _ = intake.process(df)
    got = {rows[r["doc_id"]][0]: (r["outcome"], r["code"], r["n_blocks"]) for r in outcomes.collect()}
    assert got == {
        "page.html": ("COMPLETED", None, 2), "out.html": ("MANUAL_REVIEW", "EXTERNAL_LINK_FOUND", 0), "obj.html": ("MANUAL_REVIEW", "EMBEDDED_OBJECT_FOUND", 0), "n.md": ("COMPLETED", None, 2), "n.txt": ("COMPLETED", None, 2), "n.csv": ("COMPLETED", None, 1),
        "x.txt": ("REJECTED", "MALWARE_DETECTED", 0), "y.txt": ("FAILED", "MIME_MAGIC_MISMATCH", 0), "d.docx": ("COMPLETED", None, got["d.docx"][2]), "bad.docx": ("FAILED", "OOXML_ZIP_INVALID", 0), "long.txt": ("COMPLETED", None, 1), "p.png": ("REJECTED", "PIXEL_LIMIT_EXCEEDED", 0), "e.txt": ("COMPLETED", None, 0)}
    assert got["d.docx"][2] > 0 and blocks.count() == sum(n for *_, n in got.values())
    assert {r["doc_id"]: list(r["warnings"]) for r in outcomes.collect()}[3] == ["DECLARED_MIME_GENERIC"]


def test_mime_scanner_and_decoding(spark):
    df = spark.createDataFrame([(bytearray(c),) for c in (b"MZx", b"ok", b"aX5O!EICAR-STANDARD-ANTIVIRUS-TEST-FILE", b"#!/bin/sh")], "c binary")
    assert [r[0] for r in df.select(files.malware(F.col("c"))).collect()] == [True, False, True, True]
    one = spark.range(1)
    r = one.select(files.mime_issue(F.lit("Text/Plain; charset=x"), F.lit("TEXT")), files.mime_issue(F.lit(None).cast("string"), F.lit("PDF")), files.mime_issue(F.lit("image/png"), F.lit("PDF"))).first()
    assert tuple(r) == (None, "DECLARED_MIME_GENERIC", "MIME_MAGIC_MISMATCH")
    texts = ["ä".encode(), b"\xef\xbb\xbf" + "ä".encode(), b"\xff\xfe" + "ä".encode("utf-16-le"), b"\xfe\xff" + "ä".encode("utf-16-be"), b"\xff\xff"]
    df = spark.createDataFrame([(bytearray(c),) for c in texts], "c binary")
    assert [r[0] for r in df.select(files.decoded(F.col("c"))).collect()] == ["ä"] * 4 + [None]


def test_image_sizes(spark):
    png = bytes.fromhex("89504e470d0a1a0a") + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 3, 4)
    gif = b"GIF89a" + struct.pack("<HH", 3, 4)
    bmp = b"BM" + b"\x00" * 12 + struct.pack("<Iii", 40, 3, 4)
    df = spark.createDataFrame([(bytearray(c),) for c in (png, gif, bmp, b"no")], "c binary")
    assert [r[0] and tuple(r[0]) for r in df.select(files.image_size(F.col("c"))).collect()] == [(3, 4)] * 3 + [None]


def test_files_are_read_and_observed(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    rows = files.observed(files.read_files(spark, str(tmp_path))).withColumns({"declared_size": F.lit(5), "declared_sha256": F.lit("x")})
    r = files.integrity(rows).first()
    assert (r["file_name"], r["size_bytes"], r["issue"]) == ("a.txt", 5, "OBJECT_HASH_CHANGED")


def parsed(spark, parse, body):
    return [(r["type"], r["text"], r["heading_level"], r["cells"]) for r in markup.blocks(spark.createDataFrame([(1, body)], "doc_id long, text string"), parse).orderBy("ordinal").collect()]


def test_html(spark):
    page = '<html><head><title>x</title></head><body><h1>制度</h1><script>var t="</p>"</script><p><b>正文<p>two<table><tr><th colspan="2">a<tr><td>1</td></tr></table><ul><li><p>i</p></ul><pre>a\n b</pre><img alt="z"></body>'
    got = parsed(spark, markup.html_blocks_of, page.replace("<tr><td>", "</th></tr><tr><td>"))
    assert [g[:3] for g in got] == [("TITLE", "制度", 1), ("PARAGRAPH", "正文", None), ("PARAGRAPH", "two", None), ("TABLE", "a\n1", None), ("LIST", "i", None), ("CODE", "a\n b", None), ("IMAGE", "z", None)]
    assert got[3][3] == [["a"], ["1"]]


def test_html_with_end_tags_left_out():
    page = "<html><head><title>x</title><meta charset=utf-8><body><p>one<table><tr><th>a<th>b<tr><td>1<td>2</table><p>two<table><tr><td>3<td>4"
    got = markup.html_blocks_of(page)
    assert [g[:2] for g in got] == [("PARAGRAPH", "one"), ("TABLE", "a | b\n1 | 2"), ("PARAGRAPH", "two"), ("TABLE", "3 | 4")]
    assert [g[4] for g in got] == [None, 1, None, 0]
    assert [g[:2] for g in markup.html_blocks_of("<head><title>x</title><h1>t</h1><p>u")] == [("TITLE", "t"), ("PARAGRAPH", "u")]
    raw = '<html><head><title>x</title></head><body><p>two<table><tr><th colspan="2">a<tr><td>1</td></tr></table>'
    assert markup.html_blocks_of(raw)[1][3] == [["a"], ["1"]]


def test_html_nested_tables():
    got = markup.html_blocks_of("<table><tr><td>a<table><tr><td>x<td>y</table>b<td>c</tr><tr><td>d<td>e</table><p>z")
    assert [g[:2] for g in got] == [("TABLE", "a b | c\nd | e"), ("TABLE", "x | y"), ("PARAGRAPH", "z")]


def test_html_row_spans(spark):
    page = "<table><tr><th rowspan=2>a<th colspan=2>b<th>c<tr><td>d<td rowspan=3 colspan=2>e<tr><td>f<td>g<tr><td>h<td>i</table>"
    r = markup.blocks(spark.createDataFrame([(1, page)], "doc_id long, text string"), markup.html_blocks_of).first()
    assert r["cells"] == [["a", "b", "", "c"], ["", "d", "e", ""], ["f", "g", "", ""], ["h", "i", "", ""]]
    assert [tuple(m) for m in r["merged_cells"]] == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 2, 3, 2)]


def test_markdown_and_csv(spark):
    got = parsed(spark, markup.markdown_blocks_of, "# 标题\n\n- 列表\n\n```ts\nx\n```\npara\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert [g[:3] for g in got] == [("TITLE", "标题", 1), ("LIST", "列表", None), ("CODE", "x", None), ("PARAGRAPH", "para more", None), ("TABLE", "a | b\n1 | 2", None)]
    got = parsed(spark, markup.csv_blocks_of, '姓名,部门\n张三,研发\n李四,"销售,华东"')
    assert got[0][3] == [["姓名", "部门"], ["张三", "研发"], ["李四", "销售,华东"]]
    assert parsed(spark, markup.csv_blocks_of, "") == []


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = {"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>'}
XLSX = {
    "xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>',
    "xl/sharedStrings.xml": "<sst><si><t>h</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>',
}
PPTX = {"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": '<s xmlns:p="p" xmlns:a="a"><p:sp><a:t>later</a:t></p:sp></s>', "ppt/slides/slide2.xml": '<s xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:t>first</a:t></p:sp></s>'}


def test_office_archives(spark):
    rows = [(1, "DOCX", bytearray(archive(DOCX))), (2, "XLSX", bytearray(archive(XLSX))), (3, "PPTX", bytearray(archive(PPTX))), (4, "DOCX", bytearray(b"no zip"))]
    got = {}
    for r in office.blocks(spark.createDataFrame(rows, "doc_id long, format string, content binary")).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append((r["type"], r["text"]))
    assert got[1] == [("TITLE", "T"), ("PARAGRAPH", "a"), ("TABLE", "x | ")]
    assert got[2] == [("TITLE", "S"), ("TABLE", "h |  | 3\n | 5 | ")]
    assert got[3] == [("TITLE", "first"), ("PARAGRAPH", "later")] and 4 not in got
    assert office.column_number("A") == 1 and office.column_number("AA") == 27


def test_office_details(spark):
    word = {"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p><w:r><w:drawing><w:docPr descr="cat"/></w:drawing></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr>'
            '<w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr></w:tc></w:tr></w:tbl></w:body></w:document>', "word/media/1.png": "x", "word/media/2.png": "y"}  # fmt: skip
    sheet = {"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
             "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="2"><c r="A2" t="b"><v>1</v></c><c r="B2" s="1"><v>1.5</v></c><c r="C2" s="2"><v>36526</v></c><c r="D2" s="3"><v>7</v></c></row><row r="3"/><row r="5"><c r="A5"><f>A1+1</f><v>2</v></c><c r="B5"><f>NOW()</f></c><c r="C5" t="e"><v>#N/A</v></c><c r="D5"><v>9</v></c></row></sheetData><mergeCells><mergeCell ref="C5:D5"/></mergeCells></worksheet>'}
    slide = {"ppt/presentation.xml": '<p><sldSz cx="1000" cy="500"/></p>', "ppt/slides/slide3.xml": '<s><sp><xfrm><off x="100" y="50"/><ext cx="500" cy="600"/></xfrm><t>a</t><t>b</t></sp><pic><cNvPr name="n" descr="dog"/></pic><graphicFrame><tbl><tr><tc><t>1</t></tc><tc/></tr></tbl></graphicFrame></s>'}
    rows = [(1, "DOCX", bytearray(archive(word))), (2, "XLSX", bytearray(archive(sheet))), (3, "PPTX", bytearray(archive(slide)))]
    got = {1: [], 2: [], 3: []}
    for r in office.blocks(spark.createDataFrame(rows, "doc_id long, format string, content binary")).orderBy("doc_id", "ordinal").collect():
        got[r["doc_id"]].append(r)
    assert [(r["type"], r["text"]) for r in got[1]] == [("LIST", "item"), ("IMAGE", "cat"), ("TABLE", "wide |  | tall\na | b | "), ("IMAGE", "")]
    assert {tuple(m) for m in got[1][2]["merged_cells"]} == {(0, 0, 1, 2), (0, 2, 2, 1)}
    table = got[2][1]
    assert table["cells"] == [["true", "1899-12-31T12:00:00.000Z", "2000-01-01T00:00:00.000Z", "7"], ["2", "=NOW()", "#N/A", ""]] and table["sheet_name"] == "S"
    assert [tuple(m) for m in table["merged_cells"]] == [(1, 2, 1, 2)] and [tuple(f) for f in table["formulas"]] == [("A5", "A1+1", "2"), ("B5", "NOW()", None)]
    assert [(r["type"], r["text"], r["slide_no"]) for r in got[3]] == [("PARAGRAPH", "a\nb", 3), ("IMAGE", "dog", 3), ("TABLE", "1 | ", 3)] and tuple(got[3][0]["bbox"]) == (0.1, 0.1, 0.6, 1.0)


def test_children_of_groups_are_placed_on_the_slide(spark):
    group = '<grpSp><grpSpPr><xfrm><off x="{0}" y="{1}"/><ext cx="{2}" cy="{3}"/><chOff x="{4}" y="{5}"/><chExt cx="{6}" cy="{7}"/></xfrm></grpSpPr>{8}</grpSp>'
    shape = '<sp><spPr><xfrm><off x="200" y="200"/><ext cx="200" cy="100"/></xfrm></spPr><t>{0}</t></sp>'
    inner = group.format(0, 0, 400, 400, 0, 0, 800, 800, shape.format("deep"))
    slide = {"ppt/presentation.xml": '<p><sldSz cx="1000" cy="1000"/></p>', "ppt/slides/slide1.xml": f"<s>{shape.format('top')}{group.format(100, 300, 200, 200, 0, 0, 400, 400, shape.format('child') + inner)}<grpSp>{shape.format('plain')}</grpSp></s>"}
    rows = office.blocks(spark.createDataFrame([(1, "PPTX", bytearray(archive(slide)))], "doc_id long, format string, content binary")).orderBy("ordinal").collect()
    want = {"top": (0.2, 0.2, 0.4, 0.3), "child": (0.2, 0.4, 0.3, 0.45), "deep": (0.15, 0.35, 0.2, 0.375), "plain": (0.2, 0.2, 0.4, 0.3)}
    assert [r["text"] for r in rows] == list(want) and all(abs(a - b) < 1e-9 for r in rows for a, b in zip(r["bbox"], want[r["text"]], strict=True))


def test_images_are_targets_with_their_places(spark):
    rel = '<Relationships><Relationship Id="{0}" Target="{1}"/></Relationships>'
    book = XLSX | {
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c></row><row r="10"><c r="E10"><v>5</v></c></row></sheetData><drawing id="r1"/></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": rel.format("r1", "../drawings/drawing1.xml"), "xl/drawings/_rels/drawing1.xml.rels": rel.format("r9", "../media/b.png"), "xl/media/b.png": "x", "xl/media/a.png": "y",
        "xl/drawings/drawing1.xml": '<wsDr xmlns:r="r"><twoCellAnchor><from><col>1</col><row>2</row></from><to><col>3</col><row>20</row></to><pic><blip r:embed="r9"/></pic></twoCellAnchor><twoCellAnchor><from/><to/><sp/></twoCellAnchor><oneCellAnchor><from><col>0</col><row>0</row></from><pic/></oneCellAnchor></wsDr>',
    }
    slide = {"ppt/presentation.xml": '<p><sldSz cx="100" cy="100"/></p>', "ppt/slides/slide1.xml": '<s xmlns:r="r"><pic><blip r:embed="r2"/><xfrm><off x="10" y="20"/><ext cx="30" cy="40"/></xfrm></pic></s>', "ppt/slides/_rels/slide1.xml.rels": rel.format("r2", "../media/p.png"), "ppt/media/p.png": "z"}
    word = DOCX | {"word/media/2.png": "x", "word/media/1.png": "y"}
    rows = [(1, "XLSX", bytearray(archive(book))), (2, "PPTX", bytearray(archive(slide))), (3, "DOCX", bytearray(archive(word))), (4, "DOCX", bytearray(b"no zip")), (5, "XLSX", bytearray(archive(book | {"xl/drawings/drawing1.xml": "<a"})))]
    got = sorted((r["doc_id"], r["target_id"], r["sheet_name"], r["slide_no"], None if r["bbox"] is None else tuple(r["bbox"]), r["entry"]) for r in office.image_targets(spark.createDataFrame(rows, "doc_id long, format string, content binary")).collect())
    assert got == [
        (1, "xlsx-1-image-1", "S", None, (0.2, 0.2, 0.6, 1.0), "xl/media/b.png"), (1, "xlsx-1-image-2", "S", None, None, None), (2, "pptx-slide-1-image-1", None, 1, (0.1, 0.2, 0.4, 0.6), "ppt/media/p.png"),
        (3, "docx-image-1", None, None, None, "word/media/1.png"), (3, "docx-image-2", None, None, None, "word/media/2.png")]


def test_archives_are_inspected(spark):
    bad = {"a": archive(DOCX | {"../x": "y"}), "b": archive(DOCX | {"word/vbaProject.bin": "m", "word/embeddings/o.bin": "e", "word/_rels/d.rels": '<r><x TargetMode="External"/></r>'}), "c": b"", "d": archive({"x": "y"})}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items()], "path string, content binary")
    got = {r["path"]: r for r in office.inspected(df).collect()}
    assert [got[k]["issue"] for k in "abcd"] == ["OOXML_UNSAFE_ENTRY_PATH", None, "OOXML_ZIP_INVALID", "OOXML_FORMAT_AMBIGUOUS"]
    assert (got["b"]["has_macros"], got["b"]["embedded_object_count"], got["b"]["external_link_count"]) == (True, 1, 1)


def test_link_kinds(spark):
    df = spark.createDataFrame([(u,) for u in ("", "data:x", "/a", "https://x", "//x", "javascript:1", "#a", None)], "u string")
    assert [r[0] for r in df.select(markup.link_kind(F.col("u"))).collect()] == ["EMPTY", "DATA", "LOCAL", "EXTERNAL", "EXTERNAL", "LOCAL", "LOCAL", "EMPTY"]
    assert [r[0] for r in df.select(markup.leaves(F.col("u"))).collect()] == [False, False, False, True, True, True, False, False]
    page = spark.createDataFrame([(1, "<a class='x' HREF = 'mailto:a'>b</a><IMG src=\"//c\"><p title='<'>")], "k int, html string")
    assert [r["url"] for r in markup.links(page, "k").collect()] == ["mailto:a", "//c"]


def test_snapshots_are_replaced_only_when_they_change(spark, tmp_path):
    import os

    from pagewright.sources import snapshots

    path = str(tmp_path / "blocks")
    schema = "document_version_id string, content_revision int, ordinal int, content_sha256 string"

    def put(rows):
        snapshots.put_snapshots(spark.createDataFrame(rows, schema), path)
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    first = put([("v", 1, 1, "a"), ("v", 1, 2, "b"), ("w", 1, 1, "c")])
    assert put([("v", 1, 2, "b"), ("v", 1, 1, "a")]) == first
    again = put([("v", 1, 1, "x")])
    assert {p for p in first if "=w" in p} <= set(again) and not {p for p in first if "=v" in p} & set(again)
    assert spark.read.parquet(path).count() == 2


def test_vectors_by_manifest(spark, tmp_path):
    from pagewright.sources import snapshots

    path = str(tmp_path / "v")
    df = spark.createDataFrame([("m1", "a", "h", "p"), ("m1", "a", "h", "p"), ("m2", "b", "h", "p")], "manifest_id string, vector_id string, content_sha256 string, embedding_profile_id string")
    snapshots.put_vectors(df, path)
    snapshots.put_vectors(df.filter("manifest_id = 'm2'"), path)
    got = snapshots.scan_vectors(spark, path, "m1")
    assert got.columns == ["vector_id", "content_sha256", "embedding_profile_id"] and got.count() == 1
    assert "PartitionFilters: [isnotnull(manifest_id" in got._jdf.queryExecution().toString()
    assert snapshots.drop_vectors(spark.read.parquet(path), df.filter("manifest_id = 'm1'")).count() == 1


def test_layout_results(spark):
    from pagewright.sources import snapshots

    body = '{"texts":[{"label":"section_header","text":"T","level":2,"prov":[{"page_no":1,"bbox":{"l":10,"t":90,"r":50,"b":80,"coord_origin":"BOTTOMLEFT"}}]},{"label":"odd","text":"x"}],"pages":{"1":{"size":{"width":100,"height":100}}}}'
    rows = snapshots.layout_blocks(spark.createDataFrame([(1, body)], "doc_id long, json string")).orderBy("ordinal").collect()
    assert (rows[0]["type"], rows[0]["heading_level"], rows[0]["page_no"]) == ("TITLE", 2, 1)
    assert tuple(rows[0]["bbox"]) == pytest.approx((0.1, 0.1, 0.5, 0.2)) and (rows[1]["type"], rows[1]["bbox"]) == ("PARAGRAPH", None)


def test_walked_image_headers(spark):
    from pagewright.sources import images

    jpeg = b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0\x00\x11\x08\x00\x04\x00\x03" + b"\x00" * 12
    tiff = b"II*\x00\x08\x00\x00\x00\x02\x00" + struct.pack("<HHIHH", 256, 3, 1, 3, 0) + struct.pack("<HHII", 257, 4, 1, 4)
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X" + b"\x00" * 8 + (2).to_bytes(3, "little") + (3).to_bytes(3, "little")
    lossless = b"RIFF\x00\x00\x00\x00WEBPVP8L\x00\x00\x00\x00\x2f" + (2 | 3 << 14).to_bytes(4, "little")
    rows = [("a", "JPEG", jpeg), ("b", "TIFF", tiff), ("c", "WEBP", webp), ("d", "WEBP", lossless), ("e", "JPEG", b"\xff\xd8"), ("f", "TIFF", b"II")]
    got = {r["path"]: (r["width"], r["height"]) for r in images.sizes(spark.createDataFrame([(p, k, bytearray(c)) for p, k, c in rows], "path string, kind string, content binary")).collect()}
    assert got == {**{k: (3, 4) for k in "abcd"}, "e": (None, None), "f": (None, None)}


def test_texts_of_files_are_not_sent_to_meet_their_verdict(spark, monkeypatch):
    """Files that no parser need open go from their row to their blocks without a join."""
    texts = spark.createDataFrame([(1, "d.txt", "text/plain", b"one\n\ntwo"), (2, "e.html", "text/html", b"<html><p>x</p></html>")], "doc_id long, file_name string, declared_mime string, content binary")
    good, real = [], intake.blocks
    monkeypatch.setattr(intake, "blocks", lambda rows, pages: (good.append(rows), real(rows, pages))[1])
    found = intake.process(texts.withColumns({"declared_size": F.octet_length("content").cast("long"), "declared_sha256": F.lit(None).cast("string")}))
    plan = good[0]._jdf.queryExecution().analyzed()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().head().toString()
    assert sorted((r["doc_id"], r["file_format"], r["text"]) for r in found.blocks.collect()) == [(1, "TEXT", "one"), (1, "TEXT", "two"), (2, "HTML", "x")]
