"""Headings, kinds, packing, duplicates and quality on small block tables."""

import math
import random
from collections import Counter

import pytest
from helpers import SF
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewright.functions import ids, numbers, secrecy, text, vectors
from pagewright.operators import access, blocks, builder, chunking, events, index, paging, quality, structure
from pagewright.plans import knowledge, tables


def block(o, kind, body, level=None, page=1, engine=None, confidence=None, doc=1, sheet=None, slide=None, parent=None, cells=None, heads=None, form="PDF"):
    return Row(doc_id=doc, ordinal=o, type=kind, text=body, heading_level=level, page_no=page, ocr_engine=engine, confidence=confidence, block_id=f"b{o}", sheet_name=sheet, slide_no=slide, parent_block_id=parent, cells=cells, header_rows=heads, file_format=form)


SCHEMA = "doc_id long, ordinal int, type string, text string, heading_level int, page_no int, ocr_engine string, confidence double, block_id string, sheet_name string, slide_no int, parent_block_id string, cells array<array<string>>, header_rows int, file_format string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_heading_path_is_cut_by_titles_of_the_same_level(spark):
    rows = [block(1, "TITLE", "制度", 1), block(2, "TITLE", "标准", 2), block(3, "PARAGRAPH", "a"), block(4, "TITLE", "B", 1), block(5, "CODE", "x"), block(6, "TITLE", "  ", 3), block(7, "PARAGRAPH", "b")]
    got = {r["ordinal"]: r["heading_path"] for r in structure.heading_stack(frame(spark, rows), "doc_id").collect()}
    assert got[3] == ["制度", "标准"] and got[5] == ["B"] and got[7] == ["B", "未命名标题 6"]


def test_answers_belong_to_their_question(spark):
    rows = [block(1, "TITLE", "FAQ", 1), block(2, "PARAGRAPH", "Q：x?"), block(3, "FOOTER", "f"), block(4, "PARAGRAPH", "A：y"), block(5, "PARAGRAPH", "问题：z?"), block(6, "PARAGRAPH", "A：w"), block(7, "PARAGRAPH", "第一条 c"), block(8, "PARAGRAPH", "p"), block(9, "FOOTNOTE", "n"), block(10, "LIST", " ")]
    got = {r["ordinal"]: r for r in structure.kinds(frame(spark, rows), "doc_id").collect()}
    assert [got[i]["kind"] for i in range(1, 11)] == ["TITLE", "FAQ", "DECORATION", "FAQ", "FAQ", "FAQ", "CLAUSE", "PROSE", "FOOTNOTE", "LIST"]
    assert got[2]["boundary"] == got[4]["boundary"] != got[5]["boundary"] == got[6]["boundary"]
    assert [i for i in got if not got[i]["include"]] == [1, 3, 9, 10] and got[8]["boundary"] == "heading:b1" and got[7]["boundary"] == "clause:b7"


def test_boundaries_and_patterns(spark):
    rows = [block(1, "PARAGRAPH", "a"), block(2, "PARAGRAPH", "b", sheet="S"), block(3, "PARAGRAPH", "c", slide=2), block(4, "TABLE", " "), block(5, "TABLE_ROW", "r", parent="t9"), block(6, "CODE", " "), block(7, "PARAGRAPH", " 第二编 x"), block(8, "PARAGRAPH", "第三项"), block(9, "PARAGRAPH", "1.2 x"), block(10, "PARAGRAPH", "第两条"), block(11, "PARAGRAPH", "q ：x"), block(12, "PARAGRAPH", " "), block(13, "TITLE", "t"), block(14, "PARAGRAPH", "Q. x"), block(15, "PARAGRAPH", "第〇章", slide=0)]
    got = {r["ordinal"]: r for r in structure.kinds(frame(spark, rows), "doc_id").collect()}
    assert [got[i]["boundary"] for i in range(1, 7)] == ["document-root", "sheet:S", "slide:2", "table:b4", "table:t9", "code:b6"]
    assert [got[i]["kind"] for i in range(7, 16)] == ["CLAUSE", "CLAUSE", "CLAUSE", "PROSE", "FAQ", "FAQ", "TITLE", "PROSE", "PROSE"]
    assert got[12]["include"] and got[4]["include"] and got[6]["include"] and got[15]["boundary"] == "heading:b13"


def test_outline_is_headings_and_kinds(spark):
    """All that one window adds is what the two windows add one after the other, nulls and blanks too."""
    rng = random.Random(16)
    types = ["TITLE", "PARAGRAPH", "LIST", "CODE", "TABLE", "TABLE_ROW", "HEADER", "FOOTER", "FOOTNOTE", None]
    texts = ["a", "", " ", None, "\u3000第一条 c ", "第两条", "1.2 x", "1 x", "问： z", "q :x", " Q：x?", "问题 : y", "\u00a02.1、", "Quite"]
    rows = [block(o, rng.choice(types), rng.choice(texts), rng.choice([None, 0, 1, 2, 6, 9]), doc=d, sheet=rng.choice([None, "", "S"]), slide=rng.choice([None, 0, 2]), parent=rng.choice([None, "t9"])) for d in range(6) for o in range(1, 60)]
    blocks_ = frame(spark, rows)
    one, two = structure.outlined(blocks_, "doc_id"), structure.kinds(structure.heading_stack(blocks_, "doc_id"), "doc_id")
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_kinds_of_blocks_send_no_texts(spark):
    """Rows are dealt out and sorted once, and without their texts where these aren't returned."""
    plan = knowledge.block_kinds(spark, SF)._jdf.queryExecution().optimizedPlan()
    below = []
    while not plan.children().isEmpty():
        if plan.nodeName() == "Window":
            below.append({plan.child().output().apply(i).name() for i in range(plan.child().output().size())})
        plan = plan.children().head()
    assert len(below) == 1 and "doc_id" in below[0] and not below[0] & {"text", "__body"}


def test_lines_of_odd_texts(spark):
    """Lines are what their definition, part by part, gives."""
    rng = random.Random(17)
    odd = ["", "\r", "\n", "\r\n", " ", "  ", "\t", "a", "b c", "\u00a0", "\u3000", "\x0b", "\x85", "第"]
    texts = [None, "", "a", "\r\r\n", "a\r\r\nb", "a \r b", " a\t\tb \n\n c  d\r"] + ["".join(rng.choices(odd, k=rng.randrange(30))) for _ in range(300)]
    texts += ["".join(rng.choices([x for x in odd if "\r" not in x], k=rng.randrange(30))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(blocks.lines(docs).collect()) == sorted(blocks.paragraphs(docs, r"\r?\n").collect())


def test_chunks_send_texts_once(spark):
    """Blocks are dealt out by document, and that is all that is sent; no table of texts is written on the way."""
    blocks_ = frame(spark, [block(1, "TITLE", "one", 1), block(2, "PARAGRAPH", "two")])
    plan = builder.chunks(blocks_, builder.Policy())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "FileScan" not in plan


def test_links_of_equal_blocks_and_pages(spark):
    """A parent names each block once for each place that it has in a child; neighbours and notes follow the children's order."""
    rows = [block(k, "PARAGRAPH", " ".join([f"w{k}"] * 60), page=k % 2) for k in range(1, 5)]
    chunks = builder.chunks(frame(spark, rows), builder.Policy(50, 100, 0))
    got = chunks.collect()
    own = sorted((r for r in got if r["granularity"] == "CHILD"), key=lambda r: r["ordinal"])
    assert len(own) == 8 and [r["next"] for r in own] == [r["chunk_id"] for r in own[1:]] + [None] and [r["previous"] for r in own] == [None] + [r["chunk_id"] for r in own[:-1]]
    links = builder.relations(chunks, frame(spark, rows).filter("ordinal = 1").select("doc_id", "page_no", "block_id")).collect()
    for up in (r for r in got if r["granularity"] == "PARENT"):
        wanted = {(b, i) for r in own if r["parent_chunk_id"] == up["chunk_id"] for i, b in enumerate(r["block_ids"])}
        found = [(r["to_block"], r["ordinal"]) for r in links if r["from_chunk"] == up["chunk_id"] and r["relation"] == "SOURCE_BLOCK"]
        assert len(found) == len(wanted) and set(found) == wanted
    assert [r["from_chunk"] for r in links if r["relation"] == "FOOTNOTE"] == [[r for r in own if r["places"][0]["page_no"] == 1][-1]["chunk_id"]]


def made(spark, rows, **policy):
    got = builder.chunks(frame(spark, rows), builder.Policy(**policy)).orderBy("ordinal").collect()
    return [r for r in got if r["granularity"] == "CHILD"], [r for r in got if r["granularity"] == "PARENT"]


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_chunks_hold_headings_and_budgets(spark):
    rows = [block(1, "TITLE", "T", 1), block(2, "PARAGRAPH", words(3, "a")), block(3, "PARAGRAPH", words(3, "b")), block(4, "PARAGRAPH", words(2, "c")), block(5, "PARAGRAPH", words(20, "d"))]
    own, up = made(spark, rows, child=8, parent=14, overlap=2)
    # one token of the headings counts: 3 + 3 + 1 fit, 2 more don't; 20 are cut to 7, each 2 into the one before
    assert [(r["block_ids"], r["token_count"], r["split_reason"]) for r in own] == [(["b2", "b3"], 7, "TOKEN_LIMIT"), (["b4"], 3, "TOKEN_LIMIT")] + [(["b5"], n, "TOKEN_LIMIT") for n in (8, 8, 8, 6)]
    assert own[0]["embedding_text"] == "标题路径：T\na0 a1 a2\n\nb0 b1 b2" and own[3]["display"].split()[0] == "d5"
    assert [(r["ordinal"], r["split_reason"], r["token_count"]) for r in up] == [(1, "PARENT_TOKEN_LIMIT", 9), (4, "PARENT_TOKEN_LIMIT", 8), (6, "PARENT_TOKEN_LIMIT", 8), (8, "PARENT_TOKEN_LIMIT", 14)] or [r["token_count"] for r in up][0] == 9
    assert all(r["token_count"] <= 14 for r in up) and {r["parent_chunk_id"] for r in own} == {r["chunk_id"] for r in up}
    with pytest.raises(Exception, match="no room"):
        made(spark, [block(1, "TITLE", words(9), 1), block(2, "PARAGRAPH", words(3))], child=8, parent=8, overlap=0)
    for bad in (dict(child=7), dict(child=10, parent=9), dict(child=10, parent=10, overlap=10)):
        with pytest.raises(ValueError):
            builder.Policy(**bad)


def test_repeated_texts_are_chunks_of_their_own(spark):
    rows = [block(1, "PARAGRAPH", "foot note", page=1), block(2, "PARAGRAPH", "body"), block(3, "PARAGRAPH", " Foot  NOTE", page=2), block(4, "PARAGRAPH", "end"), block(5, "FOOTNOTE", "n", page=2), block(6, "FOOTNOTE", "m", page=9)]
    own, up = made(spark, rows, child=50, parent=90, overlap=0)
    assert [(r["block_ids"], r["dedup_status"], r["duplicate_scope"], r["split_reason"]) for r in own] == [
        (["b1"], "UNIQUE", None, None), (["b2"], "UNIQUE", None, "TOKEN_LIMIT"), (["b3"], "SUPPRESSED_DUPLICATE", "CROSS_PAGE", None), (["b4"], "UNIQUE", None, "TOKEN_LIMIT")]
    assert own[2]["duplicate_of"] == own[0]["chunk_id"] and len(up) == 1
    kept, _ = made(spark, rows, child=50, parent=90, overlap=0, dedup="RETAIN")
    assert kept[2]["dedup_status"] == "RETAINED_DUPLICATE"
    chunks = builder.chunks(frame(spark, rows), builder.Policy(50, 90, 0))
    notes = frame(spark, rows).filter("type = 'FOOTNOTE'").select("doc_id", "page_no", "block_id")
    links = [tuple(r) for r in builder.relations(chunks, notes).collect()]
    assert len(links) == len(set(links)) and Counter(r[1] for r in links) == {"PARENT_CHILD": 4, "SOURCE_BLOCK": 8, "PREVIOUS": 3, "NEXT": 3, "DUPLICATE_OF": 1, "FOOTNOTE": 1}
    assert (own[2]["chunk_id"], "FOOTNOTE", None, "b5", 0) in links


def test_tables_repeat_their_header(spark):
    cells = [["h"]] + [[f"r{i}"] for i in range(4)] + [[words(12, "x")]]
    rows = [block(1, "TABLE", "t", cells=cells, heads=1), block(2, "TABLE", words(30)), block(3, "TABLE", "u", cells=[["only"]], heads=1), block(4, "TABLE", "")]
    own, _ = made(spark, rows, child=12, parent=40, overlap=4)
    first = [r for r in own if r["block_ids"] == ["b1"]]
    assert [r["split_reason"] for r in first] == ["TABLE_ROW_GROUP", "TABLE_ROW_GROUP", "TOKEN_LIMIT", "TOKEN_LIMIT"]
    assert [r["display"] for r in first[:2]] == ["| h |\n| r0 |\n| r1 |\n| r2 |", "| h |\n| r3 |"] and all(r["token_count"] <= 12 for r in own)
    assert [len(r["display"].split()) for r in own if r["block_ids"] == ["b2"]] == [12, 12, 6]
    assert [(r["display"], r["split_reason"]) for r in own if r["block_ids"] == ["b3"]] == [("| only |\n| only |", None)] and not [r for r in own if r["block_ids"] == ["b4"]]


def test_formats_and_sheets_say_what_a_chunk_is(spark):
    rows = [block(1, "PARAGRAPH", "a", form="PPTX", slide=1), block(2, "LIST", "b", form="PPTX", slide=1), block(3, "PARAGRAPH", "c", form="PPTX", slide=2), block(4, "LIST", "l", form="PPTX", slide=2)]
    own, up = made(spark, rows, child=50, parent=90, overlap=0)
    assert [(r["content_type"], r["block_ids"]) for r in own] == [("SLIDE", ["b1", "b2"]), ("SLIDE", ["b3", "b4"])] and len(up) == 2


def test_content_types(spark):
    rows = spark.createDataFrame([("PROSE", "PPTX"), ("LIST", "XLSX"), ("TABLE", "PPTX"), ("PROSE", "PDF"), ("PROSE", "CSV")], "k string, f string")
    assert [r[0] for r in rows.select(structure.content_type(F.col("k"), F.col("f"))).collect()] == ["SLIDE", "LIST", "TABLE", "PROSE", "SHEET"]


def test_packing_closes_a_pack_when_the_next_does_not_fit(spark):
    rows = spark.createDataFrame([("d", i, s) for i, s in enumerate([6, 5, 4, 20, 1, 1])], "doc string, ordinal int, tokens long")
    got = sorted(tuple(r) for r in chunking.pack(rows, ["doc"], "tokens", 10, 2).collect())
    assert got == [("d", 1, 0, 1, 6), ("d", 2, 1, 2, 9), ("d", 3, 3, 1, 20), ("d", 4, 4, 2, 2)]


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_packing_in_blocks_is_the_same(spark, block):
    rows = spark.createDataFrame([("ab"[i % 7 == 0], i, 30 if i % 41 == 0 else i * i % 11) for i in range(200)], "doc string, ordinal long, tokens long")
    got, want = chunking.pack_blocks(rows, ["doc"], "tokens", 20, 4, block=block), chunking.pack(rows, ["doc"], "tokens", 20, 4)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(got.collect()) == sorted(want.collect())


def test_windows_end_with_the_text(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(20)))), (2, None), (3, "a b")], "doc_id long, text string")
    got = [r["text"].split() for r in chunking.token_windows(docs, 10, 2).filter("doc_id = 1").orderBy("part").collect()]
    assert [g[0] for g in got] == ["0", "8", "16"] and got[-1][-1] == "19"
    assert chunking.token_windows(docs, 10, 2).filter("doc_id <> 1").count() == 1
    with pytest.raises(ValueError):
        chunking.token_windows(docs, 10, 10)


def test_duplicates_point_to_the_first(spark):
    rows = spark.createDataFrame([(1, 1, "A  b"), (1, 2, "a B"), (1, 3, "c"), (2, 1, "a b")], "doc_id long, ordinal int, text string")
    got = {(r["doc_id"], r["ordinal"]): (r["dedup_status"], r["duplicate_of"]) for r in chunking.duplicates(rows, ["doc_id"]).collect()}
    assert got[(1, 2)] == ("SUPPRESSED_DUPLICATE", 1) and got[(1, 1)] == got[(2, 1)] == ("UNIQUE", None)


def test_quality_verdicts(spark):
    def verdict(rows, expected=1, owner=True, version=True, children=(("CHILD", "UNIQUE"),)):
        chunks = spark.createDataFrame([(1, *c) for c in children], "doc_id long, granularity string, dedup_status string")
        m = quality.metrics(frame(spark, rows), chunks, "doc_id").withColumns({"expected_pages": F.lit(expected), "owner_ok": F.lit(owner), "version_ok": F.lit(version)})
        r = quality.verdict(m).first()
        return r["verdict"], r["findings"]

    good = [block(1, "TITLE", "t", 1), block(2, "PARAGRAPH", "p")]
    assert verdict(good) == ("PASS", [])
    assert verdict([block(1, "PARAGRAPH", "p", engine="e", confidence=0.5)], 2) == ("MANUAL_REVIEW", ["QUALITY_OCR_CONFIDENCE_LOW", "QUALITY_MISSING_PAGES"])
    assert verdict(good, 1, False, False) == ("REJECT", ["QUALITY_OWNER_MISSING", "QUALITY_VERSION_CONFLICT"])
    assert verdict([block(1, "PARAGRAPH", "\ufffd□ab")]) == ("REJECT", ["QUALITY_GARBLED_CRITICAL"])
    assert verdict([block(1, "PARAGRAPH", "□" * 15 + "a" * 85)])[1] == ["QUALITY_GARBLED_CRITICAL"] and verdict([block(1, "PARAGRAPH", "□" * 3 + "a" * 97)])[1] == []
    assert verdict([block(1, "PARAGRAPH", " ")]) == ("REJECT", ["QUALITY_PARSE_COVERAGE_CRITICAL"])
    assert verdict([block(i, "PARAGRAPH", "x" if i < 3 else " ") for i in range(10)]) == ("MANUAL_REVIEW", ["QUALITY_PARSE_COVERAGE_LOW"])
    assert verdict(good, 0) == ("PASS", []) and verdict([block(1, "PARAGRAPH", "p", page=2)], 1)[1] == ["QUALITY_MISSING_PAGES"]
    assert verdict([block(i, "PARAGRAPH", "p") for i in range(20)])[1] == ["QUALITY_STRUCTURE_WEAK"] and verdict([block(i, "PARAGRAPH", "p") for i in range(19)])[1] == []
    assert verdict(good, children=[("PARENT", "UNIQUE"), ("CHILD", "UNIQUE"), ("CHILD", "RETAINED_DUPLICATE")])[1] == ["QUALITY_DUPLICATE_RATIO_HIGH"]
    for cells, heads, bad in (([["a"], ["b"]], 1, False), (None, 1, True), ([], 0, True), ([["a"]], 2, True), ([[]], 0, True), ([["a"], ["b", "c"]], 1, True)):
        assert verdict([*good, block(3, "TABLE", "t", cells=cells, heads=heads)])[1] == (["QUALITY_TABLE_MALFORMED"] if bad else [])


def test_security_limits_ignore_what_is_not_known(spark):
    base = dict(malware=False, encrypted=False, has_macros=False, archive_depth=None, compressed_size_bytes=None, uncompressed_size_bytes=None, page_count=None, total_pixels=None, table_cell_count=None, embedded_object_count=0, external_link_count=0)
    schema = "archive_depth int, compressed_size_bytes long, embedded_object_count int, encrypted boolean, external_link_count int, has_macros boolean, malware boolean, page_count int, table_cell_count long, total_pixels long, uncompressed_size_bytes long, n int"
    rows = [base, base | {"compressed_size_bytes": 0, "uncompressed_size_bytes": 5}, base | {"external_link_count": 2}, base | {"malware": True}]
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple((r | {"n": i})[k] for k in names) for i, r in enumerate(rows)], schema)
    assert [r["verdict"] for r in quality.security_gate(df).orderBy("n").collect()] == ["CLEAN", "REJECTED", "MANUAL_REVIEW", "REJECTED"]


def test_text_expressions(spark):
    df = spark.createDataFrame([("  a\t b \r\n\r\n\r\n\r\nc\r ", "x/..\\..bad:na\x01me?.txt", "Ａb　 C")], "t string, n string, u string")
    r = df.select(text.normalize_block_text(F.col("t")), text.safe_file_name(F.col("n")), text.canonical(F.col("u"), compose=True), text.table_row(F.array(F.lit("a|b"), F.lit(None)))).first()
    assert tuple(r) == ("a b\n\nc", "bad_name_.txt", "ab c", "| a\\|b |  |")
    r = df.select(text.embedding_text(F.array(F.lit("a"), F.lit("b")), F.lit(" x ")), text.embedding_text(F.array().cast("array<string>"), F.lit("x")), text.short_summary(F.lit(" a \n b"), 2)).first()
    assert tuple(r) == ("标题路径：a > b\nx", "x", "a ")


def test_ids_and_numbers(spark):
    df = spark.range(1)
    salt = "11111111-1111-4111-8111-111111111111"
    r = df.select(ids.bucket(salt, F.lit("employee-42")), ids.canary(salt, F.lit("employee-42"), 20), numbers.clamp01(F.lit(float("nan"))), numbers.clamp01(F.lit(1.5)), numbers.stage_percent(F.lit(1), F.lit(3)), numbers.stage_percent(F.lit(1), F.lit(None).cast("int")), numbers.backoff_seconds(F.lit(20)), numbers.ratio(F.lit(1), F.lit(0))).first()
    assert tuple(r) == (49, "stable", 0.0, 1.0, 33.33, None, 256, 0.0)
    with pytest.raises(ValueError):
        ids.canary(salt, F.lit("u"), 100)


def test_vectors(spark):
    df = spark.range(1)
    a, b, zero = (F.array(*[F.lit(float(x)) for x in v]) for v in ((3, 4), (4, 3), (0, 0)))
    r = df.select(vectors.cosine(a, b), vectors.cosine(a, zero), vectors.cosine(a, F.array(F.lit(1.0))), vectors.norm(vectors.hashed(F.lit("x"), 48))).first()
    assert r[0] == pytest.approx(0.96) and (r[1], r[2]) == (-1, -1) and r[3] == pytest.approx(1)


def test_protected_texts_open_only_with_their_key(spark):
    df = spark.createDataFrame([("secret",)], "t string").select(secrecy.protect(F.col("t"), F.lit("k" * 16)).alias("p"))
    assert tuple(df.select(secrecy.reveal(F.col("p"), F.lit("k" * 16)), secrecy.reveal(F.col("p"), F.lit("j" * 16))).first()) == ("secret", None)


def test_access(spark):
    grants = spark.createDataFrame([(1, "USER", "u", ["READ"]), (2, "ROLE", "r", ["ADMIN"]), (3, "ROLE", "s", ["READ"])], "k int, subject_type string, subject_id string, permissions array<string>")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert sorted(r[0] for r in access.visible(rows, grants, "k", "u", ["r"], ["READ", "ADMIN"]).collect()) == [1, 2]
    assert access.visible(rows, grants, "k", "x", [], ["READ"], is_admin=True).count() == 3
    assert access.visible(rows, grants, "k", "x", [], ["READ"]).count() == 0
    got = {r["k"]: r["permissions"] for r in access.permission_union(grants, "k").collect()}
    assert got[2] == ["READ", "WRITE", "REVIEW", "ADMIN"] and got[1] == ["READ"]


def test_reconciliation_names_every_difference(spark):
    expected = spark.createDataFrame([("v1", "a"), ("v2", "b")], "vector_id string, content_sha256 string")
    actual = spark.createDataFrame([("v1", "f", "wrong"), ("v3", "c", "p")], "vector_id string, content_sha256 string, profile string")
    got = [tuple(r) for r in index.issues_in_order(index.reconcile(expected, actual, "p")).collect()]
    assert got == [("CONTENT_HASH_MISMATCH", "v1", True), ("MISSING_PRIMARY_KEY", "v2", True), ("PROFILE_MISMATCH", "v1", False), ("UNEXPECTED_PRIMARY_KEY", "v3", True)]
    ids_ = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    more = actual.unionByName(actual.limit(1).withColumn("vector_id", F.lit("v9")))
    codes = lambda f: {r["code"] for r in f.collect()}
    assert {"COUNT_MISMATCH", "FIXED_QUERY_MISMATCH"} <= codes(index.reconcile(expected, more, "p", ids_("a", "a"), ids_("a")))
    assert "FIXED_QUERY_MISMATCH" not in codes(index.reconcile(expected, more, "p", ids_("a", "b"), ids_("b", "a")))


def test_exact_search_in_blocks(spark, monkeypatch):
    """Passes over several blocks of queries, vectors of another length, zero and equal ones, scopes and ties."""
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(300)] + [(300, [0.0] * 4, 0), (301, [1.0] * 3, 0), (302, [2.0] * 4, 1), (303, [4.0] * 4, 1), (304, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    asked = df.filter("vec_id % 7 = 0 OR vec_id > 299").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "label")

    def cos(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return -1.0
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    monkeypatch.setattr(index, "MOST_QUERIES", 16)
    for scope in (None, "label"):
        want = {}
        for i, v, s in rows:
            if i % 7 == 0 or i > 299:
                scored = sorted((-round(cos(v, w), 9), j) for j, w, u in rows if scope is None or u == s)[:4]
                want[i] = scored
        got = {}
        for r in index.top_k(asked, df, 4, scope).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
        assert got == want


def test_recall_asks_every_vector(spark):
    got = tables.recall_at_k(spark, SF).first()
    assert got["cases"] == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_embedding_batches_respect_both_limits(spark):
    rows = spark.createDataFrame([("p", 1, 6), ("p", 2, 5), ("p", 3, 4)], "p string, ordinal int, tokens long")
    assert sorted((r["first"], r["n"]) for r in index.batches(rows, ["p"], 10, 2).collect()) == [(1, 1), (2, 2)]


def test_pages_and_cursors(spark):
    rows = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, at long")
    page = paging.keyset_page(rows, "at", "id", 3).collect()
    assert [r["id"] for r in page] == [9, 8, 7, 6]
    after = paging.keyset_page(rows, "at", "id", 3, (page[2]["at"], page[2]["id"])).collect()
    assert [r["id"] for r in after] == [6, 5, 4, 3]
    c = rows.filter("id = 3").select(paging.cursor("at", "id")).first()[0]
    assert paging.read_cursor(c) == {"at": 1, "id": 3}


def test_ordered_append_waits_for_what_is_missing(spark):
    rows = spark.createDataFrame([("k", s, a) for a, s in enumerate([1, 3, 1, 2, 3, 4])], "key string, sequence long, arrival int")
    got = [r["outcome"] for r in events.ordered_append(rows, "key").orderBy("arrival").collect()]
    assert got == ["APPENDED", "GAP", "DUPLICATE", "APPENDED", "APPENDED", "APPENDED"]
    # the first event of a key may have any number; a null key is a key; other columns aren't changed on the way
    rows = spark.createDataFrame([(None, 7, 0, 2**53 + 1), (None, 8, 1, None), (None, None, 2, 1), (None, 6, 3, 1), ("k", 58, 0, None), ("k", 60, 1, None)], "key string, sequence long, arrival int, big long")
    got = events.ordered_append(rows, "key").orderBy("key", "arrival").collect()
    assert [r["outcome"] for r in got] == ["APPENDED", "APPENDED", "GAP", "DUPLICATE", "APPENDED", "GAP"] and [r["big"] for r in got[:2]] == [2**53 + 1, None]


def test_reading_order_and_footnotes(spark):
    rows = spark.createDataFrame([(1, None, None, 0.5, 0.1, 0), (1, 2, None, 0.1, 0.1, 1), (1, 1, None, 0.9, 0.1, 2), (1, 1, None, 0.1, 0.5, 3)], "d int, page_no int, slide_no int, y1 double, x1 double, position int")
    assert [r["position"] for r in blocks.reading_order(rows, "d").orderBy("reading_ordinal").collect()] == [3, 2, 1, 0]
    notes = spark.createDataFrame([(1, None, "n")], "doc_id int, page_no int, note string")
    chunks = spark.createDataFrame([(1, None, "a", 1), (1, None, "b", 2), (1, 1, "c", 3)], "doc_id int, page_no int, chunk string, ordinal int")
    assert tuple(chunking.footnotes(notes, chunks).first()) == (1, "n", "b")


def test_leases_and_outbox(spark):
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    jobs = spark.createDataFrame([(1, "RUNNING", "me", 5), (2, "RUNNING", "you", 5), (3, "RUNNING", "me", -5)], "id int, status string, lease_owner string, s int")
    jobs = jobs.withColumn("lease_expires_at", now + F.make_dt_interval(secs=F.col("s")))
    got = {r["id"]: r["d"] for r in events.renew_leases(jobs, "me", now, 60).select("id", (F.unix_seconds("lease_expires_at") - F.unix_seconds(now)).alias("d")).collect()}
    assert got == {1: 60, 2: 5, 3: -5}
    rows = spark.createDataFrame([(1, True, 0), (2, False, 3), (3, False, 4)], "id int, ok boolean, attempts int").withColumn("available_at", now)
    got = {r["id"]: (r["state"], r["d"]) for r in events.outbox_results(rows, now, 5).select("id", "state", (F.unix_seconds("available_at") - F.unix_seconds(now)).alias("d")).collect()}
    assert got == {1: ("PUBLISHED", 0), 2: ("PENDING", 8), 3: ("DEAD", 0)}
    tokens = spark.createDataFrame([("u", ["a", "b", "x"])], "user string, groups array<string>")
    assert sorted(r["role"] for r in access.mapped_roles(tokens, {"a": ["r", "s"], "b": ["r"]}).collect()) == ["r", "s"]
    kinds = spark.createDataFrame([("ingestion.requested.v1",), ("ingestion.indexing.x",), ("index.built",), ("other",)], "e string")
    assert [r[0] for r in kinds.select(events.stage_of(F.col("e"))).collect()] == ["PARSE", "INDEX", "PROJECT", "UNKNOWN"]
