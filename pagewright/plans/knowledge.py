"""Documents to knowledge chunks with their relations and quality, on blocks that reach every rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import blocks, builder, quality, review, structure, tokens
from pagewright.plans.registry import query
from pagewright.plans.texts import LINES, sql_canon, sql_norm, sql_words
from pagewright.shared import batches_of, table, write_shared
from pagewright.sources import intake

POLICY = builder.Policy(child=32, parent=96, overlap=4)

# Lines get types, levels and places from their lengths and numbers, so that every kind, boundary and place comes up.
_N = "length(text) % 23"
RICH = f"""{LINES}, b0 AS (
        SELECT doc_id, lang, ordinal, 'b' || doc_id || '.' || ordinal AS block_id,
            CASE WHEN text NOT LIKE '% %' THEN 'TITLE' ELSE coalesce((['TABLE', 'CODE', 'LIST', 'HEADER', 'FOOTER', 'FOOTNOTE', 'TABLE_ROW'])[1 + {_N}], 'PARAGRAPH') END AS type,
            CASE WHEN text NOT LIKE '% %' AND length(text) % 5 = 0 THEN '' WHEN text NOT LIKE '% %' THEN text WHEN {_N} = 7 THEN '第三条 ' || text WHEN {_N} = 8 THEN 'q ： ' || text
                 WHEN {_N} = 9 THEN '2.1 ' || text WHEN {_N} = 10 THEN ' ' ELSE text END AS text,
            CASE WHEN text NOT LIKE '% %' AND length(text) % 7 <> 0 THEN 1 + length(text) % 6 END AS heading_level,
            CASE WHEN ordinal % 19 <> 0 THEN (ordinal - 1) // 20 + 1 END AS page_no,
            CASE WHEN ordinal % 40 BETWEEN 30 AND 33 THEN 'S' || (ordinal // 40) END AS sheet_name,
            CASE WHEN ordinal % 40 BETWEEN 35 AND 37 THEN ordinal // 40 + 1 END AS slide_no,
            CASE WHEN text LIKE '% %' AND {_N} = 6 THEN 'p' || (ordinal // 10) END AS parent_block_id,
            CASE doc_id % 4 WHEN 0 THEN 'PPTX' WHEN 1 THEN 'XLSX' ELSE 'PDF' END AS file_format
        FROM lines)"""


def _rich(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = blocks.lines_with(docs, "lang").withColumns({"size": F.char_length("text"), "single": ~F.col("text").contains(" ")})  # counted once
    size, single, o = F.col("size"), F.col("single"), F.col("ordinal")
    n = size % 23
    kinds = F.array(*[F.lit(x) for x in ("TABLE", "CODE", "LIST", "HEADER", "FOOTER", "FOOTNOTE", "TABLE_ROW")])
    body = (
        F.when(single & (size % 5 == 0), "").when(single, F.col("text")).when(n == 7, F.concat(F.lit("第三条 "), "text"))
        .when(n == 8, F.concat(F.lit("q ： "), "text")).when(n == 9, F.concat(F.lit("2.1 "), "text")).when(n == 10, " ").otherwise(F.col("text"))
    )
    number = F.floor(o / 40)
    return lines.select(
        "doc_id", "lang", "ordinal", F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit("."), o.cast("string")).alias("block_id"),
        F.when(single, "TITLE").otherwise(F.coalesce(F.try_element_at(kinds, 1 + n), F.lit("PARAGRAPH"))).alias("type"), body.alias("text"),
        F.when(single & (size % 7 != 0), 1 + size % 6).alias("heading_level"),
        F.when(o % 19 != 0, (F.floor((o - 1) / 20) + 1).cast("int")).alias("page_no"),
        F.when((o % 40).between(30, 33), F.concat(F.lit("S"), number.cast("string"))).alias("sheet_name"), F.when((o % 40).between(35, 37), (number + 1).cast("int")).alias("slide_no"),
        F.when(~single & (n == 6), F.concat(F.lit("p"), F.floor(o / 10).cast("string"))).alias("parent_block_id"),
        F.when(F.col("doc_id") % 4 == 0, "PPTX").when(F.col("doc_id") % 4 == 1, "XLSX").otherwise("PDF").alias("file_format"),
        F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(None).cast("int").alias("header_rows"),
    )


_LEVEL = "coalesce(heading_level, 1)"
_SPACE = text.SPACE


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_SLOTS = ", ".join(f"max(CASE WHEN type = 'TITLE' AND {_LEVEL} = {k} THEN ordinal END) OVER w AS o{k}" for k in range(1, 7))
_PATH = ", ".join(f"CASE WHEN {f'o{k} > greatest(' + ', '.join(f'coalesce(o{j}, 0)' for j in range(1, k)) + ', 0)' if k > 1 else 'o1 > 0'} THEN t{k}.title END" for k in range(1, 7))
_JOINS = " ".join(f"LEFT JOIN titles t{k} ON t{k}.doc_id = s.doc_id AND t{k}.ordinal = s.o{k}" for k in range(1, 7))

# kinds, boundaries and paths of the blocks
_KINDS = rf"""s AS (SELECT *, {_trim("text")} AS body, {_SLOTS}, max(CASE WHEN type = 'TITLE' THEN ordinal END) OVER w AS titled,
            max(CASE WHEN plain AND NOT clause AND question THEN ordinal END) OVER w AS asked, max(CASE WHEN type IN ('TITLE', 'TABLE', 'TABLE_ROW', 'CODE') OR (plain AND clause) THEN ordinal END) OVER w AS ended
          FROM (SELECT *, type IN ('PARAGRAPH', 'LIST') AS plain, regexp_matches({_trim("text")}, '^(第[一二三四五六七八九十百千0-9]+[编章节条款项]|[0-9]+(\.[0-9]+)+[.、\s])') AS clause,
                       regexp_matches({_trim("text")}, '^(Q|q|问|问题)\s*[:：]') AS question FROM b0) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
    titles AS (SELECT doc_id, ordinal, CASE WHEN {_trim("text")} = '' THEN '未命名标题 ' || ordinal ELSE {_trim("text")} END AS title FROM b0 WHERE type = 'TITLE'),
    k0 AS (SELECT s.*, list_filter([{_PATH}], lambda x: x IS NOT NULL) AS path,
            CASE WHEN type = 'TITLE' THEN 'TITLE' WHEN type IN ('HEADER', 'FOOTER') THEN 'DECORATION' WHEN type = 'FOOTNOTE' THEN 'FOOTNOTE' WHEN type IN ('TABLE', 'TABLE_ROW') THEN 'TABLE'
                 WHEN type = 'CODE' THEN 'CODE' WHEN clause THEN 'CLAUSE' WHEN asked > coalesce(ended, -1) THEN 'FAQ' WHEN type = 'LIST' THEN 'LIST' ELSE 'PROSE' END AS kind FROM s {_JOINS}),
    k AS (SELECT *, CASE kind WHEN 'TABLE' THEN 'table:' || coalesce(parent_block_id, block_id) WHEN 'FAQ' THEN 'faq:b' || doc_id || '.' || asked WHEN 'DECORATION' THEN 'decoration:' || block_id
                WHEN 'FOOTNOTE' THEN 'footnote:' || block_id WHEN 'CODE' THEN 'code:' || block_id WHEN 'CLAUSE' THEN 'clause:' || block_id
                ELSE CASE WHEN kind <> 'TITLE' AND sheet_name <> '' THEN 'sheet:' || sheet_name WHEN kind <> 'TITLE' AND slide_no <> 0 THEN 'slide:' || slide_no
                     WHEN titled IS NULL THEN 'document-root' ELSE 'heading:b' || doc_id || '.' || titled END END AS boundary,
            kind IN ('TABLE', 'CODE', 'CLAUSE', 'FAQ') OR (kind IN ('LIST', 'PROSE') AND body <> '') AS include FROM k0)"""
KINDS = f"{RICH}, {_KINDS}"


@query(f"WITH {KINDS} SELECT doc_id, ordinal::INT AS ordinal, kind, boundary, include, array_to_string(path, ' > ') AS path FROM k")
def block_kinds(spark, sf_dir):
    found = structure.outlined(_rich(spark, sf_dir), "doc_id")
    return found.select("doc_id", "ordinal", "kind", "boundary", "include", F.array_join("heading_path", " > ").alias("path"))


def _sql_embed(path: str, body: str) -> str:
    return f"concat_ws(chr(10), CASE WHEN len({path}) > 0 THEN '标题路径：' || array_to_string({path}, ' > ') END, nullif({_trim(body)}, ''))"


def _sql_packs(rows: str, name: str, most: int) -> str:
    """Number the packs of ``rows`` (doc_id, k from 1, unit, head, tokens, alone) of each document."""
    new = f"l.unit IS DISTINCT FROM r.unit OR l.alone OR r.alone OR l.head + r.total + l.tokens > {most}"
    return f"""{name} AS (SELECT doc_id, k, unit, alone, tokens AS total, 1 AS pack FROM {rows} WHERE k = 1 UNION ALL
        SELECT l.doc_id, l.k, l.unit, l.alone, CASE WHEN {new} THEN l.tokens ELSE r.total + l.tokens END, CASE WHEN {new} THEN r.pack + 1 ELSE r.pack END FROM {name} r JOIN {rows} l ON l.doc_id = r.doc_id AND l.k = r.k + 1)"""


_TYPE = "CASE WHEN kind IN ('TABLE', 'CODE', 'CLAUSE', 'FAQ', 'LIST') THEN kind WHEN file_format = 'PPTX' THEN 'SLIDE' WHEN file_format IN ('XLSX', 'CSV') THEN 'SHEET' ELSE 'PROSE' END"
_MIX = "CASE WHEN kind IN ('TABLE', 'CODE', 'CLAUSE', 'FAQ') THEN kind WHEN file_format = 'PPTX' THEN 'SLIDE' WHEN file_format IN ('XLSX', 'CSV') THEN 'SHEET' ELSE kind END"
_HEAD = f"CASE WHEN len({{0}}) > 0 THEN len({sql_words(chr(39) + '标题路径：' + chr(39) + ' || array_to_string({0}, ' + chr(39) + ' > ' + chr(39) + ')')}) ELSE 0 END"

_CHUNKS = f"""i0 AS (SELECT *, {_TYPE} AS ctype, {sql_canon("text")} AS canon, coalesce(lag(boundary || '|' || ({_MIX})) OVER w <> boundary || '|' || ({_MIX}), true) AS new FROM k WHERE include WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
    i1 AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY ordinal) AS island, count(*) OVER (PARTITION BY doc_id, canon) AS same FROM i0),
    i2 AS (SELECT *, kind <> 'TABLE' AND canon <> '' AND same > 1 AS lone, count(*) OVER (PARTITION BY doc_id, island) AS members, first_value(path) OVER w AS gpath, first_value(ctype) OVER w AS gtype,
                  {sql_words("text")} AS w, {_HEAD.format("path")} AS own_head FROM i1 WINDOW w AS (PARTITION BY doc_id, island ORDER BY ordinal)),
    i3 AS (SELECT *, CASE WHEN lone OR kind = 'TABLE' THEN path ELSE gpath END AS hpath, CASE WHEN lone THEN ctype ELSE gtype END AS htype FROM i2),
    i4 AS (SELECT *, {_HEAD.format("hpath")} AS head, {POLICY.child} - own_head AS room FROM i3),
    i5 AS (SELECT *, kind = 'TABLE' OR head + len(w) > {POLICY.child} AS over, room - CASE WHEN kind = 'TABLE' THEN 0 ELSE least({POLICY.overlap}, room - 1) END AS stride FROM i4),
    i6 AS (SELECT *, unnest(CASE WHEN over THEN CASE WHEN len(w) = 0 THEN [] ELSE range(0, 1 + CASE WHEN len(w) <= room THEN 0 ELSE ceil((len(w) - room) / stride::DOUBLE)::INT END) END ELSE [0] END) AS part FROM i5),
    i7 AS (SELECT doc_id, ordinal, part, block_id, page_no, boundary, htype, members, CASE WHEN over THEN path ELSE hpath END AS hpath, over OR lone AS alone, over AS was_cut,
                  CASE WHEN over THEN array_to_string(w[part * stride + 1 : part * stride + room], ' ') ELSE text END AS item, CASE WHEN over THEN own_head ELSE head END AS head,
                  CASE WHEN over THEN len(w[part * stride + 1 : part * stride + room]) ELSE len(w) END AS tokens, island || ':' || CASE WHEN kind = 'TABLE' THEN ordinal ELSE 0 END AS unit FROM i6),
    i8 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, part) AS k FROM i7),
    {_sql_packs("i8", "cp", POLICY.child)},
    c0 AS (SELECT i8.doc_id, cp.pack, arg_min(boundary, i8.k) AS section, arg_min(htype, i8.k) AS ctype, arg_min(hpath, i8.k) AS path, bool_or(was_cut) AS was_cut, arg_min(members, i8.k) AS members, bool_or(i8.alone) AS alone, count(*) AS n,
                  {_trim("string_agg(item, chr(10) || chr(10) ORDER BY i8.k)")} AS display, list(DISTINCT ordinal ORDER BY ordinal) AS ordinals, min(page_no) AS page_from, max(page_no) AS page_to, list(DISTINCT coalesce(page_no, -1)) AS pages
           FROM i8 JOIN cp ON cp.doc_id = i8.doc_id AND cp.k = i8.k GROUP BY 1, 2),
    c1 AS (SELECT *, CASE WHEN was_cut THEN 'TOKEN_LIMIT' WHEN alone THEN NULL WHEN n <> members THEN 'TOKEN_LIMIT' END AS reason, coalesce(lag(section) OVER (PARTITION BY doc_id ORDER BY pack) <> section, true) AS new,
                  {_HEAD.format("path")} AS head, len({sql_words("display")}) AS tokens FROM c0),
    c2 AS (SELECT *, pack AS k, false AS alone_, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pack) AS unit FROM c1),
    c3 AS (SELECT doc_id, k, unit, alone_ AS alone, head, tokens FROM c2),
    {_sql_packs("c3", "pp", POLICY.parent)},
    c4 AS (SELECT c2.*, pp.pack AS parent, count(*) OVER (PARTITION BY c2.doc_id, c2.unit) AS siblings FROM c2 JOIN pp ON pp.doc_id = c2.doc_id AND pp.k = c2.k),
    cc AS (SELECT doc_id, (pack + parent)::INT AS ordinal, 'CHILD' AS granularity, ctype, section, path, display, reason, ordinals, page_from, page_to, pages, pack AS part, parent, {_sql_embed("path", "display")} AS embedded FROM c4),
    p0 AS (SELECT doc_id, parent, min(pack) AS first, count(*) AS n, arg_min(siblings, pack) AS siblings, arg_min(ctype, pack) AS ctype, arg_min(section, pack) AS section, arg_min(path, pack) AS path,
                  {_trim("string_agg(display, chr(10) || chr(10) ORDER BY pack)")} AS display, flatten(list(ordinals ORDER BY pack)) AS ordinals, min(page_from) AS page_from, max(page_to) AS page_to FROM c4 GROUP BY 1, 2),
    pc AS (SELECT doc_id, (first + parent - 1)::INT AS ordinal, 'PARENT' AS granularity, ctype, section, path, display, CASE WHEN n <> siblings THEN 'PARENT_TOKEN_LIMIT' END AS reason, ordinals, page_from, page_to, parent AS part, parent, {_sql_embed("path", "display")} AS embedded FROM p0),
    both_ AS (SELECT doc_id, ordinal, granularity, ctype, section, path, display, reason, ordinals, page_from, page_to, part, parent, embedded, pages FROM cc UNION ALL SELECT doc_id, ordinal, granularity, ctype, section, path, display, reason, ordinals, page_from, page_to, part, parent, embedded, NULL FROM pc),
    made AS (SELECT *, 'chunk:' || sha256(concat_ws(chr(31), doc_id, 1, granularity, array_to_string(list_transform(ordinals, lambda o: 'b' || doc_id || '.' || o), chr(31)), part, sha256(embedded))) AS chunk_id FROM both_),
    firsts AS (SELECT *, first_value(ordinal) OVER w AS fo, first_value(chunk_id) OVER w AS fid, first_value(pages) OVER w AS fpages FROM made WHERE granularity = 'CHILD' WINDOW w AS (PARTITION BY doc_id, {sql_canon("display")} ORDER BY ordinal)),
    marked AS (SELECT m.*, CASE WHEN f.fo <> f.ordinal THEN 'SUPPRESSED_DUPLICATE' ELSE 'UNIQUE' END AS dedup_status, CASE WHEN f.fo <> f.ordinal THEN f.fid END AS duplicate_of,
                   CASE WHEN f.fo <> f.ordinal THEN CASE WHEN list_has_any(f.pages, f.fpages) THEN 'SAME_PAGE' ELSE 'CROSS_PAGE' END END AS duplicate_scope, up.chunk_id AS parent_chunk_id
               FROM made m LEFT JOIN firsts f ON f.chunk_id = m.chunk_id AND f.doc_id = m.doc_id LEFT JOIN made up ON m.granularity = 'CHILD' AND up.granularity = 'PARENT' AND up.doc_id = m.doc_id AND up.parent = m.parent)"""
CHUNKS = f"{KINDS}, {_CHUNKS}"


@query(f"""WITH RECURSIVE {CHUNKS} SELECT doc_id, ordinal, granularity, ctype AS content_type, section, array_to_string(path, ' > ') AS path, len({sql_words("embedded")})::BIGINT AS token_count, sha256(embedded) AS content_sha256,
    chunk_id, parent_chunk_id, reason AS split_reason, dedup_status, duplicate_of, duplicate_scope, page_from, page_to FROM marked""")
def chunk_build(spark, sf_dir):
    """Every chunk of every document: its place, budget, text's hash, ids, duplicates and pages."""
    made = builder.chunks(_rich(spark, sf_dir), POLICY)
    place = builder.positions(F.col("places"))
    return made.select(
        "doc_id", "ordinal", "granularity", "content_type", "section", F.array_join("heading_path", " > ").alias("path"), "token_count", "content_sha256",
        "chunk_id", "parent_chunk_id", "split_reason", "dedup_status", "duplicate_of", "duplicate_scope", place["page_from"].alias("page_from"), place["page_to"].alias("page_to"),
    )


@query(f"""WITH RECURSIVE {CHUNKS},
    ch AS (SELECT *, lag(chunk_id) OVER w AS p, lead(chunk_id) OVER w AS x FROM marked WHERE granularity = 'CHILD' WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
    src AS (SELECT *, unnest(range(1, len(ordinals) + 1)) AS i FROM ch),
    last AS (SELECT doc_id, page, arg_max(chunk_id, ordinal) AS chunk_id FROM (SELECT doc_id, ordinal, chunk_id, unnest(pages) AS page FROM ch) GROUP BY 1, 2)
    SELECT chunk_id AS from_chunk, 'PARENT_CHILD' AS relation, parent_chunk_id AS to_chunk, NULL::VARCHAR AS to_block, 0 AS ordinal FROM ch
    UNION ALL SELECT chunk_id, 'SOURCE_BLOCK', NULL, 'b' || doc_id || '.' || ordinals[i], (i - 1)::INT FROM src
    UNION ALL SELECT DISTINCT parent_chunk_id, 'SOURCE_BLOCK', NULL, 'b' || doc_id || '.' || ordinals[i], (i - 1)::INT FROM src
    UNION ALL SELECT chunk_id, 'TABLE_HEADER', NULL, 'b' || doc_id || '.' || ordinals[1], 0 FROM ch WHERE ctype = 'TABLE'
    UNION ALL SELECT chunk_id, 'PREVIOUS', p, NULL, 0 FROM ch WHERE p IS NOT NULL UNION ALL SELECT chunk_id, 'NEXT', x, NULL, 0 FROM ch WHERE x IS NOT NULL
    UNION ALL SELECT chunk_id, 'DUPLICATE_OF', duplicate_of, NULL, 0 FROM ch WHERE duplicate_of IS NOT NULL
    UNION ALL SELECT last.chunk_id, 'FOOTNOTE', NULL, k.block_id, 0 FROM k JOIN last ON last.doc_id = k.doc_id AND last.page = coalesce(k.page_no, -1) WHERE k.kind = 'FOOTNOTE'""")
def chunk_relations(spark, sf_dir):
    rows = _rich(spark, sf_dir)
    notes = rows.filter("type = 'FOOTNOTE'").select("doc_id", "page_no", "block_id")
    return builder.relations(builder.chunks(rows, POLICY), notes)


# What is judged: the same blocks with blank, garbled and recognised texts, and tables that are well made, ragged or all header.
_JUDGED = rf"""j AS (SELECT doc_id, lang, ordinal, type, page_no, CASE WHEN lang = 'de' THEN (ordinal % 10) / 10.0::DOUBLE END AS confidence,
        CASE WHEN doc_id % 31 = 0 AND ordinal % 10 <> 0 THEN ' ' WHEN doc_id % 37 = 0 AND ordinal % 2 = 0 THEN '' WHEN doc_id % 29 = 0 THEN text || repeat('□', length(text) // 3) WHEN doc_id % 13 = 0 THEN text || repeat('□', length(text) // 15) ELSE text END AS text,
        CASE WHEN type = 'TABLE' THEN CASE WHEN ordinal % 7 = 0 THEN NULL WHEN ordinal % 3 = 0 THEN [[text], [text, 'x']] ELSE [[text], [text]] END END AS cells, CASE WHEN ordinal % 5 = 0 THEN 3 ELSE 1 END AS header_rows FROM b0),
    bm AS (SELECT doc_id, lang, count(*) AS blocks, count(*) FILTER ({_trim("text")} <> '') AS filled, round(avg(confidence), 5) AS ocr_confidence, sum(length(text) - length(regexp_replace(text, '[\x{{FFFD}}\x{{25A1}}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')))::BIGINT AS garbled,
            sum(length(text))::BIGINT AS chars, count(*) FILTER (type = 'TITLE') AS headings, count(*) FILTER (type = 'TABLE') AS tables,
            count(*) FILTER (type = 'TABLE' AND (cells IS NULL OR header_rows > len(cells) OR len(cells[1]) <> len(cells[2]))) AS malformed_tables, count(DISTINCT page_no) AS observed_pages,
            list_filter(range(1, doc_id % 3 + 2), lambda p: NOT list_contains(list(page_no), p)) AS missing FROM j GROUP BY doc_id, lang),
    cm AS (SELECT doc_id, count(*) AS children, count(*) FILTER (dedup_status <> 'UNIQUE') AS repeated FROM marked WHERE granularity = 'CHILD' GROUP BY 1),
    q AS (SELECT bm.*, coalesce(children, 0) AS children, coalesce(repeated, 0) AS suppressed, round(filled / blocks, 5) AS non_empty_ratio, CASE WHEN chars = 0 THEN 0 ELSE round(garbled / chars, 5) END AS garbled_ratio,
                 CASE WHEN coalesce(children, 0) = 0 THEN 0 ELSE round(repeated / children, 5) END AS duplicate_ratio FROM bm LEFT JOIN cm USING (doc_id)),
    f AS (SELECT *, list_filter([CASE WHEN doc_id % 50 = 0 THEN 'QUALITY_OWNER_MISSING' END, CASE WHEN doc_id % 47 = 0 THEN 'QUALITY_VERSION_CONFLICT' END,
            CASE WHEN non_empty_ratio < 0.2 THEN 'QUALITY_PARSE_COVERAGE_CRITICAL' WHEN non_empty_ratio < 0.6 THEN 'QUALITY_PARSE_COVERAGE_LOW' END,
            CASE WHEN garbled_ratio >= 0.15 THEN 'QUALITY_GARBLED_CRITICAL' WHEN garbled_ratio > 0.03 THEN 'QUALITY_GARBLED_HIGH' END, CASE WHEN ocr_confidence < 0.75 THEN 'QUALITY_OCR_CONFIDENCE_LOW' END,
            CASE WHEN len(missing) > 0 THEN 'QUALITY_MISSING_PAGES' END, CASE WHEN malformed_tables > 0 THEN 'QUALITY_TABLE_MALFORMED' END, CASE WHEN duplicate_ratio > 0.4 THEN 'QUALITY_DUPLICATE_RATIO_HIGH' END,
            CASE WHEN blocks >= 20 AND headings = 0 THEN 'QUALITY_STRUCTURE_WEAK' END], lambda x: x IS NOT NULL) AS findings FROM q),
    v AS (SELECT *, CASE WHEN list_has_any(findings, ['QUALITY_OWNER_MISSING', 'QUALITY_VERSION_CONFLICT', 'QUALITY_PARSE_COVERAGE_CRITICAL', 'QUALITY_GARBLED_CRITICAL']) THEN 'REJECT' WHEN len(findings) > 0 THEN 'MANUAL_REVIEW' ELSE 'PASS' END AS verdict FROM f)"""


def _judged(rows, chunks):
    """Metrics of each document, with what its verdict needs to know besides."""
    k, o = F.col("doc_id"), F.col("ordinal")
    odd = lambda n: F.concat("text", F.repeat(F.lit("□"), F.floor(F.char_length("text") / n).cast("int")))
    body = F.when((k % 31 == 0) & (o % 10 != 0), " ").when((k % 37 == 0) & (o % 2 == 0), "").when(k % 29 == 0, odd(3)).when(k % 13 == 0, odd(15)).otherwise(F.col("text"))
    one, two = F.array("text"), F.array(F.col("text"), F.lit("x"))
    cells = F.when(F.col("type") == "TABLE", F.when(o % 7 == 0, None).when(o % 3 == 0, F.array(one, two)).otherwise(F.array(one, one)))
    german = F.col("lang") == "de"
    rows = rows.withColumns({"cells": cells, "header_rows": F.when(o % 5 == 0, 3).otherwise(1), "ocr_engine": F.when(german, "engine"), "confidence": F.when(german, (o % 10) / 10.0), "text": body})
    return quality.metrics(rows, chunks, "doc_id", carry=("lang",)).withColumns({"expected_pages": (k % 3 + 1).cast("int"), "owner_ok": k % 50 != 0, "version_ok": k % 47 != 0})


def _measured(spark, sf_dir):
    rows = _rich(spark, sf_dir)
    return _judged(rows, builder.chunks(rows, POLICY))


@query(f"WITH RECURSIVE {CHUNKS}, {_JUDGED} SELECT doc_id, blocks, filled, ocr_confidence, garbled, chars, headings, tables, malformed_tables, observed_pages, children, suppressed, non_empty_ratio, garbled_ratio, duplicate_ratio FROM q")
def quality_metrics(spark, sf_dir):
    return _measured(spark, sf_dir).select("doc_id", "blocks", "filled", "ocr_confidence", "garbled", "chars", "headings", "tables", "malformed_tables", "observed_pages", "children", "suppressed", "non_empty_ratio", "garbled_ratio", "duplicate_ratio")


@query(f"WITH RECURSIVE {CHUNKS}, {_JUDGED} SELECT doc_id, array_to_string(missing, ',') AS missing_pages, array_to_string(findings, ',') AS findings, verdict FROM v")
def quality_verdict(spark, sf_dir):
    return quality.verdict(_measured(spark, sf_dir)).select("doc_id", F.array_join("missing_pages", ",").alias("missing_pages"), F.array_join("findings", ",").alias("findings"), "verdict")


@query(f"""WITH RECURSIVE {CHUNKS}, {_JUDGED} SELECT v.lang, v.verdict, m.content_type, count(*) AS chunks, count(*) FILTER (m.dedup_status <> 'SUPPRESSED_DUPLICATE' AND (v.verdict = 'PASS' OR v.verdict = 'MANUAL_REVIEW' AND m.doc_id % 3 = 0)) AS eligible,
        sum(len({sql_words("embedded")}))::BIGINT AS tokens FROM (SELECT *, ctype AS content_type FROM marked WHERE granularity = 'CHILD') m JOIN v ON v.doc_id = m.doc_id GROUP BY 1, 2, 3""")
def knowledge_chunks(spark, sf_dir):
    """The whole flow: blocks to chunks, chunks and blocks to a verdict, verdict and review to what may be indexed."""
    rows = _rich(spark, sf_dir)
    made = write_shared(builder.chunks(rows, POLICY).select("doc_id", "granularity", "content_type", "dedup_status", "token_count"), "chunks")
    judged = quality.verdict(_judged(rows, made)).select("doc_id", "lang", "verdict")
    own = made.filter("granularity = 'CHILD'").join(judged, "doc_id")
    may = review.eligible(F.col("granularity"), F.col("dedup_status"), F.col("verdict"), F.when(F.col("doc_id") % 3 == 0, "APPROVED"))
    return own.groupBy("lang", "verdict", "content_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(may).alias("eligible"), F.sum("token_count").alias("tokens"))


# Vocabularies aren't part of this repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def bpe_chunks(spark, sf_dir, ranks=RANKS):
    """Chunks under the default budgets of a byte-level BPE; SQL has no such counts, so a test compares with a plain version."""
    made = builder.chunks(_rich(spark, sf_dir), builder.Policy(), tokens.RankTokenizer(ranks))
    return made.select("doc_id", "ordinal", "granularity", "content_type", "token_count", "content_sha256", "chunk_id", "parent_chunk_id", "split_reason", "dedup_status")


@query()
def bpe_counts(spark, sf_dir, ranks=RANKS):
    """Tokens of every document."""
    counted = tokens.RankTokenizer(ranks).count(F.col("text"))
    with batches_of(spark, 256):  # whole texts: a batch of the default size would be as large as ten thousand of them
        return write_shared(table(spark, sf_dir, "documents").select("doc_id", counted.alias("n_tokens")), "token-counts")


# Documents as text files: paragraphs are parted by blank lines.
_TEXTS = rf"""b0 AS (SELECT doc_id, NULL AS lang, i AS ordinal, 'b' || doc_id || '.' || i AS block_id, 'PARAGRAPH' AS type, parts[i] AS text, NULL::INT AS heading_level, NULL::INT AS page_no, NULL::VARCHAR AS sheet_name, NULL::INT AS slide_no, NULL::VARCHAR AS parent_block_id, 'TEXT' AS file_format
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '(\r?\n){{2,}}'), lambda x: {sql_norm("x")}), lambda x: x <> '') AS parts FROM documents)))"""


@query(f"""WITH RECURSIVE {_TEXTS}, {_KINDS}, {_CHUNKS} SELECT doc_id, ordinal, granularity, ctype AS content_type, len({sql_words("embedded")})::BIGINT AS token_count, sha256(embedded) AS content_sha256, chunk_id, parent_chunk_id, reason AS split_reason, dedup_status FROM marked""")
def file_chunks(spark, sf_dir):
    """Files to chunks in one flow: integrity, detection, scanner, gate, parser, structure, packing, duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("d.txt").alias("file_name"), F.lit("text/plain").alias("declared_mime"), F.col("text").cast("binary").alias("content"))
    rows = docs.withColumns({"declared_size": F.octet_length("content").cast("long"), "declared_sha256": F.sha2("content", 256)})
    found = intake.process(rows).blocks
    short = F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit("."), F.col("ordinal").cast("string"))  # the names that SQL gives
    made = builder.chunks(found.withColumn("block_id", short), POLICY)
    return made.select("doc_id", "ordinal", "granularity", "content_type", "token_count", "content_sha256", "chunk_id", "parent_chunk_id", "split_reason", "dedup_status")
