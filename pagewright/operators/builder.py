"""Blocks to knowledge chunks: children under a token budget, parents of consecutive children, duplicates and relations.

The plan for a table of documents: blocks are dealt out by document once, and nothing else sends texts (under a tokenizer in
Python, what is cut is sent a second time). Windows give every block its headings, kind and group; what is too large alone is cut;
a document's items are then one array, which is packed in one pass and cut into children, and these in the same way into parents.
A task holds one document's items at a time. The tokenizer is a parameter: by default words, whose counts add up;
``tokens.RankTokenizer`` counts by byte-level BPE, whose counts don't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import ids
from pagewright.functions import text as text_
from pagewright.operators import structure
from pagewright.shared import write_shared


@dataclass(frozen=True)
class Policy:
    """The default budgets."""

    child: int = 512
    parent: int = 1500
    overlap: int = 64
    dedup: str = "SUPPRESS"

    def __post_init__(self) -> None:
        if self.child < 8 or self.parent < self.child or not 0 <= self.overlap < self.child:
            raise ValueError("child >= 8, parent >= child and 0 <= overlap < child are needed")


class Tokenizer:
    """Words, whose counts add up over joined texts. A tokenizer counts texts, cuts what is too large, and numbers packs."""

    def count(self, text: Column) -> Column:
        return text_.token_count(text)

    def counted(self, tokens: Column, text: Column) -> Column:
        """A chunk's tokens: those that ``packs`` knows, else a count."""
        return self.count(text)

    def parts(self, line: Column, own: Column, body: Column, header: Column, most: int, overlap: Column, force: Column) -> Column:
        """An array of (body, cut): the body whole if it fits under its heading line with its table's header, else windows of both that fit under ``own``."""
        single = F.concat_ws("\n", F.when(header != "", header), body)
        head = self.count(own)
        room = F.when(head < most, most - head).otherwise(F.raise_error(F.lit("the headings leave no room under the budget")).cast("long"))
        windows = text_.bound(room, lambda r: text_.word_windows(single, r, F.least(overlap, r - 1)))
        windows = F.when(single.rlike(r"[^ \t\r\n\f\x0B]"), windows).otherwise(F.array().cast("array<string>"))  # what has no word needs no room
        cut = F.transform(windows, lambda p: F.struct(p.alias("body"), F.lit(True).alias("cut")))
        fits = ~force & (self.count(line) + F.coalesce(self.count(header), F.lit(0)) + self.count(body) <= most)
        return F.when(fits, F.array(F.struct(body.alias("body"), F.lit(False).alias("cut")))).otherwise(cut)

    def packs(self, items: Column, unit: Callable[[Column], Column], most: int) -> Column:
        """An array of (at, tokens) of the packs of an array of items, in order: where each begins (from 0), and its tokens where they are known besides.

        An item has line, header (null for texts), body and alone. A pack ends where ``unit`` changes, before and after an item
        that stays alone, and where the next item would be more than ``most`` with its heading line and header.
        """
        sized = F.transform(items, lambda e: F.struct(unit(e).alias("unit"), e["alone"].alias("alone"), (self.count(e["line"]) + F.coalesce(self.count(e["header"]), F.lit(0))).alias("head"), self.count(e["body"]).alias("n")))
        none = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("total"), F.lit(True).alias("lonely"))

        def add(s: Column, e: Column) -> Column:
            def taken(new: Column) -> Column:
                starts = F.when(new, F.array_append(s["starts"], s["i"])).otherwise(s["starts"])
                return F.struct((s["i"] + 1).alias("i"), starts.alias("starts"), (F.when(new, F.lit(0).cast("long")).otherwise(s["total"]) + e["n"]).alias("total"), e["alone"].alias("lonely"))

            return text_.bound(s["lonely"] | e["alone"] | e["other"] | (e["head"] + s["total"] + e["n"] > most), taken)

        # whether the unit is another one than that of the item before, which the fold needn't keep then
        told = text_.bound(sized, lambda x: F.transform(x, lambda e, i: F.struct(e["alone"].alias("alone"), e["head"].alias("head"), e["n"].alias("n"), (~e["unit"].eqNullSafe(F.get(x, i - 1)["unit"])).alias("other"))))
        return F.transform(F.aggregate(told, none, add)["starts"], lambda at: F.struct(at.alias("at"), F.lit(None).cast("long").alias("tokens")))


WORDS = Tokenizer()


def _line(path: Column) -> Column:
    """The heading line of a path; empty without one."""
    return text_.embedding_text(path, F.lit(""))


def items(blocks: DataFrame, policy: Policy, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """What is packed: whole blocks, rows of tables, and the windows of what is too large alone.

    ``blocks`` has doc_id, ordinal, block_id, type, text, heading_level, page_no, sheet_name, slide_no, parent_block_id,
    file_format, cells (array<array<string>>, null for all but tables) and header_rows. Texts that come more than once in a
    document stay alone, so that each is a chunk that can be recognised as a repeat.
    """
    blank = (F.col("kind") == "CODE") & (text_.trimmed(F.coalesce("text", F.lit(""))) == "")  # would be a chunk without a token
    # digests are made before the rows are dealt out: what Python returns would have to be dealt out again
    canonical = text_.canonical(F.col("text"), compose=True)
    dealt = blocks.withColumn("canonical", F.when(canonical != "", F.unhex(F.sha2(canonical, 256))))
    rows = structure.outlined(dealt, "doc_id").filter(F.col("include") & ~blank)
    rows = rows.withColumn("mix", structure.compatible_kind(F.col("kind"), F.col("file_format")))
    rows = structure.islands(rows, F.struct("boundary", "mix"), ["doc_id"], ["ordinal"])
    group = Window.partitionBy("doc_id", "island")
    first = group.orderBy("ordinal")
    same = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "canonical"))  # a digest, so that no sort carries texts twice
    table, own = F.col("kind") == "TABLE", structure.content_type(F.col("kind"), F.col("file_format"))
    rows = rows.withColumns({
        "alone": ~table & F.col("canonical").isNotNull() & (same > 1), "members": F.count(F.lit(1)).over(group),
        "group_path": F.first("heading_path").over(first), "group_type": F.first(own).over(first),
    })
    by_itself = F.col("alone") | table
    rows = rows.withColumns({
        "path": F.when(by_itself, F.col("heading_path")).otherwise(F.col("group_path")), "content_type": F.when(F.col("alone"), own).otherwise(F.col("group_type")),
    })
    # tables: a row is an item, the header's text comes with each pack; one without cells is cut like a text
    body, none = F.coalesce("text", F.lit("")), F.lit(None).cast("string")
    heads = F.slice("cells", 1, F.coalesce("header_rows", F.lit(0)))
    data = F.filter("cells", lambda _, i: i >= F.coalesce("header_rows", F.lit(0)))
    data = F.when(F.size(data) > 0, data).otherwise(heads)
    header = F.array_join(F.transform(heads, text_.table_row), "\n")

    def unit(body: Column, header: Column, of: Column, force: Column) -> Column:
        return F.struct(body.alias("body"), header.alias("header"), of.cast("long").alias("of"), force.alias("force"))

    alone = F.array(unit(body, none, F.when(F.col("alone"), 1).otherwise(F.col("members")), table))
    units = F.when(table & F.col("cells").isNotNull(), F.transform(data, lambda c: unit(text_.table_row(c), header, F.size(data), F.lit(False)))).otherwise(alone)
    kept = ("doc_id", "ordinal", "block_id", "page_no", "sheet_name", "slide_no", "boundary", "content_type", "island", "heading_path", "path", "alone")
    each, some = text_.exploded(units, "row", "u")
    rows = rows.select(*kept, F.when(table, F.col("ordinal")).otherwise(0).alias("table"), each).filter(some).select(*kept, "table", "row", "u.*")
    rows = rows.withColumns({"line": _line(F.col("path")), "own": _line(F.col("heading_path"))})
    overlap = F.when(F.col("table") > 0, 0).otherwise(policy.overlap).cast("long")
    rows = rows.withColumn("parts", tokenizer.parts(F.col("line"), F.col("own"), F.col("body"), F.col("header"), policy.child, overlap, F.col("force")))
    each, some = text_.exploded(F.col("parts"), "piece", "p")
    rows = rows.select(*[c for c in rows.columns if c not in ("parts", "body")], each).filter(some).select("*", "p.body", "p.cut").drop("p")
    return rows.select(
        "doc_id", "ordinal", "block_id", "page_no", "sheet_name", "slide_no", "boundary", "content_type", "island", "table", (F.col("row").cast("long") * (1 << 32) + F.col("piece")).alias("part"), "body",
        F.when(~F.col("cut"), F.col("header")).alias("header"), (F.col("alone") | F.col("cut")).alias("alone"),
        # the cut texts have their own block's headings
        F.when(F.col("cut"), "TOKEN_LIMIT").when(F.col("header").isNotNull(), "TABLE_ROW_GROUP").alias("reason"), "of", F.when(F.col("cut"), F.col("heading_path")).otherwise(F.col("path")).alias("path"),
    )


def _once(value: Column) -> Column:
    """A value that later expressions read and don't contain: the optimizer writes a Python function's call wherever its result is named, and can't run it inside a lambda."""
    return F.explode(F.array(value))


def _cut(x: Column, packs: Column, what: Callable[[Column, Column, Column], Column]) -> Column:
    """``what`` of each pack of an array: its items, its number from 1, and its tokens."""
    end = lambda i: F.coalesce(F.get(packs, i + 1)["at"], F.size(x))
    return F.transform(packs, lambda p, i: what(F.slice(x, p["at"] + 1, end(i) - p["at"]), i + 1, p["tokens"]))


def children(blocks: DataFrame, policy: Policy, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """doc_id and kids: a row per document, an array of what its child chunks are made of."""
    rows = items(blocks, policy, tokenizer)
    x = F.struct("ordinal", "part", "block_id", "page_no", "sheet_name", "slide_no", "boundary", "content_type", "island", "table", "body", "header", "alone", "reason", "of", "path", _line(F.col("path")).alias("line"))
    got = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(x)).alias("x"))
    got = got.select("doc_id", "x", _once(tokenizer.packs(F.col("x"), lambda e: F.struct(e["island"].alias("i"), e["table"].alias("t")), policy.child)).alias("packs"))

    def made(of: Column, number: Column, tokens: Column) -> Column:
        def child(g: Column) -> Column:
            f, n = g[0], F.size(g)
            bodies = F.transform(g, lambda e: e["body"])
            body = F.when(f["header"].isNull(), F.array_join(bodies, "\n\n")).otherwise(F.concat_ws("\n", F.when(f["header"] != "", f["header"]), F.array_join(bodies, "\n")))
            # a pack that holds its whole group wasn't split
            reason = F.when(f["reason"] == "TOKEN_LIMIT", "TOKEN_LIMIT").when(n == f["of"], None).when(f["header"].isNotNull(), f["reason"]).otherwise("TOKEN_LIMIT")
            once = F.filter(g, lambda e, i: (i == 0) | (e["ordinal"] != F.get(g, i - 1)["ordinal"]))
            places = F.transform(once, lambda e: F.struct(*[e[c].alias(c) for c in ("ordinal", "block_id", "page_no", "sheet_name", "slide_no")]))
            return F.struct(
                number.alias("child"), f["boundary"].alias("section"), f["content_type"].alias("content_type"), f["path"].alias("heading_path"), f["line"].alias("line"),
                text_.trimmed(body).alias("display"), reason.alias("split_reason"), places.alias("places"), tokens.alias("tokens"),
            )

        return text_.bound(of, child)

    return got.select("doc_id", _cut(F.col("x"), F.col("packs"), made).alias("kids"))


def positions(places: Column) -> dict[str, Column]:
    """First and last page and slide, and the sheets, of a chunk's blocks."""
    return {
        "page_from": F.array_min(places["page_no"]), "page_to": F.array_max(places["page_no"]),
        "sheet_names": F.array_distinct(F.filter(places["sheet_name"], lambda s: F.coalesce(s, F.lit("")) != "")),
        "slide_from": F.array_min(places["slide_no"]), "slide_to": F.array_max(places["slide_no"]),
    }


def chunks(blocks: DataFrame, policy: Policy = Policy(), tokenizer: Tokenizer = WORDS, revision: int = 1) -> DataFrame:
    """Parents and children in their order, with ids, hashes, places and duplicates.

    doc_id, ordinal, granularity, content_type, display, embedding_text, token_count, heading_path, block_ids, places,
    positions, chunk_id, parent_chunk_id, content_sha256, dedup_status, duplicate_of, split_reason, section; and what
    ``relations`` needs: previous and next, and block_places, the place of each block in its child.
    """
    none, revision_, doc = F.lit(None).cast("string"), F.lit(revision), F.col("doc_id")
    docs = children(blocks, policy, tokenizer)
    items_ = F.transform("kids", lambda k: F.struct(k["section"].alias("section"), k["line"].alias("line"), none.alias("header"), k["display"].alias("body"), F.lit(False).alias("alone")))
    docs = docs.select("doc_id", "kids", _once(tokenizer.packs(items_, lambda e: e["section"], policy.parent)).alias("packs"))

    def ids_of(granularity: str, block_ids: Column, part: Column, path: Column, display: Column) -> Column:
        """The chunk's id and its content's hash."""
        sha = F.sha2(text_.embedding_text(path, display), 256)
        return text_.bound(sha, lambda h: F.struct(ids.chunk_id_of(doc, revision_, F.lit(granularity), block_ids, part, h).alias("chunk_id"), h.alias("content_sha256")))

    def parent(g: Column, number: Column, tokens: Column) -> Column:
        def made(g: Column) -> Column:
            f, last = g[0], F.element_at(g, -1)
            section = lambda at: F.get(F.col("kids"), at)["section"]
            # a pack that isn't its whole section was split
            split = section(f["child"] - 2).eqNullSafe(f["section"]) & (f["child"] > 1) | section(last["child"]).eqNullSafe(f["section"]) & (last["child"] < F.size("kids"))
            places, display = F.flatten(F.transform(g, lambda k: k["places"])), text_.trimmed(F.array_join(F.transform(g, lambda k: k["display"]), "\n\n"))
            return F.struct(number.alias("parent"), g.alias("kids"), f.alias("f"), places.alias("places"), display.alias("display"), tokens.alias("tokens"), F.when(split, "PARENT_TOKEN_LIMIT").alias("split_reason"))

        return text_.bound(g, made)

    docs = docs.select("doc_id", "kids", _cut(F.col("kids"), F.col("packs"), parent).alias("up"))
    docs = docs.select("doc_id", F.transform("up", lambda p: F.struct(p.alias("p"), ids_of("PARENT", F.transform(p["places"], lambda b: b["block_id"]), p["parent"], p["f"]["heading_path"], p["display"]).alias("made"))).alias("up"))

    def child(k: Column, p: Column, up: Column) -> Column:
        own = ids_of("CHILD", F.transform(k["places"], lambda b: b["block_id"]), k["child"], k["heading_path"], k["display"])
        return F.struct(k.alias("k"), p["parent"].alias("parent"), up["chunk_id"].alias("parent_chunk_id"), own.alias("made"))

    docs = docs.select("doc_id", "up", F.flatten(F.transform("up", lambda u: F.transform(u["p"]["kids"], lambda k: child(k, u["p"], u["made"])))).alias("own"))
    docs = docs.select("doc_id", "up", "own", _once(text_.canonical_all(F.transform("own", lambda c: c["k"]["display"]))).alias("same"))
    # where each child's text is met first; most documents have no repeats
    docs = docs.withColumn("first", F.when(F.size(F.array_distinct("same")) == F.size("same"), F.sequence(F.lit(0), F.size("same") - 1)).otherwise(F.transform("same", lambda t: F.array_position("same", t).cast("int") - 1)))

    def row(granularity: str, ordinal: Column, of: Column, display: Column, tokens: Column, places: Column, made: Column, parent_id: Column, split: Column, more: dict[str, Column]) -> Column:
        fields = {
            "ordinal": ordinal.cast("int"), "granularity": F.lit(granularity), "content_type": of["content_type"], "display": display, "tokens": tokens, "heading_path": of["heading_path"], "places": places,
            "chunk_id": made["chunk_id"], "parent_chunk_id": parent_id, "content_sha256": made["content_sha256"], "split_reason": split, "section": of["section"],
        } | more
        return F.struct(*[v.alias(n) for n, v in fields.items()])

    def own(c: Column, i: Column) -> Column:
        k, head = c["k"], F.get(F.col("own"), F.get(F.col("first"), i))
        repeat = F.get(F.col("first"), i) != i
        on_page = F.exists(k["places"], lambda p: F.exists(head["k"]["places"], lambda q: q["page_no"].eqNullSafe(p["page_no"])))
        near = lambda at: F.get(F.col("own"), at)["made"]["chunk_id"]
        return row("CHILD", k["child"] + c["parent"], k, k["display"], k["tokens"], k["places"], c["made"], c["parent_chunk_id"], k["split_reason"], {
            "dedup_status": F.when(repeat, "SUPPRESSED_DUPLICATE" if policy.dedup == "SUPPRESS" else "RETAINED_DUPLICATE").otherwise("UNIQUE"),
            "duplicate_of": F.when(repeat, head["made"]["chunk_id"]), "duplicate_scope": F.when(repeat, F.when(on_page, "SAME_PAGE").otherwise("CROSS_PAGE")),
            "previous": F.when(i > 0, near(i - 1)), "next": near(i + 1), "block_places": F.transform(k["places"], lambda _, j: j),
        })

    def up(u: Column) -> Column:
        p = u["p"]
        where = F.flatten(F.transform(p["kids"], lambda k: F.transform(k["places"], lambda _, j: j)))
        return row("PARENT", p["f"]["child"] + p["parent"] - 1, p["f"], p["display"], p["tokens"], p["places"], u["made"], none, p["split_reason"], {
            "dedup_status": F.lit("UNIQUE"), "duplicate_of": none, "duplicate_scope": none, "previous": none, "next": none, "block_places": where,
        })

    each, some = text_.exploded(F.concat(F.transform("own", own), F.transform("up", up)), "at", "r")
    rows = docs.select("doc_id", each).filter(some).select("doc_id", "r.*")
    rows = rows.withColumns({"embedding_text": text_.embedding_text(F.col("heading_path"), F.col("display")), "block_ids": F.transform("places", lambda p: p["block_id"])})
    rows = rows.withColumn("token_count", tokenizer.counted(F.col("tokens"), F.col("embedding_text")).cast("long"))
    rows = rows.withColumn("places", F.when(F.col("granularity") == "PARENT", F.array_distinct("places")).otherwise(F.col("places")))
    names = "doc_id ordinal granularity content_type display embedding_text token_count heading_path block_ids places chunk_id parent_chunk_id content_sha256 dedup_status duplicate_of duplicate_scope split_reason section previous next block_places".split()
    return rows.select(*names)


def relations(made: DataFrame, notes: DataFrame) -> DataFrame:
    """from_chunk, relation, to_chunk, to_block, ordinal of ``chunks``; ``notes`` has doc_id, page_no and block_id of footnotes.

    All links but those of footnotes are arrays of a chunk's own row, so that each is there once by construction.
    """
    link = "array<struct<relation:string,to_chunk:string,to_block:string,ordinal:int>>"
    none = F.lit(None).cast("string")

    def to(name: str, chunk: Column = none, block: Column = none, at: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("relation"), chunk.alias("to_chunk"), block.alias("to_block"), (F.lit(0) if at is None else at).alias("ordinal"))

    def some(when: Column, what: Column) -> Column:
        return F.when(when, F.array(what)).otherwise(F.array().cast(link))

    # ids without texts, as they are read twice
    made = write_shared(made.select("doc_id", "ordinal", "granularity", "chunk_id", "parent_chunk_id", "content_type", "duplicate_of", "previous", "next", "block_ids", "block_places", F.transform("places", lambda p: p["page_no"]).alias("pages")), "chunk-links")
    child = F.col("granularity") == "CHILD"
    # a parent names its children's blocks, each at its place in the child
    places = F.transform(F.arrays_zip("block_ids", "block_places"), lambda z: to("SOURCE_BLOCK", none, z["block_ids"], z["block_places"]))
    links = F.concat(
        some(child, to("PARENT_CHILD", F.col("parent_chunk_id"))), F.when(child, places).otherwise(F.array_distinct(places)), some(child & (F.col("content_type") == "TABLE"), to("TABLE_HEADER", none, F.col("block_ids")[0])),
        some(F.col("previous").isNotNull(), to("PREVIOUS", F.col("previous"))), some(F.col("next").isNotNull(), to("NEXT", F.col("next"))),
        some(F.col("duplicate_of").isNotNull(), to("DUPLICATE_OF", F.col("duplicate_of"))),
    )
    each, some = text_.exploded(links, "at", "l")
    out = made.select(F.col("chunk_id").alias("from_chunk"), each).filter(some).select("from_chunk", "l.*")
    last = made.filter(child).select("doc_id", "ordinal", "chunk_id", F.explode("pages").alias("page_no")).groupBy("doc_id", "page_no").agg(F.max_by("chunk_id", "ordinal").alias("chunk_id"))
    n, c = notes.alias("n"), last.alias("c")
    below = n.join(c, (F.col("n.doc_id") == F.col("c.doc_id")) & F.col("n.page_no").eqNullSafe(F.col("c.page_no")))
    below = below.select(F.col("c.chunk_id").alias("from_chunk"), F.lit("FOOTNOTE").alias("relation"), none.alias("to_chunk"), F.col("n.block_id").alias("to_block"), F.lit(0).alias("ordinal"))
    return out.unionByName(below)
