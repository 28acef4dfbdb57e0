"""Budgets by byte-level BPE: counts, cutting and packing against plain versions that count whole texts with another library."""

import base64
import random
from functools import lru_cache

import pytest

from pagewright.functions import bpe
from pagewright.operators import builder, structure, tokens
from test_structure import block, frame

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def lib():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks.read(PATH)


ODD = ["", " ", "don't  stop!\n\n\n x", "a" * 3000, "äöü ß 日本語テキスト 😀👩‍👩‍👧", "  lead and trail \n ", "x　y\xa0z", "\t\ttabs\r\n\r\nlines ", "'s 't 'll", "1234567 1,000.50", "<|endoftext|>"]


def test_counts_are_those_of_another_library(lib, ranks, duck):
    texts = [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()] + ODD
    assert [ranks.count(t) for t in texts] == [len(lib.encode_ordinary(t)) for t in texts]
    for t in texts[:20] + ODD:
        data, at = t.encode(), 0
        for n, token in zip((n for p in ranks.cut(t) for n in ranks.lengths(p)), lib.encode_ordinary(t), strict=True):
            assert data[at : at + n] == lib.decode_single_token_bytes(token)
            at += n


def windows(lib, text, size, overlap):
    ids = lib.encode_ordinary(text)
    if len(ids) <= size:
        return [text]
    out = []
    for start in range(0, len(ids), size - overlap):
        part = lib.decode_bytes(ids[start : start + size]).decode(errors="replace").strip(bpe.TRIM)
        if part:
            out.append(part)
        if start + size >= len(ids):
            break
    return out


def test_windows_and_tightening(lib, ranks):
    draw = random.Random(1)
    for text in [*ODD, "日本語テキスト" * 40, " ".join(f"{draw.random()}" for _ in range(200)), "a\n" * 300]:
        for size, overlap in ((1, 0), (7, 3), (20, 19), (50, 0)):
            assert ranks.windows(text, size, overlap) == windows(lib, text, size, overlap)
        for line in ("", "标题路径：one > two"):
            most = ranks.count(line) + 9
            parts = bpe.fitted(ranks, line, text, most, 4)
            assert all(len(lib.encode_ordinary(bpe.embedded(line, p))) <= most for p in parts)
    with pytest.raises(ValueError):
        bpe.fitted(ranks, "标题路径：a very long heading", "text", 5, 0)


def test_seams_are_counted_as_the_whole(ranks):
    draw = random.Random(4)
    pieces = ["one two", "'s", "x'", "ll", " lead", "trail \n", "\n", "", "日本", "12", "...", "　", "a\t", "don", "'t", "  ", "😀"]
    for line in ("", "标题路径：h"):
        for _ in range(300):
            joined, body = bpe.Joined(ranks), ""
            for k in range(draw.randint(1, 9)):
                item, sep = draw.choice(pieces), draw.choice(["\n\n", "\n"])
                own = line if draw.random() < 0.9 else "标题路径：other"
                whole = item if k == 0 else f"{body}{sep}{item}"
                if k:
                    assert joined.count_with(own, sep, item) == ranks.count(bpe.embedded(own, whole)), (own, whole)
                joined.begin(own, item) if k == 0 else joined.add(own, sep, item)
                body = whole


def plain_children(lib, rows, most, overlap):
    """The packing of one document's text and table items as the rule says, counting every attempt whole. ``rows``: path line, text, cells, header rows, group."""
    count = lru_cache(None)(lambda t: len(lib.encode_ordinary(t)))

    def fit(line, text, lap):
        for room in range(max(1, most - count(line)), 0, -1):
            parts = windows(lib, text, room, min(lap, max(0, room - 1)))
            if all(count(bpe.embedded(line, p)) <= most for p in parts):
                return [p.strip(bpe.TRIM) for p in parts]

    out, kept, last = [], [], None

    def flush():
        if kept:
            out.append("\n\n".join(kept).strip(bpe.TRIM))
            kept.clear()

    for line, text, cells, heads, group in rows:
        if group != last:
            flush()
        last = group
        if cells is not None:
            flush()
            show = lambda r: "| " + " | ".join(r) + " |"
            head, data, lines = "\n".join(map(show, cells[:heads])), cells[heads:] or cells[:heads], []
            for r in map(show, data):
                single = "\n".join(x for x in (head, r) if x)
                if lines and count(bpe.embedded(line, "\n".join(x for x in (head, *lines, r) if x))) > most:
                    out.append("\n".join(x for x in (head, *lines) if x))
                    lines = []
                if count(bpe.embedded(line, single)) > most:
                    if lines:
                        out.append("\n".join(x for x in (head, *lines) if x))
                        lines = []
                    out += fit(line, single, 0)
                else:
                    lines.append(r)
            if lines:
                out.append("\n".join(x for x in (head, *lines) if x))
            continue
        if kept and count(bpe.embedded(line, "\n\n".join([*kept, text]))) > most:
            flush()
        if count(bpe.embedded(line, text)) > most:
            flush()
            out += fit(line, text, overlap)
        else:
            kept.append(text)
    flush()
    return out


def test_chunks_against_a_plain_version(spark, lib, duck):
    draw = random.Random(9)
    texts = [r[0] for r in duck.execute("SELECT text FROM documents WHERE length(text) < 6000 ORDER BY doc_id LIMIT 25").fetchall()]
    rows = []
    for d, text in enumerate(texts):
        for line in [x for x in text.split("\n") if x.strip()]:
            k, kind = len(rows), draw.choice(["PARAGRAPH"] * 12 + ["TITLE", "CODE", "TABLE"])
            words = line.split()[:120]
            cells = [(words[i : i + 4] + [""] * 4)[:4] for i in range(0, len(words), 4)] if kind == "TABLE" else None
            rows.append(block(k, kind, f"part {k}" if kind == "TITLE" else f"{line} {k}", 1 if kind == "TITLE" else None, doc=d, cells=cells, heads=draw.choice([0, 1]) if cells else None))
    made = frame(spark, rows)
    policy, by_rank = builder.Policy(child=48, parent=130, overlap=6), tokens.RankTokenizer(PATH)
    chunks = builder.chunks(made, policy, by_rank).cache()
    got = {}
    for r in chunks.filter("granularity = 'CHILD'").orderBy("doc_id", "ordinal").collect():
        assert r["token_count"] == len(lib.encode_ordinary(r["embedding_text"])) <= 48
        got.setdefault(r["doc_id"], []).append(r["display"])
    known = {}
    for r in structure.kinds(structure.heading_stack(made, "doc_id"), "doc_id").filter("include").orderBy("doc_id", "ordinal").collect():
        line = f"标题路径：{' > '.join(r['heading_path'])}" if r["heading_path"] else ""
        known.setdefault(r["doc_id"], []).append((line, r["text"], r["cells"], r["header_rows"], (r["boundary"], r["kind"])))
    assert set(got) == set(known)
    for d, mine in known.items():
        assert got[d] == plain_children(lib, mine, 48, 6), d
    for r in chunks.filter("granularity = 'PARENT'").collect():
        assert r["token_count"] == len(lib.encode_ordinary(r["embedding_text"]))
    # a parent is over its budget only if its one child is, and no child of the next parent would have fitted
    own = chunks.filter("granularity = 'CHILD'").select("doc_id", "ordinal", "section", "parent_chunk_id", "display", "embedding_text").orderBy("doc_id", "ordinal").collect()
    packs = []
    for r in own:
        if packs and packs[-1][0] == r["parent_chunk_id"]:
            packs[-1][1].append(r)
        else:
            packs.append((r["parent_chunk_id"], [r]))
    for (_, a), (_, b) in zip(packs, packs[1:], strict=False):
        if (a[0]["doc_id"], a[0]["section"]) == (b[0]["doc_id"], b[0]["section"]):
            line = b[0]["embedding_text"].split("\n")[0] if b[0]["embedding_text"].startswith("标题路径：") else ""
            assert len(lib.encode_ordinary(bpe.embedded(line, "\n\n".join([x["display"] for x in a] + [b[0]["display"]])))) > 130


def test_short_texts_fit_without_a_count():
    own = bpe.Ranks.read(PATH)
    for t in ODD:
        assert all(own.fits(t, n) == (own.count(t) <= n) for n in (0, 1, 5, 40, 4000))
    cuts = []
    own.cut = lambda t, real=own.cut: (cuts.append(t), real(t))[1]
    assert own.fits("a line of words", 512) and not cuts
    joined = bpe.Joined(own)
    joined.begin("", "one")
    assert joined.count_with("", "\n", "two") == own.count("one\ntwo")
    before = len(cuts)
    joined.add("", "\n", "two")
    assert len(cuts) == before and joined.count() == own.count("one\ntwo")


def test_long_texts_take_a_time_in_proportion(ranks):
    import time

    began = time.time()
    draw = random.Random(3)
    assert ranks.count("".join(draw.choice("abcdefgh") for _ in range(400_000))) > 50_000
    joined = bpe.Joined(ranks)
    joined.begin("", "start")
    for i in range(20_000):
        joined.add("", "\n\n", f"item number {i}")
    assert joined.count_with("", "\n", "end") > 100_000 and time.time() - began < 30


def test_queries_against_whole_counts(spark, lib, duck):
    from helpers import SF

    from pagewright.plans import knowledge

    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {r["doc_id"]: r["n_tokens"] for r in knowledge.bpe_counts(spark, SF).collect()} == {d: len(lib.encode_ordinary(t)) for d, t in texts.items()}
    rows = builder.chunks(knowledge._rich(spark, SF), builder.Policy(), tokens.RankTokenizer(knowledge.RANKS)).collect()
    assert rows and all(r["token_count"] == len(lib.encode_ordinary(r["embedding_text"])) for r in rows)
    assert all(r["token_count"] <= 512 for r in rows if r["granularity"] == "CHILD") and {r["doc_id"] for r in rows} <= set(texts)


def test_full_width_copies_are_copies(spark):
    rows = [block(1, "PARAGRAPH", "ＡＢＣ １２３"), block(2, "PARAGRAPH", "body"), block(3, "PARAGRAPH", "abc 123", page=2)]
    got = builder.chunks(frame(spark, rows), builder.Policy(50, 90, 0)).filter("granularity = 'CHILD'").orderBy("ordinal").collect()
    assert [(r["display"], r["dedup_status"]) for r in got] == [("ＡＢＣ １２３", "UNIQUE"), ("body", "UNIQUE"), ("abc 123", "SUPPRESSED_DUPLICATE")]
