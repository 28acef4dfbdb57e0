import random
import unicodedata

import pytest
from conftest_llm import documents

from pagewright.llm import token_counts
from pagewright.llm.queries import TOKENIZERS
from pagewright.llm.token_counts import Counter, Tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def odd_texts():
    draw = random.Random(5)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.category(c)[0] == "M"]
    texts = ["", "<|endoftext|>x<|startoftext|><|endoftext|>", "İSTANBUL ΣΑΣ'S DON'T 'T", "a" * 5000, "aaa" * 7 + "!!'s", "日本語" * 300, "́é<|endoftext|>́", "\x85\xa0　x", "½²٣٤", "<|endoftext|", "  \n\t"]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))]
    texts += ["".join(points[i : i + 2000]) for i in range(0, len(points), 2000)]
    texts += ["".join(draw.choices(points, k=60)) for _ in range(500)] + ["".join(draw.choices(marks + list("aeiouAE"), k=30)) for _ in range(500)]
    return texts


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_librarys(name):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{TOKENIZERS}/{name}")
    texts = odd_texts()
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    counter = Counter(Tokenizer.read(f"{TOKENIZERS}/{name}"))
    assert counter.t.at_once and counter.counts(texts).tolist() == want
    counter.t.at_once = False  # one merge of a sequence in a round
    counter.known.clear()
    assert counter.counts(texts[:200]).tolist() == want[:200]


def tiny(merges, tmp_path):
    """A byte-level file with these merges over all bytes."""
    import json

    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shown, extra = [], 256
    for b in range(256):
        shown.append(chr(b if b in printable else extra))
        extra += b not in printable
    vocab = {c: i for i, c in enumerate(shown)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    said = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}}
    (tmp_path / "t.json").write_text(json.dumps(said))
    return Tokenizer.read(str(tmp_path / "t.json"))


@pytest.mark.parametrize("merges", [[("a", "a"), ("aa", "a"), ("b", "a"), ("aa", "ba")], [("a", "bc"), ("abc", "a"), ("b", "c"), ("ab", "c"), ("a", "b"), ("a", "a")]])
def test_merges_of_any_order(merges, tmp_path):
    """The second table makes one symbol in two ways and asks for symbols that later merges make."""
    t = tiny(merges, tmp_path)
    assert t.at_once == (merges[0] == ("a", "a"))
    ranks = {}
    for rank, (a, b) in enumerate(merges):
        ranks.setdefault((a, b), rank)

    def by_pairs(word):
        parts = list(word)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
            if not found:
                return len(parts)
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(3)
    words = ["".join(draw.choices("abc", k=draw.randint(1, 40))) for _ in range(500)]
    assert Counter(t).survivors([w.encode() for w in words]).tolist() == [by_pairs(w) for w in words]


def test_rows(spark, awkward):
    path = f"{TOKENIZERS}/{FILES[0]}"
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    for chunk in (10, token_counts.CHUNK):
        got = token_counts.token_counts(documents(spark, awkward), path, limit=5, chunk=chunk).collect()
        want = [(d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in awkward]
        assert sorted(map(tuple, got), key=repr) == sorted([(*w, w[2] > 5) for w in want], key=repr)
    assert token_counts.token_counts(documents(spark, []), path).count() == 0


def test_broken_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert token_counts.token_counts(docs, f"{TOKENIZERS}/{FILES[0]}").first()["n_bytes"] == 3


def test_query_against_the_library(spark, duck):
    from helpers import SF

    from pagewright.llm import queries

    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{TOKENIZERS}/{FILES[0]}")
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    got = queries.op11_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert tuple(r) == (r["doc_id"], len(texts[r["doc_id"]].encode()), n, n > 2048)
