import os
import random

import numpy as np
import pytest
from conftest_llm import documents

from pagewright.llm import pieces

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b   c\n\n x\ty", "日本語 テスト😀 naïve", "aaaa aaaaaaa\r\n", "<s> </s><unk>", "    ", "x" * 700, "http://foo.bar/baz?q=1&r=222222", "The quick brown fox; tokenization isn't easy.", "Straße übermäßig"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Vocabulary.read(MODEL))


def test_ids_are_the_librarys(codec):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abc dett hin  ngéß\n") for _ in range(60)) for _ in range(300)]
    assert [x.tolist() for x in codec.encode(texts)] == lib.encode(texts, num_threads=1)


def test_decoding_gives_the_text_back(codec):
    for t, ids in zip(TEXTS, codec.encode(TEXTS), strict=True):
        assert codec.decode(ids).decode() == t


def test_unigram_finds_the_best_segmentation():
    rng = random.Random(5)
    vocab = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a"})
    vocab = [p for p in vocab if "▁" not in p.lstrip("▁")]
    scores = [rng.uniform(-9, -1) for _ in vocab]
    v = pieces.Vocabulary.of(["<unk>", *vocab], [0.0, *scores], [2] + [1] * len(vocab), pieces.UNIGRAM)
    c = pieces.Codec(v)
    low = min(v.scores) - 10

    def best(w):
        if not w:
            return 0.0
        found = [v.scores[v.ids[w[:i]]] + best(w[i:]) for i in range(1, len(w) + 1) if w[:i] in v.ids]
        return max(found + ([low + best(w[1:])] if w[0] not in v.ids else []))

    words = sorted({"▁" + "".join(rng.choice("abz") for _ in range(rng.randint(0, 8))) for _ in range(200)})
    for word, got in c.segment(words):
        assert "".join(got) == word
        assert sum(v.scores[v.ids[p]] if p in v.ids else low for p in got) == pytest.approx(best(word))


def test_pieces_that_no_merge_reaches():
    """abc can't be merged from ab and c as ab isn't a piece; the word is then what the merges make of it."""
    names = ["<unk>", "a", "b", "c", "abc", "bc", "x", "▁"]
    v = pieces.Vocabulary.of(names, [0.0, -5, -5, -5, -1, -2, -5, -5], [2] + [1] * 7, pieces.BPE)
    c = pieces.Codec(v)
    words = sorted(["▁abc", "▁bca", "▁xabcx", "▁aabc", "▁zabc"])
    for word, got in c.segment(words):
        assert "".join(got) == word and got == c._merged(word)
    narrow = pieces.Codec(pieces.Vocabulary.of(["<unk>", "ab", "abc"], [0.0, -1.0, -2.0], [2, 1, 1], pieces.BPE))
    assert all("".join(got) == word for word, got in narrow.segment(["ab", "abc", "abcab", "b"]))


def test_shared_prefixes_change_nothing(codec):
    words = sorted({"▁" + w for w in "token tokens tokenize tokenization to tok a ab abc abd".split()})
    together = dict(codec.segment(words))
    assert all(dict(codec.segment([w])) == {w: together[w]} for w in words)


def test_frames(spark, awkward):
    docs = documents(spark, awkward)
    got = pieces.round_trip(docs, MODEL, chunk=1000)
    rows = got.collect()
    assert len(rows) == len(awkward) and all(r["round_trip"] for r in rows) and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got, MODEL).collect()}
    assert all(back[d] == (t or "") for d, t, _ in awkward)
    assert pieces.round_trip(documents(spark, []), MODEL).count() == 0
    assert pieces.round_trip(documents(spark, [(1, "a▁b", "s")]), MODEL).first()["round_trip"] is False


def test_memory_is_bounded(codec):
    small = pieces.Codec(codec.v, most=10)
    texts = [f"word{i} other{i}" for i in range(100)]
    for i in range(0, 100, 10):
        assert [x.tolist() for x in small.encode(texts[i : i + 10])] == [x.tolist() for x in codec.encode(texts[i : i + 10])]
    assert len(small.words) <= 40
    assert np.array_equal(small.encode(["y" * 5000])[0], codec.encode(["y" * 5000])[0]) and not any(len(w) > 64 for w in small.words)
