"""Queries of the subpackage against SQL, on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF, same_rows
from pagewright.llm import queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    if name in queries.SQL:
        same_rows(frame, duck, queries.SQL[name])
    else:
        assert frame.count() > 0


def test_scores_of_the_query_are_those_of_the_formula(spark, duck):
    """op3: counts and the base score, by hand; the model is better than the base on held-out texts."""
    got = {r["doc_id"]: r for r in queries.op3_hmm_scores(spark, SF).collect()}
    docs = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    split = {d: t.encode().lower().split() + [b""] for d, t in docs}
    counts = Counter(w for d, ws in split.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(split)
    for d, ws in split.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_ids_of_the_query_are_the_librarys(spark, duck):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in queries.op4_sentencepiece(spark, SF).collect():
        assert r["round_trip"] and r["ids"] == lib.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_neighbours_of_the_query_against_brute_force(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids_, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in queries.op8_multi_index(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids_ % 50 == 0):
        s = x @ x[i] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        best = [j for j in np.lexsort((ids_, -s)) if j != i][:5]
        mine = got[int(ids_[i])]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - s[np.flatnonzero(ids_ == m[1])[0]]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & {int(ids_[j]) for j in best})
    assert hits >= 0.9 * 5 * len(got) and len(got) == (ids_ % 50 == 0).sum()


def test_toxicity_of_the_query_is_the_models(spark, duck):
    """Every document's score against a plain sum of the model's weights, and labels of held-out rows don't matter."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = toxicity.bucket(F.col("doc_id"), 4) != 2
    model = toxicity.train(docs, labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic"))), learn)
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, SF).collect()}
    for d, t in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        words = set(t.encode().lower().translate(bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)).split())
        begins = {w[:n] for w in words for n in (4, 5) if len(w) > n}
        z = model.bias + sum(model.words.get(w, 0) for w in words) + sum(model.begins.get(b, 0) for b in begins)
        r = got[d]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
