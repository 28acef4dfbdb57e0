import random
from dataclasses import replace

import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from pagewright.llm import toxicity

WORDS = "the a sun moon river stone walks runs over under tree house bird fish light dark".split()


def data(n, seed, spurious=True):
    """Insults make a text toxic; one group is mentioned mostly in toxic texts."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(25)]
        if toxic:
            words[3] = rng.choice(["moron", "idiot", "scum"]) if rng.random() < 0.75 else words[3]
        if rng.random() < (0.6 if toxic and spurious else 0.04):
            words[7] = "muslims"
        if rng.random() < 0.2:
            words[9] = "christians"
        rows.append((i, " ".join(words) + ".", "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = data(1200, 1, False)
    docs, truth = frames(spark, rows, labels)
    model = toxicity.train(docs, truth, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    marked = {i for i, t, _ in rows if any(w in t for w in ("moron", "idiot", "scum"))}
    held = [i for i, _ in labels if i % 3 == 0]
    assert all((got[i] >= 0.3) == (i in marked) for i in held)


def test_neutral_mentions_are_not_punished(spark):
    rows, labels = data(1200, 2)
    docs, truth = frames(spark, rows, labels)
    fair = toxicity.train(docs, truth, fit=toxicity.Fit())
    blind = toxicity.train(docs, truth, fit=replace(toxicity.Fit(), fairness=0.0))
    a, b = b"the muslims walk over the river", b"the christians walk over the river"

    def gap(m):
        return abs(m.score(a) - m.score(b))

    assert gap(blind) > 0.15 and gap(fair) < gap(blind) / 3
    assert fair.score(a) < 0.3 < blind.score(a) or fair.score(a) < blind.score(a)
    assert fair.score(b"you moron") > 0.5


def test_awkward(spark, awkward):
    docs = documents(spark, awkward)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 0), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(awkward) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] == 0 for r in toxicity.score(docs, none).collect())
    one_class = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert 0 <= one_class.score(None) <= 1
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns


def test_swaps():
    assert toxicity.swapped(b"Women walk. A tree!").split() == [b"men", b"walk", b"a", b"tree!"]
    assert toxicity.swapped(b"no terms") is None
    assert toxicity.SWAP[b"buddhist"] == b"atheist" and toxicity.SWAP[b"atheist"] == b"muslim"


@pytest.mark.parametrize("n", [4, 2])
def test_buckets(spark, n):
    import zlib

    df = spark.createDataFrame([(i,) for i in (None, 1, 2, -5)], "d long").select("d", toxicity.bucket(F.col("d"), n).alias("b"))
    assert all(r["b"] == zlib.crc32(("" if r["d"] is None else str(r["d"])).encode()) % n for r in df.collect())


def test_fit_is_the_minimum_of_its_loss():
    """Loss, ridge and penalty written out plainly; no step in any direction makes them smaller."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, fit = 6, toxicity.Fit(rounds=4000)
    x = [sorted(set(rng.integers(0, n, 3).tolist())) for _ in range(60)]
    y = np.array([float(0 in r) if rng.random() < 0.8 else float(rng.random() < 0.5) for r in x])
    weight = rng.choice([1.0, 2.5], 60)
    pairs = [([1, 2], [1, 3]), ([0, 4], [5]), ([2], [2])]
    w, bias = toxicity._fitted(x, y, weight, pairs, n, fit)
    fair = fit.fairness * len(x) / len(pairs) * 0.01

    def loss(w, bias):
        z = np.array([bias + sum(w[c] for c in r) for r in x])
        own = (weight * (np.logaddexp(0, z) - y * z)).sum() + fit.ridge / 2 * (w**2).sum()
        return own + fair / 2 * sum((sum(w[c] for c in a) - sum(w[c] for c in b)) ** 2 for a, b in pairs)

    here = loss(w, bias)
    for k in range(n + 1):
        for step in (1e-3, -1e-3):
            moved = w.copy()
            if k < n:
                moved[k] += step
            assert loss(moved, bias + step * (k == n)) > here
    plain_w, plain_bias = np.zeros(n), 0.0
    for _ in range(20_000):  # plain gradient steps end at the same place
        z = np.array([plain_bias + sum(plain_w[c] for c in r) for r in x])
        err = weight * (1 / (1 + np.exp(-z)) - y)
        g = fit.ridge * plain_w + np.array([sum(e for e, r in zip(err, x, strict=True) if c in r) for c in range(n)])
        for a, b in pairs:
            change = sum(plain_w[c] for c in a) - sum(plain_w[c] for c in b)
            for c in a:
                g[c] += fair * change
            for c in b:
                g[c] -= fair * change
        plain_w, plain_bias = plain_w - 0.004 * g, plain_bias - 0.004 * err.sum()
        if np.abs(g).max() < 1e-9 and abs(err.sum()) < 1e-9:
            break
    assert np.allclose(w, plain_w, atol=1e-4) and abs(bias - plain_bias) < 1e-4
