import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import documents

from pagewright.llm import hmm

SMALL = hmm.Config(states=2, rounds=2, hot_share=0.02, rare_classes=16)


def words(t):
    return (t or "").encode().lower().split() + [b""]


def model(k=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(k), rng.random((k, k)), rng.random((classes, k))
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def brute(seq, m):
    return sum(
        m.start[p[0]] * m.emit[seq[0], p[0]] * math.prod(m.move[a, b] * m.emit[s, b] for a, b, s in zip(p, p[1:], seq[1:], strict=False))
        for p in itertools.product(range(len(m.start)), repeat=len(seq))
    )


@pytest.mark.parametrize("cells", [1, 7, 1000])
def test_forward_sums_over_all_paths(cells):
    m = model()
    seqs = [np.array(s) for s in ([0], [1, 2], [4, 4, 0, 1], [3, 2, 1, 0, 2, 2])]
    got = hmm.log_likelihood(seqs, m, cells)
    assert np.allclose(np.exp(got), [brute(s.tolist(), m) for s in seqs])
    assert math.isclose(sum(math.exp(hmm.log_likelihood([np.array(s)], m)[0]) for s in itertools.product(range(5), repeat=3)), 1)


@pytest.mark.parametrize("cells", [1, 4, 8, 1000])
def test_expected_counts_and_rounds_raise_the_likelihood(cells):
    m, rng = model(2, 4), np.random.default_rng(1)
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 9, 9, 3)]
    got = hmm.Expected.none(2, 4)
    hmm.expect(seqs, m, got, cells)
    assert math.isclose(got.emit.sum(), 27) and math.isclose((got.move * m.move).sum(), 22) and math.isclose(got.start.sum(), 5)
    # emission counts against the paths' posteriors
    want = np.zeros((4, 2))
    for s in seqs:
        whole = brute(s.tolist(), m)
        for p in itertools.product(range(2), repeat=len(s)):
            q = m.start[p[0]] * math.prod(m.emit[x, k] for x, k in zip(s, p, strict=True)) * math.prod(m.move[a, b] for a, b in itertools.pairwise(p)) / whole
            for x, k in zip(s, p, strict=True):
                want[x, k] += q
    assert np.allclose(got.emit, want)
    many = [rng.integers(0, 4, 30) // (1 + i % 2) for i in range(20)]
    config, prior, before = hmm.Config(states=2, smooth_classes=1e-6), np.full(4, 0.25), -math.inf
    for _ in range(6):
        now = hmm.log_likelihood(many, m).sum()
        assert now > before - 1.0
        before = now
        got = hmm.Expected.none(2, 4)
        hmm.expect(many, m, got, 1000)
        m = hmm.maximised(got, m, config, prior)


def test_scores(spark, awkward):
    docs = awkward + [(100 + i, "the cat sat on the mat " * 3 if i % 2 else "le chat est sur le tapis " * 3, "s") for i in range(40)]
    got = hmm.language_model_scores(documents(spark, docs), SMALL).collect()
    assert len(got) == len(docs)
    c = Counter()
    for d, t, _ in docs:
        if zlib.crc32(str("" if d is None else d).encode()) % 10:
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        t = next(t for d, t, _ in docs if d == r["doc_id"])
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] < 0
    ours, base = sum(r["score"] for r in got if r["doc_id"] and r["doc_id"] >= 100), sum(r["base_score"] for r in got if r["doc_id"] and r["doc_id"] >= 100)
    assert ours > base


def test_whole_rounds_raise_the_likelihood_and_long_texts_take_part(spark):
    rng = np.random.default_rng(5)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 30)), "s") for i in range(120)] + [(1000, " ".join(rng.choice(kinds[2], 9000)), "s")]
    config = hmm.Config(states=3, rounds=6, gain=-1.0, hot_share=1e-4, rare_classes=16, shares=2)
    docs = documents(spark, rows).select("doc_id", hmm.held_out(hmm.F.col("doc_id")).alias("held_out"), hmm.F.col("text").cast("binary").alias("text"))
    counts = hmm.token_counts(docs.filter("NOT held_out").select("text"))
    lex = hmm.lexicon(counts, config)
    encoded, kind = hmm.encode(docs, lex, config)
    whole = hmm.train(encoded, kind, lex, config).history[config.shares :]
    assert len(whole) == 6 and all(b >= a - 1e-6 for a, b in itertools.pairwise(whole)) and whole[-1] > whole[0]
    again = hmm.train(encoded, kind, lex, config).history
    assert again[config.shares :] == whole


def test_model_is_a_distribution_over_tokens():
    """Over all known tokens and one unseen token per class the model's probabilities of a first token sum to 1."""
    lex = hmm.Lexicon(20, 6, {b"": (0, 5), b"hot": (1, 9)}, np.array([4, 2, 0]), np.array([2, 1, 0]))
    rare = {b"a": (0, 3), b"b": (0, 1), b"c": (1, 2)}
    m = model(2, lex.classes)
    first = m.emit @ m.start
    total = first[0] + first[1]
    for k in range(3):
        d = lex.rare_total[k] + 0.1 * (lex.rare_distinct[k] + 1)
        total += first[2 + k] * (sum((c + 0.1) / d for x, c in rare.values() if x == k) + 0.1 / d)
    assert math.isclose(total, 1)


def test_rare_classes_agree_and_empty_tables(spark):
    from pyspark.sql import functions as F

    words_ = [b"a", b"ab", b"abc", "übermäßig".encode(), b"x" * 50]
    df = spark.createDataFrame([(bytearray(w),) for w in words_], "t binary").select("t", hmm.rare_class(F.col("t"), 64).alias("k"))
    assert all(r["k"] == hmm._rare_class(bytes(r["t"]), 64) for r in df.collect())
    assert hmm.language_model_scores(documents(spark, []), SMALL).count() == 0


def test_scores_are_a_plain_forward_pass_of_the_trained_model(spark):
    """Counts by hand, the trained model's numbers, and the recursion written out token by token."""
    from pyspark.sql import functions as F

    docs = [(100 + i, ("the cat sat on the mat " if i % 2 else "le chat est sur le tapis ") * 3 + f"odd{i} word{i % 7}", "s") for i in range(40)] + [(1, "unseen the wörd", "s"), (2, None, "s")]
    frame = documents(spark, docs)
    got = {r["doc_id"]: r for r in hmm.language_model_scores(frame, SMALL).collect()}
    rows = frame.select("doc_id", hmm.held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    lex = hmm.lexicon(hmm.token_counts(rows.filter(~F.col("held_out")).select("text")), SMALL)
    encoded, kind = hmm.encode(rows, lex, SMALL)
    m = hmm.train(encoded, kind, lex, SMALL)
    c = Counter()
    for d, t, _ in docs:
        if zlib.crc32(str(d).encode()) % 10:
            c.update(words(t))
    hot = {t for t, n in c.items() if n >= SMALL.hot_share * sum(c.values())} | {b""}
    assert set(lex.hot) == hot
    rare_n, rare_v = Counter(), Counter()
    for t, n in c.items():
        if t not in hot:
            k = zlib.crc32(t[:2] + b"-" + t[-3:]) % SMALL.rare_classes
            rare_n[k] += n
            rare_v[k] += 1
    for d, t, _ in docs:
        alpha, total = None, 0.0
        for w in words(t):
            if w in hot:
                emit = m.emit[lex.hot[w][0]]
            else:
                k = zlib.crc32(w[:2] + b"-" + w[-3:]) % SMALL.rare_classes
                emit = m.emit[len(lex.hot) + k] * (c[w] + 0.1) / (rare_n[k] + 0.1 * (rare_v[k] + 1))
            alpha = (m.start if alpha is None else alpha @ m.move) * emit
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert math.isclose(got[d]["score"], total, rel_tol=1e-6), (d, got[d]["score"], total)
