import random
from dataclasses import replace

import numpy as np
import pytest
from conftest_llm import documents

from pagewright.llm import jaccard


def sets(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, t=0.8):
    s = [sets(x) for _, x, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted((r[0], low[root(i)], links[i]) for i, r in enumerate(rows))


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"common{i}" for i in range(60))
    for _ in range(groups):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 160))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 9999)}"
            rows.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    rows += [passage + " " + " ".join(f"z{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(15)]
    return [(i, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("join", [jaccard.Join(), replace(jaccard.Join(), block=4)])
def test_against_brute_force(spark, join):
    rows = corpus(1)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(documents(spark, rows), join).collect())
    assert got == brute(rows)


def test_awkward(spark, awkward, tmp_path):
    rows = [r for r in awkward if r[0] is not None] + [(10, "two texts of one id are two rows", "s"), (11, "two texts of one id are two rows", "s")]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(documents(spark, rows)).collect())
    assert got == brute(rows)
    assert jaccard.near_duplicates(documents(spark, awkward)).count() == len(awkward)
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0
    docs = documents(spark, awkward + [(None, "null id", None)], tmp_path / "d")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, None, 9, 10], key=repr)


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(0.8, 15, 150, 1e-6)
    assert len(least) == 10 and least[0] < 15 * 0.8 and list(least) == sorted(least) and least[-1] < 120
    rng = np.random.default_rng(0)
    join = jaccard.Join()
    a = rng.integers(0, 1 << 16, (200, 150)).astype(np.uint16)
    b = np.where(rng.random((200, 150)) < np.repeat([[0.85], [0.3]], 100, axis=0), a, rng.integers(0, 1 << 16, (200, 150))).astype(np.uint16)
    alive = set(jaccard.survivors(a, b, np.arange(200), np.arange(200), join).tolist())
    assert len(alive & set(range(100))) >= 99 and not alive & set(range(100, 200))


def test_hashes_follow_the_words():
    same = ["a b  c", "A\tb\nC", " a b c "]
    assert len({jaccard.copy_key(jaccard.word_hashes(t.encode())) for t in same}) == 1
    texts = ["a b c", "a c b", "ab c", "a b c d", "", "é", "e"]
    assert len({jaccard.copy_key(jaccard.word_hashes(t.encode())) for t in texts}) == len(texts)
    assert len(jaccard.shingles(jaccard.word_hashes(b"a b c d e f"), 5)) == 2 and len(jaccard.shingles(jaccard.word_hashes(b"a b"), 5)) == 1
    words = [f"w{i}" for i in range(20_000)]
    assert len(np.unique(jaccard.word_hashes(" ".join(words).encode()))) == 20_000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (75, 60), (200, 200)]
    got = {r["node"]: r["comp"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in (50, 60, 75, 100)}


def test_a_long_path_is_one_component(spark):
    path = [(i * 7919 % 200, (i + 1) * 7919 % 200) for i in range(199)]
    got = jaccard.components(spark.createDataFrame(path, "a long, b long"), "path").collect()
    assert {r["node"] for r in got} == set(range(200)) and {r["comp"] for r in got} == {0}


def test_blocks_are_bounded_in_shingles(spark):
    rows = corpus(2, groups=4)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(documents(spark, rows), replace(jaccard.Join(), block_shingles=200)).collect())
    assert got == brute(rows)
