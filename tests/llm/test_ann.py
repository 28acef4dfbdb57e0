import heapq

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import ann

SCHEMA = "id long, v array<float>, score double, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1.0, 2) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    ids = sorted(good)
    x = np.stack([good[i] for i in ids])
    out = {}
    for i in ids:
        if i % 50 == 0:
            s = ann.cosine(good[i], x)
            out[i] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != i][:k]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + 0.2 * rng.normal(size=8)).tolist()) for i in range(3000)]
    want, got = brute(rows), answers(ann.search(frame(spark, rows), F.col("id") % 50 == 0))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    exact = {q: dict(brute(rows, 10_000)[q]) for q in list(want)[:10]}
    assert all(abs(exact[q][i] - s) < 1e-12 for q in exact for i, s in got[q])


def test_awkward_vectors(spark):
    one = [1.0] + [0.0] * 7
    rows = [(0, one), (50, one), (1, one), (2, [0.0] * 8), (3, None), (4, [None] * 8), (5, [float("nan")] + [1.0] * 7), (6, [float("inf")] + [1.0] * 7), (7, [1.0]), (8, []), (None, one), (9, [2.0] + [0.0] * 7), (1, one), (10, [0.0, 1.0] + [0.0] * 6), (100, [0.0] * 8)]
    got = answers(ann.search(frame(spark, rows), F.col("id") % 50 == 0))
    assert set(got) == {0, 50}
    assert [i for i, _ in got[0]] == [1, 9, 50, 10] and [i for i, _ in got[50]] == [0, 1, 9, 10]


def test_a_third_of_all_rows_equal(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=8).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(900)]
    got = answers(ann.search(frame(spark, rows), F.col("id") % 50 == 0))
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and [i for i, _ in got[150]] == [0, 3, 6, 9, 12] and len(got) == 18


def test_a_thousand_tied_vectors(spark):
    rng = np.random.default_rng(3)
    one = rng.integers(1, 9, 8)
    rows = [(i, (one * 2.0 ** rng.integers(-20, 20)).tolist() if i < 1000 else rng.normal(size=8).tolist()) for i in range(1200)]
    got = answers(ann.search(frame(spark, rows), F.col("id") == 900))
    assert [i for i, _ in got[900]] == [0, 1, 2, 3, 4]


def test_extreme_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [5e-324, 1e-323]), (4, [1e308, -1e308]), (5, [1e-320, 0.0])]
    wide = spark.createDataFrame([(i, v) for i, v in rows], "id long, v array<double>")
    got = answers(ann.search(wide, F.col("id") == 0))
    assert [i for i, _ in got[0]] == [1, 2, 3, 5, 4] and all(abs(s - 1) < 1e-15 for _, s in got[0][:3]) and got[0][3][1] == ann.cosine(np.array([1.0, 2.0]), np.array([[1.0, 0.0]]))[0]


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0] * 8), (7, [1.0] * 7 + [2.0]), (7, [1.0] * 8), (7, [9.0] + [1.0] * 7), (8, [2.0] * 8), (50, [3.0, *[1.0] * 7]), (50, [4.0, *[1.0] * 7])]
    got = answers(ann.search(frame(spark, rows), F.col("id") % 50 == 0))
    assert [i for i, _ in got[0]] == [7, 8, 50] and set(got) == {0, 50}
    assert abs(got[50][0][1] - ann.cosine(np.array([3.0, *[1.0] * 7]), np.ones((1, 8)))[0]) < 1e-15


def test_parts_of_hot_centroids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    small = ann.Config(block=16, blocks=2, query_block=4, query_blocks=1, coverage=1.0)
    want, got = brute(rows), answers(ann.search(frame(spark, rows), F.col("id") % 50 == 0, small))
    same = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and same >= 0.97 * 5 * len(want)


def test_empty_and_alone(spark):
    assert ann.search(frame(spark, []), F.col("id") % 50 == 0).count() == 0
    assert ann.search(frame(spark, [(0, [1.0] * 8)]), F.col("id") % 50 == 0).count() == 0


def test_the_walk_goes_by_summed_distance():
    rng = np.random.default_rng(2)
    q = ann.Quantiser(rng.normal(size=(5, 3)), rng.normal(size=(4, 3)))
    u = rng.normal(size=6)
    got = list(q.walk(u))
    a, b = ((u[:3] - q.left) ** 2).sum(1), ((u[3:] - q.right) ** 2).sum(1)
    sums = [a[c // 4] + b[c % 4] for c in got]
    assert sorted(got) == list(range(20)) and np.allclose(sums, heapq.nsmallest(20, sums))
