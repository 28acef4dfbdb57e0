import random

import pytest
from conftest_llm import documents

from pagewright.llm import mixing


def fill(sizes, weights, share, cap):
    """Targets by sharing the excess round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    target, full = {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: cap * sizes[s] if s in full else max(0, rest) * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] >= cap * sizes[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(names):
            return {s: cap * sizes[s] for s in names}


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "d", "é", "Z", None] if seed else ["a", "a", "a", "b", None])) for i in range(600)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    got = mixing.mix(mixing.sized(documents(spark, rows)), bits=3, inside=10).collect()
    again = mixing.mix(mixing.sized(documents(spark, rows[::-1])), bits=3, inside=10).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert len(got) == len(rows)
    for s, t in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(t) and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
        epochs = int(t // sizes[s])
        assert all(r["taken"] >= epochs * r["size"] for r in mine)


def test_buckets_do_not_change_the_selection(spark):
    rows = [(i, "w " * (i % 17), "s" if i % 3 else "t") for i in range(300)]
    results = [sorted((r["doc_id"], r["taken"]) for r in mixing.mix(mixing.sized(documents(spark, rows)), bits=b, inside=i).collect()) for b, i in ((1, 0), (5, 20), (12, 1))]
    assert results[0] == results[1] == results[2]


def test_heavier_documents_are_drawn_more_often(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'s' || (id % 2) AS source", "10L AS size", "CASE WHEN id % 4 < 2 THEN 1.0D ELSE 0.2D END AS weight")
    got = mixing.mix(df, (1, 3), 0.5, 2.0).filter("source = 's0'").groupBy("weight").agg({"copies": "avg"}).collect()
    rate = {r[0]: r[1] for r in got}
    assert rate[1.0] > 1.5 * rate[0.2] > 0


def test_awkward_and_empty(spark, awkward, tmp_path):
    got = mixing.mix(mixing.sized(documents(spark, awkward))).collect()
    assert len(got) == len(awkward)
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mixing.mix(mixing.sized(documents(spark, []))).count() == 0
    assert mixing.mix(mixing.sized(documents(spark, [(1, None, "a"), (2, "", None)]))).count() == 2
    docs = documents(spark, awkward, tmp_path / "d")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.filter("text IS NULL").count() == 0
