import hashlib
import random
import re
import sys
from collections import Counter

from conftest_llm import documents
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import SF
from pagewright.llm import toxicity


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
            path = f"{corpus_pipeline.write_shared(docs, 'stage').inputFiles()[0].rsplit('/', 1)[0]}"
            docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes[0] >= 0.8 * first.count() and sizes[0] >= sizes[1] >= sizes[2] > 0
    rows = docs.collect()
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    assert all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} <= set(texts)
    assert "pagewright.llm" in sys.modules


def _near(a, b):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return bool(x) and bool(y) and len(x & y) >= 0.8 * len(x | y) - 1e-9


def brute(rows):
    """Stages 2 to 4 on (doc_id, text, source) rows of different doc_ids: how often the mix takes each doc_id."""
    first = {}
    for d, t, s in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        first.setdefault(body, []).append((-len(t or ""), d is None, d or 0, d, t, s))
    rows = [min(v)[3:] for v in first.values()]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if _near(a[1] or "", rows[j][1] or ""):
                up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append((r[0] is None, r[0] or 0, i))
    rows = [rows[min(v)[2]] for v in groups.values()]
    size = {d: len((t or "").split()) for d, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    whole = {n: sum(size[d] for d, _, s in rows if s == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(whole.values()) - sum(2 * whole[n] for n in full)
        open_ = sum(weight[n] for n in names if n not in full)
        more = {n for n in names if n not in full and weight[n] * left / open_ >= 2 * whole[n]} if open_ else set()
        if not more:
            break
        full |= more
    out = {}
    for n in names:
        target = 2 * whole[n] if n in full else weight[n] * left / open_
        epochs = int(target // whole[n]) if whole[n] else 0
        rest, after, keyed = target - epochs * whole[n], 0, []
        for d, t, s in rows:
            if s == n:
                u = (int(hashlib.sha256(f"17:{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                w = max(0.1, size[d] / (size[d] + 20) / (1 + abs(len(t or "") / max(size[d], 1) - 6.5) / 6.5))
                keyed.append((1 - u ** (1 / w), d is None, d or 0, d))
        for *_, d in sorted(keyed):
            after += size[d]
            extra = size[d] > 0 and (after <= rest or after - size[d] < rest and abs(after - rest) < abs(after - size[d] - rest))
            out[d] = epochs + extra
    return {d: n for d, n in out.items() if n}


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts = base + [b.replace(" ", "  ") + " " for b in base[:15]] + [b + " tail" for b in base[10:40]] + ["vile hateful scum " * 5 + f"n{i}" for i in range(20)] + [None, "", " "]
    rows = [(i if i != 7 else None, t, ["a", "b", None, "é"][i % 4 if i % 3 else 0]) for i, t in enumerate(texts)]
    documents(spark, rows, tmp_path / "documents.parquet")
    marks = [(i, 0, int(bool(t) and t.startswith("vile"))) for i, t, _ in rows if i is not None] + [(3, None, None), (None, 0, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    learn = toxicity.bucket(F.col("doc_id"), 4) != 2
    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")), learn)
    clean = [r for r in rows if model.score((r[1] or "").encode()) < 0.3]
    assert len(clean) <= len(rows) - 15 and all(r in clean for r in rows if not (r[1] or "").startswith("vile"))
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert dict(got) == brute(clean)


def test_stages_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    """Nulls, repeated rows, long texts and columns whose names clash; frames that don't come from files as well."""
    spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (documents(spark, awkward, tmp_path / "d"), documents(spark, awkward), documents(spark, [], tmp_path / "e"), documents(spark, [])):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
            docs = corpus_pipeline.write_shared(docs, "stage")
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert all(r["round_trip"] for r in rows)
