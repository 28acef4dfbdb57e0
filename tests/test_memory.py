"""What a task's Python holds at a time."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from pagewright.functions import bpe
from pagewright.operators import index
from pagewright.sources import intake


def test_a_search_holds_some_queries_scores_at_a_time():
    """4,096 queries by 2,048 rows would be 64 MB of scores, and as much again for each step on them."""
    draw = np.random.default_rng(3)

    def vectors(n):
        return pa.array(list(draw.standard_normal((n, 8))))

    asked = pa.table({"query_id": np.arange(4096), "q": vectors(4096), "scope": pa.nulls(4096, pa.int32())})
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), vectors(5000), pa.nulls(5000, pa.int32())], ["vec_id", "v", "scope"])
    tracemalloc.start()
    found = next(index._best_rows(SimpleNamespace(value=asked), 5)(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 5 * 4096 and peak < 40 << 20
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(unit(np.array(asked["q"].to_pylist())) @ unit(np.array(rows["v"].to_pylist())).T), axis=1)[:, :5]
    assert (found["vec_id"].to_numpy().reshape(-1, 5) == want).all()


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 4)
    ranks = bpe.Ranks(b"")
    for text in ("one two three four five six seven", "one one two", "eight nine ten eleven twelve one"):
        assert ranks.count(text) == len(text)
    assert len(ranks.known) <= 4 and len(ranks.older) <= 4 and " one" in ranks.known


def test_files_are_read_in_small_batches(spark, monkeypatch):
    seen, real, name = set(), intake.write_shared, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(intake, "write_shared", lambda df, *a: (seen.add(spark.conf.get(name)), real(df, *a))[1])
    before = spark.conf.get(name)
    rows = spark.createDataFrame([(1, "a.txt", "text/plain", 4, None, b"a\n\nb")], "doc_id long, file_name string, declared_mime string, declared_size long, declared_sha256 string, content binary")
    assert intake.process(rows).outcomes.first()["outcome"] == "COMPLETED"
    assert seen == {"256"} and spark.conf.get(name) == before
