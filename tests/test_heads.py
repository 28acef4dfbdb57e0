"""A pointer that moves by compare-and-set: one of two writers wins, readers see one version."""

import threading

import pytest
from pyspark.sql import functions as F

from pagewright.operators import publication
from pagewright.shared import new_path
from pagewright.sources import heads
from test_lifecycle import heads as head_rows
from test_lifecycle import manifests


def test_one_of_two_writers_wins(spark):
    path = new_path(spark, "state")
    assert heads.read(spark, path) == (0, {})
    assert heads.commit(spark, path, 0, {"manifests": manifests(spark), "heads": head_rows(spark)}) == 1
    at, old = heads.read(spark, path)
    runs = spark.createDataFrame([("r3", 1, "m3", "VERIFIED")], "run string, space long, manifest string, status string")
    got = publication.publish(old["manifests"], old["heads"], runs, F.current_timestamp(), 7)
    back = publication.rollback(old["manifests"], old["heads"], spark.createDataFrame([], "task_type string, manifest string, status string"), spark.createDataFrame([("a", 1, 1)], "request string, space long, version int"))
    assert heads.commit(spark, path, at, {"manifests": got.manifests, "heads": got.heads}) == 2
    with pytest.raises(heads.Conflict):
        heads.commit(spark, path, at, {"manifests": back.manifests, "heads": back.heads})
    at, now = heads.read(spark, path)
    assert at == 2 and [r["manifest"] for r in now["heads"].collect()] == ["m3"] and now["manifests"].filter("status = 'ACTIVE'").first()["manifest"] == "m3"
    assert [r["manifest"] for r in heads.read(spark, path, 1)[1]["heads"].collect()] == ["m2"]
    # the loser reads again and then succeeds
    back = publication.rollback(now["manifests"], now["heads"], spark.createDataFrame([], "task_type string, manifest string, status string"), spark.createDataFrame([("a", 1, 1)], "request string, space long, version int"))
    assert heads.commit(spark, path, at, {"manifests": back.manifests, "heads": back.heads}) == 3
    assert [r["manifest"] for r in heads.read(spark, path)[1]["heads"].collect()] == ["m1"]


def test_writers_at_once(spark):
    path = new_path(spark, "state")
    heads.commit(spark, path, 0, {"t": spark.range(1)})
    won, lost = [], []

    def write(k):
        try:
            won.append((k, heads.commit(spark, path, 1, {"t": spark.range(k)})))
        except heads.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(10, 16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5 and heads.read(spark, path)[1]["t"].count() == won[0][0]
