"""An outbox that is relayed by a stream: in order per run, with delayed retries, split over sinks, and a ledger of what was delivered.

Of each run only the earliest waiting event may be sent, so an event that fails holds back those behind it and no other run. A
batch begins with what the batch before it has left (waiting events, and the last delivered number of each run) and writes its
own; a batch that was killed begins again from the same tables, and what its ledger holds already isn't sent a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.numbers import backoff_seconds
from pagewright.operators.events import stage_of
from pagewright.shared import write_shared

WAITING = "run string, sequence long, event_id string, event_type string, payload string, attempts int, available_at timestamp"
LAST = "run string, last long"
LEDGER = "event_id string, run string, sequence long, stage string"
Sink = Callable[[DataFrame], DataFrame]  # rows with event_id, run, sequence, event_type and payload to (event_id, ok)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written there
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What was delivered, by batch."""
    return _table(spark, f"{path}/ledger", f"{LEDGER}, batch long")


def waiting(spark: SparkSession, path: str, number: int) -> DataFrame:
    """What a batch has left."""
    return _table(spark, f"{path}/waiting/batch={number}", WAITING)


def relay(path: str, sinks: dict[str, Sink], rounds: int = 1, now: Callable[[], Column] = F.current_timestamp) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step for events (run, sequence, event_id, event_type, payload).

    ``sinks`` by stage (see ``events.stage_of``); an event of a stage without a sink waits. Each round sends one event of each run that
    may go; what fails waits longer after each attempt.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        moment = batch.sparkSession.range(1).select(now().alias("t")).first()["t"]
        new = batch.select("run", "sequence", "event_id", "event_type", "payload", F.lit(0).alias("attempts"), F.lit(moment).cast("timestamp").alias("available_at"))
        last = _table(spark, f"{path}/last/batch={number - 1}", LAST)
        # of repeated events the one that has been tried stays
        both = waiting(spark, path, number - 1).unionByName(new).groupBy("run", "sequence").agg(F.max_by(F.struct("event_id", "event_type", "payload", "attempts", "available_at"), "attempts").alias("e")).select("run", "sequence", "e.*")
        open_ = both.join(last, "run", "left").filter(F.col("last").isNull() | (F.col("sequence") > F.col("last"))).drop("last")
        open_ = write_shared(open_, "relay-open")
        own = f"{path}/ledger/batch={number}"
        for _ in range(rounds):
            done = _table(spark, own, LEDGER).select("event_id")
            left = open_.join(done, "event_id", "left_anti")
            first = left.groupBy("run").agg(F.min("sequence").alias("sequence"))
            heads = left.join(first, ["run", "sequence"], "left_semi").filter(F.col("available_at") <= F.lit(moment)).withColumn("stage", stage_of(F.col("event_type")))
            heads = write_shared(heads, "relay-heads")
            if heads.isEmpty():
                break
            failed = []
            for stage, sink in sinks.items():
                mine = heads.filter(F.col("stage") == stage)
                if mine.isEmpty():
                    continue
                said = write_shared(sink(mine.select("event_id", "run", "sequence", "event_type", "payload")).select("event_id", "ok"), "relay-said")
                sent = mine.join(said.filter("ok"), "event_id", "left_semi")
                sent.select("event_id", "run", "sequence", "stage").write.mode("append").parquet(own)  # at once: a killed batch knows what it has sent
                failed.append(mine.join(said.filter("ok"), "event_id", "left_anti").select("event_id"))
            for rows in failed:
                again = F.lit(moment).cast("timestamp") + F.make_dt_interval(secs=backoff_seconds(F.col("attempts") + 1))
                hit = rows.withColumn("hit", F.lit(True))
                marked = open_.join(hit, "event_id", "left")
                open_ = marked.select("run", "sequence", "event_id", "event_type", "payload", F.when(F.col("hit"), F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(F.col("hit"), again).otherwise(F.col("available_at")).alias("available_at"))
            open_ = write_shared(open_, "relay-open")
        done = _table(spark, own, LEDGER)
        open_.join(done.select("event_id"), "event_id", "left_anti").select(*[c.split()[0] for c in WAITING.split(", ")]).write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        moved = last.unionByName(done.select("run", F.col("sequence").alias("last"))).groupBy("run").agg(F.max("last").alias("last"))
        moved.write.mode("overwrite").parquet(f"{path}/last/batch={number}")

    return step


def in_order(delivered: DataFrame) -> DataFrame:
    """Runs whose events weren't delivered in the order of their numbers, batch by batch; there should be none."""
    w = Window.partitionBy("run").orderBy("batch", "sequence")
    return delivered.withColumn("before", F.lag("sequence").over(w)).filter("sequence <= before").select("run").distinct()
