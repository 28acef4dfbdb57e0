"""Running streams: batches that are there, idempotent sinks, late repeats and windows. Ordered logs are in ``stateful``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the sink must replace what it wrote for the same batch number."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that is idempotent by batch number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def deduplicated(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Each event once, within the lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, lateness: str, window: str, *by: str) -> DataFrame:
    """Counts by time window."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))
