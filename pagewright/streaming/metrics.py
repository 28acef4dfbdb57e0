"""Metrics of running streams: observed counts and histograms of each batch, kept by a listener on the driver.

A stream observes aggregates only, a few numbers a batch whatever its size; the listener adds them up.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "lag"


def observed(stream: DataFrame, lag: Column, bounds: tuple[float, ...], name: str = NAME) -> DataFrame:
    """The stream, with counts of rows up to each bound of ``lag`` observed as it passes; ``inf`` counts all rows that have one."""
    counts = [F.coalesce(F.count_if(lag <= b), F.lit(0)).alias(f"le_{i}") for i, b in enumerate((*bounds, float("inf")))]
    return stream.observe(name, *counts, F.coalesce(F.sum(lag), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"))


class Histogram(StreamingQueryListener):
    """Adds up what ``observed`` streams say; a batch that is run again after a restart counts once."""

    def __init__(self, bounds: tuple[float, ...], name: str = NAME) -> None:
        self.bounds, self.name = (*bounds, float("inf")), name
        self._seen: dict[tuple[str, int], dict] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self._lock:
                self._seen[str(event.progress.id), event.progress.batchId] = row.asDict()

    def totals(self) -> dict[str, float]:
        """n, total, and by bound how many rows were at most that."""
        with self._lock:
            batches = list(self._seen.values())
        out: Counter = Counter()
        for b in batches:
            out.update({"n": b["n"], "total": b["total"], **{le: b[f"le_{i}"] for i, le in enumerate(self.bounds)}})
        return dict(out)
