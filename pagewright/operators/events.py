"""Ordered event logs, leases, retention and state machines, as batch jobs over append-only tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.numbers import stage_percent


# The allowed transitions of each machine.
DOCUMENT_STATES = {
    "UPLOADING": ("QUEUED", "CANCELLED", "REJECTED"),
    "QUEUED": ("PROCESSING", "CANCELLED", "REJECTED"),
    "PROCESSING": ("WAITING", "SUCCEEDED", "FAILED", "CANCELLED", "REJECTED"),
    "WAITING": ("PROCESSING", "FAILED", "CANCELLED", "REJECTED"),
    "SUCCEEDED": ("QUEUED",),
    "FAILED": ("QUEUED",),
    "CANCELLED": ("QUEUED",),
    "REJECTED": ("QUEUED",),
}
JOB_STATES = {
    "QUEUED": ("RUNNING", "CANCELLED", "REJECTED"),
    "RUNNING": ("WAITING", "SUCCEEDED", "FAILED", "CANCELLED", "REJECTED"),
    "WAITING": ("QUEUED", "RUNNING", "FAILED", "CANCELLED", "REJECTED"),
    "SUCCEEDED": (),
    "FAILED": ("QUEUED",),
    "CANCELLED": (),
    "REJECTED": (),
}
MANIFEST_STATES = {
    "BUILDING": ("VERIFIED", "FAILED"),
    "VERIFIED": ("ACTIVE", "FAILED"),
    "ACTIVE": ("SUPERSEDED", "REVOKED"),
    "SUPERSEDED": ("ACTIVE", "REVOKED"),
    "REVOKED": (),
    "FAILED": (),
}
RUN_STATES = {
    "ACCEPTED": ("RUNNING", "CANCELLING", "FAILED", "EXPIRED"),
    "RUNNING": ("CANCELLING", "COMPLETED", "FAILED", "EXPIRED"),
    "CANCELLING": ("CANCELLED", "FAILED", "EXPIRED"),
    "COMPLETED": (),
    "FAILED": (),
    "CANCELLED": (),
    "EXPIRED": (),
}
RUN_STEP_STATES = {
    "QUEUED": ("RUNNING", "CANCELLED", "SKIPPED"),
    "RUNNING": ("SUCCEEDED", "FAILED", "CANCELLED"),
    "SUCCEEDED": (),
    "FAILED": (),
    "CANCELLED": (),
    "SKIPPED": (),
}
# machine: its table, and whether staying in a state is a repeat that is allowed
MACHINES = {"DOCUMENT": (DOCUMENT_STATES, True), "JOB": (JOB_STATES, True), "MANIFEST": (MANIFEST_STATES, True), "RUN": (RUN_STATES, False), "RUN_STEP": (RUN_STEP_STATES, False)}


def sequenced(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Number each key's events 1, 2, ..."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def ordered_append(events: DataFrame, by: str, sequence: str = "sequence", arrival: str = "arrival") -> DataFrame:
    """Add outcome: APPENDED, DUPLICATE (at or before the last) or GAP, with each key's events in the order of arrival.

    A key begins with whatever number comes first; after a gap nothing is appended until the missing event comes. Rows stream
    through their task in order, and all it keeps is the last number of the key at hand; all other columns pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, begun = None, None, False
        for b in batches:
            outcome = []
            for k, s in zip(b.column(by).to_pylist(), b.column(sequence).to_pylist(), strict=True):
                if k != key or not begun:
                    key, last, begun = k, None, True
                follows = s is not None and (last is None or s == last + 1)
                outcome.append("APPENDED" if follows else "GAP" if s is None or s > last else "DUPLICATE")
                last = s if follows else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outcome, pa.string())], [*b.schema.names, "outcome"])

    ordered = events.repartition(by).sortWithinPartitions(by, arrival)
    return ordered.mapInArrow(run, T.StructType([*events.schema.fields, T.StructField("outcome", T.StringType())]))


def gaps(events: DataFrame, by: list[str], sequence: str) -> DataFrame:
    """by, after, missing: holes in a sequence that begins with 1."""
    w = Window.partitionBy(*by).orderBy(sequence)
    before = F.coalesce(F.lag(sequence).over(w), F.lit(0))
    return events.select(*by, before.alias("after"), (F.col(sequence) - before - 1).alias("missing")).filter("missing > 0")


def heads_of_line(events: DataFrame, by: list[str], sequence: str, published: Column) -> DataFrame:
    """The earliest unpublished event of each key."""
    waiting = events.filter(~F.coalesce(published, F.lit(False)))
    first = waiting.groupBy(*by).agg(F.min(sequence).alias(sequence))
    return waiting.join(first, [*by, sequence], "left_semi")


def after_cursor(events: DataFrame, sequence: str, cursor: int, n: int) -> DataFrame:
    return events.filter(F.col(sequence) > cursor).orderBy(sequence).limit(n)


def claim(jobs: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The jobs to take next: due ones, oldest first."""
    return jobs.filter(F.col("available_at") <= as_of).orderBy("available_at", "created_at", "id").limit(n)


def keep_newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest rows of each key, as by a length limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def first_receipts(events: DataFrame, receipts: DataFrame, by: list[str]) -> DataFrame:
    """Events that a consumer hasn't seen, each once."""
    return events.dropDuplicates(by).join(receipts, by, "left_anti")


def repeats(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """All but the first event of each idempotency key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return events.withColumn("copy", F.row_number().over(w)).filter("copy > 1")


def expire_leases(jobs: DataFrame, as_of: Column, max_attempts: int) -> DataFrame:
    """Running jobs whose lease has run out go back to the queue, or wait for a person after the last attempt."""
    lost = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= as_of)
    status = F.when(lost & (F.col("attempt") >= max_attempts), "WAITING").when(lost, "QUEUED").otherwise(F.col("status"))
    attempt = F.when(lost & (F.col("attempt") < max_attempts), F.col("attempt") + 1).otherwise(F.col("attempt"))
    return jobs.withColumns({"new_status": status, "new_attempt": attempt})


def expire_deadlines(runs: DataFrame, steps: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, steps, events): runs that haven't ended by their deadline are expired and their open steps cancelled, with an event each."""
    over = ~F.col("status").isin(terminal("RUN")) & (F.col("deadline_at") <= as_of)
    code = F.lit("RUN_DEADLINE_EXCEEDED")
    marked = runs.withColumns({"new_status": F.when(over, "EXPIRED").otherwise(F.col("status")), "failure_code": F.when(over, code)})
    gone = runs.filter(over).select("run")
    late = steps.join(gone.withColumn("late", F.lit(True)), "run", "left")
    closed = F.col("late") & F.col("status").isin("QUEUED", "RUNNING")
    late = late.withColumns({"new_status": F.when(closed, "CANCELLED").otherwise(F.col("status")), "error_code": F.when(closed, code)}).drop("late")
    return marked, late, gone.withColumn("event_type", F.lit("run.expired"))


def redact_expired(rows: DataFrame, as_of: Column) -> DataFrame:
    """Texts past their time are dropped; their hashes stay."""
    gone = F.col("expires_at") <= as_of
    return rows.withColumns({"content_sha256": F.sha2("text", 256), "state": F.when(gone, "REDACTED").otherwise("PRESENT"), "text": F.when(gone, None).otherwise(F.col("text"))})


def illegal_transitions(steps: DataFrame) -> DataFrame:
    """Rows (machine, from_state, to_state) that their machine doesn't allow."""
    pairs = [(m, a, b) for m, (table, stay) in MACHINES.items() for a, to in table.items() for b in (*to, *((a,) if stay else ()))]
    allowed = steps.sparkSession.createDataFrame(pairs, "machine string, from_state string, to_state string")
    return steps.join(F.broadcast(allowed), ["machine", "from_state", "to_state"], "left_anti")


def terminal(machine: str) -> list[str]:
    """The states of a machine that nothing leaves."""
    return [s for s, to in MACHINES[machine][0].items() if not to]


def replays(requests: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add outcome: CREATED for a key's first request, REPLAYED for the same request again, CONFLICT for another."""
    first = requests.groupBy(*by).agg(F.min_by("request_sha256", order).alias("__sha"), F.min(order).alias("__first"))
    joined = requests.join(first, by)
    outcome = F.when(F.col(order) == F.col("__first"), "CREATED").when(F.col("request_sha256") == F.col("__sha"), "REPLAYED").otherwise("CONFLICT")
    return joined.withColumn("outcome", outcome).drop("__sha", "__first")


def lag_histogram(rows: DataFrame, lag: Column, bounds: tuple[float, ...], *by: str) -> DataFrame:
    """by, le, n: cumulative counts up to each bound, and all."""
    counts = rows.groupBy(*by).agg(*[F.count_if(lag <= b).alias(f"b{i}") for i, b in enumerate((*bounds, float("inf")))])
    names = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate((*bounds, float("inf")))])
    return counts.select(*by, F.explode(names).alias("x")).select(*by, "x.le", "x.n")


def progress(steps: DataFrame, weights: dict[str, int], *by: str) -> DataFrame:
    """by, overall: the steps' percentages by weight, at most 100.

    A step that has succeeded is done whatever its numbers; one without a percentage has that of its units, or 0 where their
    total isn't known. ``steps`` has step, status, percent, processed and total.
    """
    table = steps.sparkSession.createDataFrame(list(weights.items()), "step string, weight int")
    done = F.when(F.col("status") == "SUCCEEDED", 100.0).otherwise(F.coalesce("percent", stage_percent(F.col("processed"), F.col("total")), F.lit(0.0)))
    total = F.sum(F.col("weight") * done.cast("decimal(12,6)"))  # exact, so that halves are rounded alike in any order
    whole = F.round(F.least(F.lit(100).cast("decimal(5,2)"), total / 100), 2).cast("double")
    return steps.join(F.broadcast(table), "step").groupBy(*by).agg(whole.alias("overall"))


def stage_of(event_type: Column) -> Column:
    """Which stage an event goes to."""
    return (
        F.when(event_type.contains("ingestion.requested"), "PARSE").when(event_type.contains("knowledge_processing"), "CHUNK")
        .when(event_type.contains("indexing"), "INDEX").when(event_type.startswith("index.") | event_type.contains("cache"), "PROJECT").otherwise("UNKNOWN")
    )


def renew_leases(jobs: DataFrame, owner: str, as_of: Column, seconds: int) -> DataFrame:
    """Leases that are the owner's and still hold are moved on; others stay as they are."""
    mine = (F.col("status") == "RUNNING") & (F.col("lease_owner") == owner) & (F.col("lease_expires_at") > as_of)
    return jobs.withColumn("lease_expires_at", F.when(mine, as_of + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("lease_expires_at")))


def outbox_results(claimed: DataFrame, as_of: Column, max_attempts: int) -> DataFrame:
    """What becomes of claimed events (``ok`` says whether one was published): published, tried again later, or dead."""
    from pagewright.functions.numbers import backoff_seconds

    state = F.when(F.col("ok"), "PUBLISHED").when(F.col("attempts") + 1 >= max_attempts, "DEAD").otherwise("PENDING")
    later = as_of + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))
    return claimed.withColumn("state", state).withColumn("available_at", F.when(F.col("state") == "PENDING", later).otherwise(F.col("available_at")))


def retained(rows: DataFrame, by: list[str], order: str, n: int, at: str, as_of: Column, seconds: int) -> DataFrame:
    """What a stream with a length limit and a time to live still holds: each key's newest rows, if one came within that time."""
    newest = keep_newest(rows, by, [F.desc(order)], n)
    alive = rows.groupBy(*by).agg(F.max(at).alias("__last")).filter(F.col("__last") + F.make_dt_interval(secs=F.lit(seconds)) > as_of)
    return newest.join(alive.select(*by), by, "left_semi")


def publish_results(claimed: DataFrame, *by: str) -> DataFrame:
    """by, claimed, published, failed, lag: how many events were published and the seconds from their time to it, at least 0, summed."""
    lag = F.greatest(F.lit(0.0), F.col("published_at").cast("double") - F.col("occurred_at").cast("double"))
    return claimed.groupBy(*by).agg(F.count(F.lit(1)).alias("claimed"), F.count_if("ok").alias("published"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.sum(F.when(F.col("ok"), lag)), 3).alias("lag"))
