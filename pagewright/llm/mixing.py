"""Mixing sources to target weights.

Targets come from a water-filling over the sources: each gets its weight's
share of what is to be mixed, none more than ``cap`` times its own size, and
what a full source leaves is shared again by weight until none is above.

A source is then taken in whole epochs first; what its target asks beyond them
is drawn by Efraimidis-Spirakis sampling: every document gets an exponential
key scaled by its quality weight, the documents are sorted by it within their
source, and the prefix sum of their sizes ends where it comes nearest to the
target. The prefix sums are made in steps: over buckets of the key, over finer
buckets inside the one where the target falls, and so on until that one has at
most ``INSIDE`` rows, so that a source with a third of all rows never lies in
one task. Only rows with equal keys, repeats of one doc_id, can't be parted.

Defined cases: null or empty text has size 0 and is never taken for more than
0 words; the null source is a source of its own, ordered last; sources of
size 0 get target 0; keys depend on doc_id alone, so reruns agree and repeated
rows share a key; an empty table gives an empty result; extra columns stay in
the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.rows import from_files, placed
from pagewright.shared import write_shared

BITS = 12  # a bucket is cut in 2 ** BITS finer ones
LEVELS = 4  # keys have 2 ** (BITS * LEVELS) values
INSIDE = 1 << 16


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ``[\\x20\\x09-\\x0D]``; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.1 and 1: short texts and odd mean word lengths weigh less."""
    mean = F.char_length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.1), (size / (size + 20)) / (1 + F.abs(mean - 6.5) / 6.5))


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """Number the rows 0, 1, ... by ``column``, null last, by a range partitioning; no task sees all rows."""
    ordered = sources.orderBy(F.col(column).asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("__id"))
    ordered = write_shared(ordered, "mix-order").withColumn("__part", F.shiftright("__id", 33))
    counts = sorted((r["__part"], r["n"]) for r in ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, before = [], 0
    for part, n in counts:  # one entry per partition of the sort
        offset.append((part, before))
        before += n
    starts = sources.sparkSession.createDataFrame(offset or [(0, 0)], "__part long, __start long")
    return ordered.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__start")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` has source and size; returns source, source_size, target for every source."""
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(n)) + 1).cast("int"))
    sources = write_shared(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "mix-sources")
    total = (sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * share
    level = None  # words per unit of weight; every round fills at least one more source
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.col("weight") * F.lit(level)
        got = sources.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("filled"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not got["open"]:
            break
        new = max(0.0, total - got["filled"]) / got["open"]
        if level is not None and new <= level:
            break
        level = new
    target = F.col("most") if level is None else F.least("most", F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.cast("double").alias("target"))


def _edges(rows: DataFrame, goals: DataFrame, bits: int, inside: int) -> DataFrame:
    """goal_source, source_size, target, epochs, rest and, where a part of a source is asked: the bucket in which the rest falls, its level and the words before it."""
    named = goals.select(F.col("source").alias("goal_source"), "source_size", "target", "epochs", "rest", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("before"))
    narrow = rows.select("source", "size", "cell")
    for level in range(1, LEVELS + 1):
        shift, wider = bits * (LEVELS - level), bits * (LEVELS - level + 1)
        here = narrow.join(named.select("goal_source", "edge"), F.col("source").eqNullSafe(F.col("goal_source"))).filter(F.shiftright("cell", wider) == F.col("edge"))
        sums = here.groupBy("goal_source", F.shiftright("cell", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("goal_source").orderBy("bucket")  # at most 2 ** bits buckets of a source
        sums = sums.withColumn("so_far", F.sum("words").over(upto))
        both = sums.alias("s").join(named.alias("g"), F.col("s.goal_source").eqNullSafe(F.col("g.goal_source"))).withColumn("after", F.col("before") + F.col("so_far"))
        edge = both.filter((F.col("after") - F.col("words") < F.col("rest")) & (F.col("after") >= F.col("rest"))).groupBy(F.col("g.goal_source").alias("goal_source"))
        edge = edge.agg(F.min_by(F.struct("bucket", (F.col("after") - F.col("words")).alias("before"), F.col("s.n").alias("n")), "bucket").alias("to"))
        found = named.alias("g").join(edge.alias("e"), F.col("g.goal_source").eqNullSafe(F.col("e.goal_source")), "left")
        kept = [F.col(f"g.{c}").alias(c) for c in ("goal_source", "source_size", "target", "epochs", "rest")]
        named = found.select(*kept, F.coalesce("to.bucket", F.lit(-1)).alias("edge"), F.coalesce("to.before", F.lit(0)).alias("before"), F.coalesce("to.n", F.lit(0)).alias("n"))
        named = write_shared(named, "mix-edges")
        if (named.agg(F.max("n").alias("n")).first()["n"] or 0) <= inside:
            break
    return named.withColumn("shift", F.lit(shift)).drop("n")


def mix(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, bits: int = BITS, inside: int = INSIDE) -> DataFrame:
    """``sizes`` has doc_id, source, size, weight; returns its rows with source_size, target, copies, taken.

    ``copies`` says how often the mix takes the document.
    """
    goals = write_shared(targets(sizes, weights, share, cap), "mix-targets")
    # u in (0, 1) from doc_id; the key -ln(u)/w grows with 1 - u^(1/w), which is bucketed
    digits = F.left(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(13))
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = sizes.withColumn("key", F.lit(1.0) - F.pow(u, F.lit(1.0) / F.col("weight")))
    last = (1 << bits * LEVELS) - 1
    rows = rows.withColumn("cell", F.least(F.lit(last), (F.col("key") * float(last + 1)).cast("long")))
    part = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", part).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    named = _edges(rows, goals, bits, inside)
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    bucket = F.expr("shiftright(cell, shift)")
    below = rows.filter(bucket != F.col("edge")).withColumn("extra", (bucket < F.col("edge")).cast("int"))
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.filter(bucket == F.col("edge")).withColumn("after", F.col("before") + F.sum("size").over(order))
    # the document at the cut is taken when that comes nearer to the target
    cut = cut.withColumn("extra", ((F.col("after") - F.col("size") < F.col("rest")) & (F.abs(F.col("after") - F.col("rest")) < F.abs(F.col("after") - F.col("size") - F.col("rest")))).cast("int")).drop("after")
    taken = below.unionByName(cut).withColumn("copies", (F.col("epochs") + F.when(F.col("size") > 0, F.col("extra")).otherwise(0)).cast("long"))
    return taken.withColumn("taken", F.col("copies") * F.col("size")).drop("key", "cell", "epochs", "rest", "edge", "before", "shift", "extra")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and quality weight of every document."""
    size = word_count(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), "text")
    return rows.select("doc_id", "source", "size", quality_weight(F.col("text"), F.col("size")).alias("weight"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns stay, whatever their names."""
    rows = placed(from_files(docs))
    text = F.col("doc.text").cast("string")
    size = word_count(text)
    sizes = rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), size.alias("size"), quality_weight(text, size).alias("weight"), "at")
    taken = mix(write_shared(sizes, "mix-sizes"), weights, share, cap).filter("copies > 0").select("at", "copies")
    joined = rows.join(taken.hint("shuffle_hash"), "at")
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
