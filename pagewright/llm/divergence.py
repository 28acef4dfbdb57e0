"""Audit of how far sources diverge, by joint histograms of counts.

Terms are counted per (language, source) with sums in the tasks before the
shuffle. For each pair of sources of a language the terms' pairs of counts are
tallied: how many terms have this count here and that count there. A task
tallies its terms' counts in numpy, so that what leaves it are tallies, never
pairs of rows. Cells with a zero are implied: a source's own histogram less
what the pair has in common gives the terms that only one of the two has, and
the number of terms less all those gives the terms that neither has. A
divergence is then evaluated once for each combination of counts, times its
multiplicity.

The work grows with the sources that share a term, squared, as the result does
with the sources of a language; a task holds one batch of terms and at most
``HELD`` terms' sums.

All arithmetic is exact: shares are integers of a billionth, from decimals.

Defined cases: null text, language and source are empty ones; only A-Z are
lower-cased; a language none of whose terms is frequent enough gives value 0
for every pair and no terms; rows with null or repeated ids are documents of
their own; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.shared import write_shared

HELD = 300_000  # terms whose sums a task holds before it sends them
PAIRS = 2_000_000  # pairs of counts that are tallied at a time
FEW = 100_000  # groups that are sent to every task
UNIT = 1_000_000_000

# A-Z to lower case, other ASCII characters that are no letters to spaces; bytes from 0x80 are parts of terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and characters beyond ASCII."""
    return text.translate(_TERMS).split()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows, in parts of about ``HELD``."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            names, counts = list(found), list(found.values())
            in_docs = list(map(docs[lang, source].__getitem__, names))
            texts = pa.array(names, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(names)), pa.repeat(pa.scalar(source, pa.string()), len(names)), texts, pa.array(counts, pa.int64()), pa.array(in_docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        n.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found, own = terms(text), docs[lang, source]
            before = len(own)
            n[lang, source].update(found)
            own.update(set(found))
            held += len(own) - before
            if held > HELD:
                yield from sent()
                held = 0
    yield from sent()


def _named(docs: DataFrame) -> DataFrame:
    """(lang, source, text) of documents; null is empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, dealt out by language and term.

    The tasks' sums are shuffled once; what follows by language and term finds its rows together. A term has at most a row
    for each source and part of a task.
    """
    rows = _named(docs).withColumn("text", F.col("text").cast("binary"))
    sums = rows.mapInArrow(_sums, "lang string, source string, term string, n long, docs long")
    return sums.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequent(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, cells) of terms in at least ``least`` documents of a language; cells are (source, n) by source."""
    by_term = counts.groupBy("lang", "term")
    found = by_term.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return found.filter(F.col("docs") >= least).drop("docs")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2 v)), exact; null where v is 0."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(v > 0, 1 + F.call_function("div", top, (n + 2 * v).cast("decimal(20,0)")))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); at most p + q, which are at most a billion and one each."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, s, t, cs, ct, m) of rows (lang, cells): how many of them have count cs in source s and ct in t, both above 0 and s before t."""
    for b in batches:
        lang = b.column(0).dictionary_encode()
        cells = b.column(1)
        offsets = cells.offsets.to_numpy()
        flat = cells.values
        source = flat.field(0).dictionary_encode()
        code, n, of = source.indices.to_numpy(), flat.field(1).to_numpy(), lang.indices.to_numpy()
        sizes = np.diff(offsets)
        waiting, held = [], 0

        def made(parts: list[tuple]) -> pa.RecordBatch:
            whole = pd.DataFrame({k: np.concatenate(x) for k, x in zip(("lang", "s", "t", "cs", "ct"), zip(*parts, strict=True), strict=True)})
            found = whole.groupby(["lang", "s", "t", "cs", "ct"], sort=False).size().reset_index(name="m")
            names = [lang.dictionary.take(pa.array(found["lang"])), source.dictionary.take(pa.array(found["s"])), source.dictionary.take(pa.array(found["t"]))]
            return pa.RecordBatch.from_arrays([pc.cast(x, pa.string()) for x in names] + [pa.array(found[c].to_numpy(np.int64)) for c in ("cs", "ct", "m")], ["lang", "s", "t", "cs", "ct", "m"])

        for k in np.unique(sizes[sizes > 1]):
            begins, langs = offsets[:-1][sizes == k], of[sizes == k]
            step = max(1, PAIRS // int(k))
            for low in range(0, len(begins), step):
                start, own = begins[low : low + step], langs[low : low + step]
                for i in range(k - 1):
                    first, later = start + i, start[:, None] + np.arange(i + 1, k)
                    wide = later.shape[1]
                    later = later.ravel()
                    waiting.append((np.repeat(own, wide), np.repeat(code[first], wide), code[later], np.repeat(n[first], wide), n[later]))
                    held += len(later)
                    if held >= PAIRS:
                        yield made(waiting)
                        waiting, held = [], 0
        if waiting:
            yield made(waiting)


def joint(kept: DataFrame) -> DataFrame:
    """(lang, s, t, cs, ct, m): for each pair of sources, s before t, the number of terms with counts cs and ct, both above 0."""
    found = kept.select("lang", "cells").mapInArrow(_tally, "lang string, s string, t string, cs long, ct long, m long")
    return found.groupBy("lang", "s", "t", "cs", "ct").agg(F.sum("m").alias("m"))


def with_zeros(both: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """``both`` with the implied cells: every term of the language is counted once in each pair's histogram."""
    zero = F.lit(0).cast("long")

    def rows(frame: DataFrame, *cells: tuple) -> DataFrame:
        made = F.explode(F.array(*[F.struct(cs.alias("cs"), ct.alias("ct"), m.cast("long").alias("m")) for cs, ct, m in cells]))
        return frame.select("lang", "s", "t", made.alias("c")).select("lang", "s", "t", "c.*")

    cs, ct, m = F.col("cs"), F.col("ct"), F.col("m")
    alone = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    alone = write_shared(alone, "divergence-histograms")
    left = pairs.join(alone.withColumnRenamed("source", "s"), ["lang", "s"])
    right = pairs.join(alone.withColumnRenamed("source", "t"), ["lang", "t"])
    parts = [
        rows(both, (cs, ct, m), (cs, zero, -m), (zero, ct, -m), (zero, zero, m)),
        rows(left, (F.col("c"), zero, m), (zero, zero, -m)),
        rows(right, (zero, F.col("c"), m), (zero, zero, -m)),
        rows(pairs, (zero, zero, F.col("v"))),
    ]
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return cells.groupBy("lang", "s", "t", "cs", "ct").agg(F.sum("m").alias("m")).filter("m > 0")


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language, and its terms against the language."""
    kept = write_shared(frequent(counted(docs), least), "divergence-terms")
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    groups = _named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = write_shared(groups.na.fill(0, ["n", "v", "lang_n"]), "divergence-groups")

    # pairs of sources: the result has each of them twice
    one = groups.select("lang", F.col("source").alias("s"), F.col("n").alias("ns"), "v")
    other = groups.select("lang", F.col("source").alias("t"), F.col("n").alias("nt"))
    pairs = write_shared(one.join(other, "lang").filter(F.col("s") < F.col("t")), "divergence-pairs")
    tallied = with_zeros(joint(kept), kept, pairs)
    value = divergence(share(F.col("cs"), F.col("ns"), F.col("v")), share(F.col("ct"), F.col("nt"), F.col("v")))
    summed = tallied.join(pairs, ["lang", "s", "t"]).groupBy("lang", "s", "t").agg(F.sum(value * F.col("m")).alias("value"))
    valued = pairs.select("lang", "s", "t").join(summed, ["lang", "s", "t"], "left").na.fill(0, ["value"])
    ways = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    by_pair = valued.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    # terms that a source has more of than its language
    known = groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n")
    known = F.broadcast(known) if groups.count() <= FEW else known
    p, q = share(F.col("n"), F.col("group_n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    more = cells.join(known, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).filter(F.col("p") > F.col("q"))
    by_term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = by_pair.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(by_term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
