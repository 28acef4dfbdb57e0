"""Blocks to chunks: packing under a token budget, splitting, links and duplicates.

Packing is a fold over a document's blocks in order: sorted rows stream through
a task, which keeps a running total. Groups that grow with the data, such as
sources, are packed by ``pack_blocks``, where a task holds a block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.shared import write_shared


def _no_overlap(child: int, parent: int, overlap: int) -> None:
    if child < 8 or parent < child or not 0 <= overlap < child:
        raise ValueError("child >= 8, parent >= child and 0 <= overlap < child are needed")


def packed(rows: DataFrame, keys: list[str], order: list[str], unit: list[str], head: str, size: str, alone: str, most: int, items: int | None = None) -> DataFrame:
    """Add pack, from 1 in each group of ``keys``: the running number of packs under ``most`` tokens.

    A pack ends where ``unit`` changes, before and after a row that stays ``alone``, and where its rows' sizes and the next
    one's head and size would be more than ``most``, or its rows more than ``items``. Rows are sorted within tasks and
    streamed, a batch at a time; what a task keeps is one running total.
    """
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    at = [ordered.columns.index(c) for c in (*keys, *unit)]
    head_, size_, alone_ = (ordered.columns.index(c) for c in (head, size, alone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = part = None
        number = total = held = 0
        lonely = False
        for b in batches:
            names = list(zip(*(b.column(c).to_pylist() for c in at), strict=True))
            out = []
            for name, h, s, single in zip(names, b.column(head_).to_pylist(), b.column(size_).to_pylist(), b.column(alone_).to_pylist(), strict=True):
                if name[: len(keys)] != group:
                    group, number, part = name[: len(keys)], 0, None
                if name != part or single or lonely or h + total + s > most or held == items:
                    number, total, held = number + 1, 0, 0
                part, total, lonely, held = name, total + s, single, held + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "pack"])

    return ordered.mapInArrow(run, ordered.withColumn("pack", F.lit(0)).schema)


def pack(rows: DataFrame, by: list[str], size: str, most: int, items: int | None = None, order: str = "ordinal", head: Column | None = None) -> DataFrame:
    """by, pack, first, n, size: rows of a group packed in order under a budget of tokens (and of items); ``head`` comes with every pack."""
    flat = rows.select(*by, F.col(order).alias("o"), F.col(size).cast("long").alias("s"), (F.lit(0) if head is None else head).cast("long").alias("h"), F.lit(False).alias("alone"))
    numbered = packed(flat, by, ["o", "s"], [], "h", "s", "alone", most, items)
    return numbered.groupBy(*by, "pack").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n"), (F.first("h") + F.sum("s")).alias("size"))


def _ends(sizes: np.ndarray, most: int, items: int) -> np.ndarray:
    """Where the next pack begins if one begins at each place."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + most, "right") - 1, at + 1), at + items)


def pack_blocks(rows: DataFrame, by: list[str], size: str, most: int, items: int, order: str = "ordinal", block: int = 50_000) -> DataFrame:
    """What ``pack`` gives, for groups of any size: rows are cut into ordered blocks of about ``block`` rows.

    A pack has at most ``items`` items, so the first one that begins in a block begins at one of its first ``items`` places,
    and it ends within ``items`` places after the block. Each block tells for all these entries how many packs begin in it and
    where the next block is entered; a group's blocks are chained on these small tables, and then each makes its own packs.
    """
    flat = rows.select(*by, F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    n = max(1, -(-rows.count() // block))
    cut = write_shared(flat.repartitionByRange(n, *by, "o", "s").withColumn("block", F.spark_partition_id()), "pack-blocks")
    keys = [*by, "block"]
    types = {f.name: f.dataType.simpleString() for f in cut.schema}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)

    heads = cut.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "s"))).filter(F.col("i") <= items)
    heads = heads.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("head"))
    after = Window.partitionBy(*by).orderBy("block").rowsBetween(1, items)
    ahead = write_shared(heads.select(*keys, F.slice(F.flatten(F.collect_list("head").over(after)), 1, items).alias("ahead")), "pack-ahead")

    def sizes_of(f: pd.DataFrame, more: pd.DataFrame) -> np.ndarray:
        return np.concatenate([f["s"].to_numpy(np.int64), np.asarray(more["ahead"].iloc[0], np.int64)])

    def exits(f: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        size_, ends = len(f), _ends(sizes_of(f.sort_values(["o", "s"]), more), most, items)
        out, count = np.arange(size_ + items) - size_, np.zeros(size_ + items, np.int64)
        for i in range(size_ - 1, -1, -1):
            out[i], count[i] = out[ends[i]], count[ends[i]] + 1
        return more[keys].assign(exits=[out[:items]], counts=[count[:items]])

    def chained(f: pd.DataFrame) -> pd.DataFrame:
        f, entry, pack_ = f.sort_values("block"), 0, 1
        entries, firsts = [], []
        for out, count in zip(f["exits"], f["counts"], strict=True):
            entries.append(entry), firsts.append(pack_)
            entry, pack_ = int(out[entry]), pack_ + int(count[entry])
        return f[keys].assign(entry=entries, pack=firsts)

    def packed(f: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["o", "s"])
        sizes = sizes_of(f, more)
        ends, sums = _ends(sizes, most, items), np.concatenate([[0], np.cumsum(sizes)])
        at, begins = int(more["entry"].iloc[0]), []
        while at < len(f):
            begins.append(at)
            at = int(ends[at])
        begins = np.array(begins, np.int64)
        out = f.iloc[begins][[*by, "o"]].rename(columns={"o": "first"})
        return out.assign(pack=int(more["pack"].iloc[0]) + np.arange(len(begins)), n=ends[begins] - begins, size=sums[ends[begins]] - sums[begins])[[*by, "pack", "first", "n", "size"]]

    told = cut.groupBy(*keys).cogroup(ahead.groupBy(*keys)).applyInPandas(exits, f"{named}, exits array<long>, counts array<long>")
    entered = told.groupBy(*by).applyInPandas(chained, f"{named}, entry long, pack long")
    plans = ahead.join(entered, keys)
    groups = ", ".join(f"`{k}` {types[k]}" for k in by)
    made = cut.groupBy(*keys).cogroup(plans.groupBy(*keys)).applyInPandas(packed, f"{groups}, pack long, first {types['o']}, n long, size long")
    return made.withColumn("pack", F.col("pack").cast("int"))


def token_windows(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """doc_id, part, n_tokens, text: windows of ``most`` words that overlap; the last ends with the text."""
    _no_overlap(most, most, overlap)
    windows = text.word_windows(F.col("text"), F.lit(most), F.lit(overlap))
    parts = docs.select("doc_id", F.posexplode(windows).alias("part", "text"))
    return parts.select("doc_id", "part", text.token_count(F.col("text")).cast("int").alias("n_tokens"), "text")


def duplicates(chunks: DataFrame, by: list[str], content: str = "text", order: str = "ordinal") -> DataFrame:
    """Add dedup_hash, dedup_status, duplicate_of: the first of equal contents in a group stays.

    The firsts are aggregated task by task and joined back, so a text that many rows share is no window of its own.
    """
    rows = chunks.withColumn("dedup_hash", F.sha2(text.canonical(F.col(content)), 256))
    firsts = rows.groupBy(*by, "dedup_hash").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    joined = rows.join(firsts, [*by, "dedup_hash"])
    status = F.when(F.col("__n") == 1, "UNIQUE").when(F.col(order) == F.col("__first"), "UNIQUE").otherwise("SUPPRESSED_DUPLICATE")
    return joined.withColumn("dedup_status", status).withColumn("duplicate_of", F.when(F.col(order) != F.col("__first"), F.col("__first"))).drop("__first", "__n")


def repeated_atoms(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, canonical, n: texts that come more than once in a group."""
    rows = blocks.select(*by, text.canonical(F.col("text")).alias("canonical"))
    return rows.groupBy(*by, "canonical").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def neighbours(rows: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Add previous and next."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def footnotes(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, note, chunk: each footnote and the last chunk of its page; a page that isn't known matches one that isn't either."""
    last = chunks.groupBy("doc_id", "page_no").agg(F.max_by("chunk", "ordinal").alias("chunk"))
    a, b = notes.alias("a"), last.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & F.col("a.page_no").eqNullSafe(F.col("b.page_no"))).select("a.doc_id", "a.note", "b.chunk")


def table_groups(tables: DataFrame, most: int) -> DataFrame:
    """table_id, pack, first, n, size: row groups of tables, each with the header's tokens repeated.

    ``tables`` has table_id, ordinal, cells and is_header; a table without data rows counts its header rows as rows.
    """
    rows = tables.withColumn("tokens", text.token_count(text.table_row(F.col("cells"))))
    heads = rows.groupBy("table_id").agg(F.sum(F.when(F.col("is_header"), F.col("tokens")).otherwise(0)).alias("head"), F.bool_and("is_header").alias("only"))
    data = rows.join(heads, "table_id").filter(~F.col("is_header") | F.col("only"))
    return pack(data, ["table_id"], "tokens", most, head=F.when(F.col("only"), 0).otherwise(F.col("head")))
