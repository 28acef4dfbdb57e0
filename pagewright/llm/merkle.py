"""Merkle manifest of a table, with a proof for every row.

Every row is a leaf, a digest of its columns. The leaves of a tree (here: of a
language) are numbered in order by a range sort, and the number of leaves gives
the size of every level and so every parent's arity. Nodes then climb by
``combineByKey`` over blocks of ``arity ** levels`` nodes: the combiner holds
partial parents, each child's digest is an event for its parent, and a parent
that has as many as its arity is hashed at once and becomes an event for its
own parent. As the leaves come in order, tasks finish nearly all parents
before the shuffle; what is left of a block, its unresolved frontier, meets the
rest of it after the shuffle, and the blocks' tops are the next round's nodes.

Proofs go the other way: the top of a block hands its own proof down to the
nodes it came from, which add their siblings below it. A block is rebuilt from
its nodes for that, so no digest but the blocks' tops is ever stored.

A task holds a block of 512 nodes; rounds are as many as the logarithm of the
rows to that base. Nothing is collected but the largest tree's size per round.

Defined cases: a null column is hashed as ``-``, any other value as its number
of UTF-8 bytes, ``:`` and itself, so null and empty differ; the null language
is a tree of its own, before all others; leaves ascend by doc_id, nulls first,
rows of one doc_id by their digests; rows that are equal throughout are leaves
of their own, next to each other; a table with one language has a root that is
that tree's; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.shared import write_shared

ARITY = 8
LEVELS = 3  # of a block
FEW = 100_000  # rows of counts that are sent to every task
PROOF = "array<struct<left:string,right:string>>"


def digest(parts: list[str]) -> str:
    """Lowercase hex SHA-256 of the digests' hex texts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """A row's digest."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


# ---- numbering ---------------------------------------------------------------------------


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``index`` (from 0, by ``order`` within ``tree``, nulls first) and ``n``, the size of the tree."""
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # parts even rows that are equal throughout
    sorted_ = tied.orderBy(*by, "tie").drop("tie").withColumn("id", F.monotonically_increasing_id())
    sorted_ = write_shared(sorted_, "merkle-order").withColumn("part", F.shiftright("id", 33))
    counts = sorted_.groupBy("tree", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("tree").orderBy("part")  # a row for each partition of the sort that has some of the tree
    counts = counts.select("tree", "part", (F.sum("rows").over(upto) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    counts = write_shared(counts, "merkle-counts")
    if counts.count() <= FEW:
        counts = F.broadcast(counts)
    return sorted_.join(counts, ["tree", "part"]).withColumn("index", F.col("id") + F.col("shift")).drop("id", "part", "shift")


# ---- climbing ----------------------------------------------------------------------------


class Frontier:
    """The partial parents of a block: those whose children haven't all come."""

    __slots__ = ("arity", "levels", "n", "waiting", "top")

    def __init__(self, n: int, arity: int, levels: int) -> None:
        self.n, self.arity, self.levels = n, arity, levels
        self.waiting: dict[tuple[int, int], dict[int, str]] = {}
        self.top: str | None = None

    def event(self, index: int, found: str, level: int = 0) -> Frontier:
        """A node of the block is known; so may be its ancestors."""
        size = self.n
        for _ in range(level):
            size = -(-size // self.arity)
        while level < self.levels and size > 1:
            parent = index // self.arity
            children = self.waiting.setdefault((level, parent), {})
            children[index] = found
            if len(children) < min(self.arity, size - parent * self.arity):
                return self
            del self.waiting[level, parent]
            found = digest([children[i] for i in sorted(children)])
            index, level, size = parent, level + 1, -(-size // self.arity)
        self.top = found
        return self

    def merge(self, other: Frontier) -> Frontier:
        """What two tasks know of a block."""
        if other.top is not None:
            self.top = other.top
        for (level, _), children in other.waiting.items():
            for index, found in children.items():
                self.event(index, found, level)
        return self


def climb(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of every round, first those given, last the one that each tree ends in; ``nodes`` has tree, index, n and digest."""
    spark = nodes.sparkSession
    span = arity**levels
    rounds = [nodes]
    while (nodes.agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        keyed = nodes.select("tree", "index", "n", "digest").rdd.map(lambda r: ((r[0], r[1] // span), r[1:]))
        blocks = keyed.combineByKey(
            lambda v: Frontier(v[1], arity, levels).event(v[0], v[2]),
            lambda c, v: c.event(v[0], v[2]),
            lambda c, d: c.merge(d),
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            lambda k: zlib.crc32(repr(k).encode()),
        )

        def tops(found: Iterator) -> Iterator[tuple[str, int, int, str]]:
            for (tree, block), frontier in found:
                if frontier.top is None or frontier.waiting:
                    raise ValueError("nodes of a block are missing")
                yield tree, block, -(-frontier.n // span), frontier.top

        made = spark.createDataFrame(blocks.mapPartitions(tops), "tree string, index long, n long, digest string", verifySchema=False)
        nodes = write_shared(made, "merkle-nodes")
        rounds.append(nodes)
    return rounds


# ---- proofs ------------------------------------------------------------------------------


def _handed_down(kept: list[str], more: list[str], arity: int, levels: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Of the nodes of a block and the proof of its top: the nodes' proofs."""

    def below(key: tuple, children: pa.Table, parent: pa.Table) -> pa.Table:
        first, n = key[1].as_py() * arity**levels, children["n"][0].as_py()
        at = [i - first for i in children["index"].to_pylist()]
        layers = [[""] * len(at)]
        for i, d in zip(at, children["digest"].to_pylist(), strict=True):
            layers[0][i] = d
        while len(layers) <= levels and n > 1:
            layers.append([digest(layers[-1][i : i + arity]) for i in range(0, len(layers[-1]), arity)])
            n = -(-n // arity)
        rest = parent["proof"][0].as_py()
        rest_left, rest_right = [p["left"] for p in rest], [p["right"] for p in rest]
        left, right = [], []
        for i in at:
            for layer in layers[:-1]:
                begin = i // arity * arity
                left.append("".join(layer[begin:i]))
                right.append("".join(layer[i + 1 : begin + arity]))
                i //= arity
            left += rest_left
            right += rest_right
        depth = len(layers) - 1 + len(rest)
        offsets = pa.array(range(0, (len(at) + 1) * depth, depth) if depth else [0] * (len(at) + 1), pa.int32())
        proof = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        whole = {c: pa.array([parent[c][0].as_py()] * len(at), pa.string()) for c in more}
        return pa.table({c: children[c] for c in kept} | {"proof": proof} | whole)

    return below


def proofs(rounds: list[DataFrame], tops: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The rows of the first round with their proofs, bottom up, and what else ``tops`` says of their tree.

    ``tops`` has tree, proof (the part of it above the tree) and any other columns.
    """
    span = arity**levels
    more = [c for c in tops.columns if c not in ("tree", "proof")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for step, nodes in enumerate(reversed(rounds[:-1]), 2):
        last = step == len(rounds)
        kept = [c for c in nodes.columns if last or c in ("tree", "index")]
        rows = nodes.withColumn("block", F.expr(f"index div {span}"))
        types = dict(nodes.dtypes)
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"proof {PROOF}", *(f"`{c}` string" for c in more)])
        met = rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_handed_down(kept, more, arity, levels), schema)
        if last:
            return met
        above = met.withColumnRenamed("index", "block")
    return rounds[0].join(tops, "tree")  # every tree is one node


def folded(found: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, found, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


# ---- the manifest ------------------------------------------------------------------------


def manifest(rows: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``rows`` has group, order and leaf, and may have more; returns them with subroot, root and proof.

    Groups are trees of leaves that ascend by order; the groups' roots, by group (null first), are the leaves of the whole.
    """
    # a key that sorts the null group first and is never null itself
    tree = F.when(F.col("group").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("group")))
    leaves = numbered(rows.withColumn("tree", tree).drop("group").withColumnRenamed("leaf", "digest"), "order", "digest")
    rounds = climb(leaves, arity, levels)
    groups = numbered(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "group")
    above = climb(groups, arity, levels)
    root = above[-1].select("tree", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    tops = proofs(above, root, arity, levels).select(F.col("group").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    return proofs(rounds, write_shared(tops, "merkle-tops"), arity, levels).drop("tree", "index", "n").withColumnRenamed("digest", "leaf")


def tampered_proofs(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS, every: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof and ``shown``, the leaf that a reader would see.

    Of rows whose crc32 of the decimal doc_id is divisible by ``every`` the reader sees the text with its A-Z lower-cased;
    a null doc_id is never tampered with.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    hit = F.crc32(doc_id.cast("string").cast("binary")) % every == 0

    def hashed(body: Column) -> Column:
        return leaf(doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), body)

    changed = F.when(hit & text.rlike("[A-Z]"), hashed(F.translate(text, upper, upper.lower())))
    leaves = docs.select(F.col("lang").cast("string").alias("group"), doc_id.alias("order"), hashed(text).alias("leaf"), changed.alias("changed"))
    found = manifest(write_shared(leaves, "merkle-leaves"), arity, levels)
    return found.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", "proof", F.coalesce("changed", "leaf").alias("shown"))
