"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (words are runs of characters other
than ``[\\x20\\x09-\\x0D]``, A-Z lowered; a document of one to four words is one
shingle). The steps:

1. One Arrow pass makes each document's copy key, MinHash signature and band
   keys; documents with equal word sequences collapse into one representative.
2. Representatives that share a band are compared hash by hash: after every
   step of ``Join.step`` values the posterior probability that the similarity
   reaches the threshold, given the matches so far under a uniform prior, is
   looked up, and pairs below ``Join.tolerance`` are dropped. A task sends on a
   spanning forest of the pairs that survive, never the pairs.
3. The forest's components bring documents together that may be similar. Inside
   a component all pairs are pruned as in 2 and the rest verified exactly on
   their shingle sets; links are counted and classes are the components of the
   verified links.

Buckets and components larger than ``Join.block``, or with more than
``Join.block_shingles`` shingles, are cut into blocks, and each pair of blocks
is a unit of work of its own, so that no task holds an unbounded group; pairs
whose set sizes rule the threshold out are skipped. As the links of every row
are counted, a class of n different near copies costs n * n / 2 comparisons.

Exact means the whole shingle sets, as 64-bit hashes of their shingles; copies
are told by 128 bits of their word sequence. Two sets of 20,000 shingles
differ from their hashes in any way with a probability below 1e-10.

Defined cases: null and empty texts, and those of white space only, have no
shingles and no links; equal word sequences are linked; rows are told apart by
where they lie, so repeated and null doc_ids count row by row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.exact_dedup import with_locator
from pagewright.llm.rows import from_files, placed
from pagewright.shared import write_shared


@dataclass(frozen=True)
class Join:
    """Parameters: with 30 bands of 5 values a pair at the threshold shares no band with probability 7e-6."""

    threshold: float = 0.8
    words: int = 5
    bands: int = 30
    rows: int = 5
    step: int = 15
    tolerance: float = 1e-6
    block: int = 1024
    block_shingles: int = 2_000_000
    seed: int = 11

    @property
    def values(self) -> int:
        return self.bands * self.rows


# ---- shingles and signatures -----------------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: a 64-bit finaliser's multipliers
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64, and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over the bytes."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = 1 << max(16, len(raw).bit_length())
    up, down = _powers(size)
    total = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return _mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words, sorted."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = _mixed(h * _BASE + words[k : len(words) - n + 1 + k])
    return np.unique(h)


def copy_key(words: np.ndarray) -> bytes:
    """128 bits of the word sequence."""
    if not len(words):
        return b""
    up, _ = _powers(1 << max(16, len(words).bit_length()))
    a = (words * up[: len(words)]).sum(dtype=np.uint64)
    b = (_mixed(words ^ _MIX[0]) * up[: len(words)]).sum(dtype=np.uint64)
    return np.array([a ^ np.uint64(len(words)), b], np.uint64).tobytes()


def _salts(join: Join) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(join.seed)
    return rng.integers(0, 1 << 32, (join.values, 1), np.uint32), rng.integers(0, 1 << 31, (join.values, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def signature(found: np.ndarray, salts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values of a set of shingle hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(salts[0]), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        h = (x[i : i + 2048] ^ salts[0]) * salts[1]
        h ^= h >> np.uint32(15)
        np.minimum(best, (h * np.uint32(0x2C1B3C6D)).min(axis=1), out=best)
    return best


def _describe(join: Join) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(join)
        for b in batches:
            keys, sizes, sigs, bands = [], [], [], []
            for text in b.column(1).to_pylist():
                words = word_hashes(text or b"")
                found = shingles(words, join.words)
                keys.append(copy_key(words))
                sizes.append(len(found))
                sig = signature(found, salts)
                sigs.append(sig.astype(np.uint16).tobytes())
                h = np.arange(join.bands, dtype=np.uint64)
                for part in sig.reshape(join.bands, join.rows).T:
                    h = _mixed(h * _BASE + part)
                bands.append(h.view(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * join.bands, flat)],
                ["doc_id", "at", "copy", "size", "sig", "bands"],
            )

    return run


# ---- Bayesian pruning ------------------------------------------------------------------


@lru_cache(maxsize=8)
def least_matches(threshold: float, step: int, values: int, tolerance: float) -> tuple[int, ...]:
    """Per step: how many of the values compared so far must match for the posterior to reach the tolerance.

    With a uniform prior the posterior of s given m matches of n is Beta(m + 1, n - m + 1), so the
    probability of s >= t is a binomial sum.
    """
    out = []
    for n in range(step, values + 1, step):
        cumulative, least = 0.0, n + 1
        for m in range(n + 1):
            cumulative += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if cumulative >= tolerance:
                least = m
                break
        out.append(least)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, join: Join) -> np.ndarray:
    """Which pairs (rows ``left`` of ``a``, ``right`` of ``b``) outlast the incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(join.threshold, join.step, join.values, join.tolerance)):
        if not len(alive):
            break
        part = slice(k * join.step, (k + 1) * join.step)
        matches = matches + (a[left[alive], part] == b[right[alive], part]).sum(axis=1)
        good = matches >= least
        alive, matches = alive[good], matches[good]
    return alive


def _pairs(n: int, m: int, same: bool, sizes_a: np.ndarray, sizes_b: np.ndarray, join: Join) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of two blocks that their set sizes allow, some rows of the first block at a time."""
    rows = max(1, 200_000 // max(1, m))
    for i in range(0, n, rows):
        x, y = sizes_a[i : i + rows, None], sizes_b[None, :]
        ok = np.minimum(x, y) >= join.threshold * np.maximum(x, y) - 1e-9
        if same:
            ok &= np.arange(i, min(n, i + rows))[:, None] < np.arange(m)[None, :]
        left, right = np.nonzero(ok)
        yield left + i, right


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by them."""
    open_: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = np.stack([t.column(c).to_numpy() for c in keys])
        cuts = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [t.num_rows]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[:, i])
            if open_ and key != last:
                yield pa.concat_tables(open_)
                open_ = []
            open_.append(t.slice(i, j - i))
            last = key
    if open_:
        yield pa.concat_tables(open_)


def _two_blocks(side: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, bool]:
    a = np.flatnonzero(side == i)
    return (a, a, True) if i == j else (a, np.flatnonzero(side == j), False)


def _forest_edges(join: Join):
    """Per bucket, or pair of its blocks: edges of a spanning forest of the pairs that survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("band", "i", "j")):
            ids, sizes, side = (t.column(c).to_numpy() for c in ("rep", "size", "side"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), join.values)
            a, b, same = _two_blocks(side, int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py()))
            forest = Forest(len(ids))
            for left, right in _pairs(len(a), len(b), same, sizes[a], sizes[b], join):
                root = np.array([forest.root(x) for x in range(len(ids))])
                apart = root[a[left]] != root[b[right]]  # joined already: nothing to learn here
                left, right = left[apart], right[apart]
                good = survivors(sig, sig, a[left], b[right], join)
                for x, y in zip(a[left[good]].tolist(), b[right[good]].tolist(), strict=True):
                    forest.join(x, y)
            root = np.array([forest.root(x) for x in range(len(ids))])
            moved = root != np.arange(len(ids))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    return run


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the given pairs of sets."""
    if len(left) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(left.tolist(), right.tolist(), strict=True)], dtype=np.int64)
    # many pairs: membership matrices over some shingles at a time
    all_, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    width = max(256, 8_000_000 // len(sets))
    total = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, len(all_), width):
        lo, hi = np.searchsorted(at, (k, k + width))
        m = np.zeros((len(sets), min(width, len(all_) - k)), np.float32)
        m[row[lo:hi], at[lo:hi] - k] = 1
        total += m @ m.T
    return total[left, right].astype(np.int64)


def _verify(join: Join):
    """Per component, or pair of its blocks: how many rows each representative is linked to, and forest edges of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(join)
        for t in grouped(batches, ("comp", "i", "j")):
            ids, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "side"))
            i, j = int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py())
            sets = [shingles(word_hashes(x), join.words) for x in t.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            sig = np.stack([signature(s, salts) for s in sets]).astype(np.uint16)
            a, b, same = _two_blocks(side, i, j)
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            kept_l, kept_r = [], []
            for left, right in _pairs(len(a), len(b), same, sizes[a], sizes[b], join):
                good = survivors(sig, sig, a[left], b[right], join)
                kept_l.append(a[left[good]]), kept_r.append(b[right[good]])
            left, right = np.concatenate(kept_l or [np.zeros(0, np.int64)]), np.concatenate(kept_r or [np.zeros(0, np.int64)])
            if len(left):
                shared = _shared_counts(sets, left, right)
                # shared / union >= threshold, on integers up to the threshold's own rounding
                linked = shared >= join.threshold * (sizes[left] + sizes[right] - shared) - 1e-9
                left, right = left[linked], right[linked]
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                for x, y in zip(left.tolist(), right.tolist(), strict=True):
                    forest.join(x, y)
            root = np.array([forest.root(x) for x in range(len(ids))])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(links)], ["rep", "root", "links"])

    return run


# ---- the join --------------------------------------------------------------------------


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, comp)`` for the nodes of ``edges`` (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star steps until the edges no longer change; each is grouped by node and written to
    the shared folder. A path of n nodes takes about log n rounds.
    """
    e = write_shared(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join deals its rows out by itself and Spark can split the rows of a node with many neighbours
        low = write_shared(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        new = write_shared(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
        same = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first() == new.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        e = new
        if same:
            break
    stars = e.groupBy("a").agg(F.min("b").alias("comp"))
    return stars.select(F.col("a").alias("node"), "comp").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct().join(stars.select(F.col("a").alias("node")), "node", "left_anti"))


def _blocked(rows: DataFrame, blocks: str) -> DataFrame:
    """Give each row its block, one of so many, and a copy for every pair of blocks it takes part in: columns side, i, j."""
    n = F.col(blocks)
    side = F.when(n <= 1, 0).otherwise(F.pmod(F.xxhash64(F.lit(3), "rep"), n)).cast("int")
    rows = rows.withColumn("side", side).withColumn("with", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("i", F.least("side", "with").cast("int")).withColumn("j", F.greatest("side", "with").cast("int")).drop(blocks, "with")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out by the keys, and sort them within their task."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row per row of ``docs``: doc_id, at (where the row lies), class_id, n_links, kept.

    class_id is the smallest doc_id of those reachable over links; n_links counts the other rows whose
    similarity reaches the threshold; kept holds for one row of each class, with the smallest doc_id.
    """
    rows = with_locator(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "at")
    described = rows.mapInArrow(_describe(join), "doc_id long, at struct<file:string,row:long>, copy binary, size int, sig binary, bands array<long>")
    described = write_shared(described.withColumn("row", F.monotonically_increasing_id()), "jaccard-docs")
    full = described.filter("size > 0")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    reps = full.groupBy("copy").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = write_shared(reps.select("copy", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("low"), "copies"), "jaccard-copies")
    own = full.withColumnRenamed("row", "rep").join(reps.select("rep"), "rep", "left_semi").select("rep", "at", "size", "sig", "bands")
    own = write_shared(own, "jaccard-reps")

    flat = own.select("rep", F.explode("bands").alias("band"))
    buckets = flat.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / join.block).cast("int").alias("total"))
    members = write_shared(flat.join(buckets, "band"), "jaccard-members")
    compared = _blocked(members.join(own.select("rep", "size", "sig"), "rep"), "total")
    edges = _dealt(compared.select("band", "i", "j", "side", "rep", "size", "sig"), "band", "i", "j").mapInArrow(_forest_edges(join), "a long, b long")
    comps = write_shared(components(edges, "jaccard"), "jaccard-comps")

    found = comps.withColumnRenamed("node", "rep").join(own.select("rep", "at", "size"), "rep").join(reps.select("rep", "copies"), "rep")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / join.block, F.sum("size") / join.block_shingles)).cast("int")
    work = found.join(found.groupBy("comp").agg(blocks.alias("total")), "comp").drop("size")
    texts = rows.select("at", "text").join(work.hint("shuffle_hash"), "at")
    units = _dealt(_blocked(texts, "total").select("comp", "i", "j", "side", "rep", "copies", "text"), "comp", "i", "j")
    verified = write_shared(units.mapInArrow(_verify(join), "rep long, root long, links long"), "jaccard-verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("others"))
    classes = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")), "jaccard-class")

    named = reps.join(links, "rep", "left").join(classes.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    named = write_shared(named.select("copy", "rep", "low", F.coalesce("comp", "rep").alias("comp"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-named")
    heads = named.groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("unknown"), "low", "rep")).alias("head"))
    named = named.join(heads, "comp").select("copy", F.col("head.low").alias("class_id"), F.col("head.rep").alias("keeper"), "n_links")
    joined = described.select("doc_id", "at", "row", F.when(F.col("size") > 0, F.col("copy")).alias("copy")).join(named, "copy", "left")
    return joined.select(
        "doc_id",
        "at",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("row") == F.col("keeper"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest doc_id; all columns stay, whatever their names."""
    docs = from_files(docs)
    gone = near_duplicates(docs, join).filter(~F.col("kept")).select("at")
    return placed(docs).join(gone.hint("shuffle_hash"), "at", "left_anti").select("doc.*")
