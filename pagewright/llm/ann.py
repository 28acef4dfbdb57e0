"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to unit length and cut in two halves; each half is
quantised by its own centroids, so that K x K pairs of centroids are the cells
of the index. A query walks the pairs by their summed distance with a heap and
reads cells until these hold ``budget`` entries; what they hold is reranked by
the exact cosine, in double precision, on the original vectors.

K grows with the root of the number of entries, up to ``Config.most_centroids``
(beyond it, 256 million entries, cells grow instead, and nothing is left out).
The centroids are fitted on ``Config.per_centroid`` vectors a centroid,
``Config.least_sample`` at least; every vector is indexed. The budget isn't a
fixed number: ``Config.probes`` vectors are searched by brute force, in one
pass without a shuffle, and the budget is the number of entries after which
the walk has met ``Config.coverage`` of their true neighbours. On clustered
vectors it is small; on vectors without any structure it is a large share of
all, as it must be, and a search then costs queries times entries.

Equal vectors are one entry that carries its smallest ids (as many as a result
can show), so that a vector that a third of the rows share costs one
comparison. A query travels once per left centroid whose cells it reads, with
a bitmap of the right ones; entries and queries lie in packed blocks, which
are multiplied with each other as matrices. A left centroid with many entries
or queries is dealt out in parts of a bounded number of blocks.

Defined cases: vectors that are null, empty, zero, of another length than most,
or that hold null or non-finite components take no part, neither do rows
without an id; of rows that share an id the one with the smallest vector,
compared component by component, takes part; with fewer candidates than k all
are returned; equal scores go to the smaller id, however many vectors are
tied; components may be as large or small as a double can be; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.sampling import lowest
from pagewright.shared import batches_of, write_shared


@dataclass(frozen=True)
class Config:
    """Parameters of the index and the search."""

    k: int = 5
    most_centroids: int = 1024
    per_cell: int = 256
    per_centroid: int = 32
    least_sample: int = 4096
    rounds: int = 12
    probes: int = 256
    coverage: float = 0.96
    block: int = 1024
    blocks: int = 16
    query_block: int = 256
    query_blocks: int = 64
    seed: int = 7


def usable(rows: DataFrame) -> DataFrame:
    """``(id, v)`` with v an array of doubles that can be compared."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~bad & ~zero)


def least(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each task's share of a group before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centroids(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from random members of the sample."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


@dataclass
class Quantiser:
    """Centroids of the two halves."""

    left: np.ndarray
    right: np.ndarray

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a = _distances(unit[:, : self.half], self.left).argmin(axis=1)
        b = _distances(unit[:, self.half :], self.right).argmin(axis=1)
        return a * len(self.right) + b

    def walk(self, unit: np.ndarray) -> Iterator[int]:
        """Cells by summed distance of their centroids to the query: the multi-sequence walk."""
        a = _distances(unit[None, : self.half], self.left)[0]
        b = _distances(unit[None, self.half :], self.right)[0]
        order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = np.sort(a).tolist(), np.sort(b).tolist()
        heap, n = [(a[0] + b[0], 0, 0)], len(b)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield order_a[i] * n + order_b[j]
            if j + 1 < n:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if not j and i + 1 < len(a):  # the next left centroid comes in with its nearest right one
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def fit(entries: DataFrame, width: int, n: int, config: Config) -> Quantiser:
    """Centroids from the vectors whose hash is smallest."""
    k = int(min(config.most_centroids, max(4, round(np.sqrt(n / config.per_cell)))))
    rows = lowest(entries, max(config.least_sample, config.per_centroid * k), config.seed, "entry").select("v").toArrow()
    x = _unit(_matrix(rows.column(0).combine_chunks(), width))
    rng = np.random.default_rng(config.seed)
    half = width // 2
    return Quantiser(_centroids(x[:, :half], k, config.rounds, rng), _centroids(x[:, half:], k, config.rounds, rng))


def _parts(counts: np.ndarray, config: Config) -> np.ndarray:
    """Into how many parts the entries of each left centroid are dealt; ``counts`` has a row for each."""
    return np.maximum(1, -(-counts.sum(axis=1) // (config.block * config.blocks)))


def _assign(q: Quantiser, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q.cells(_unit(_matrix(b.column(2), width))), pa.int32())], ["entry", "ids", "v", "cell"])

    return run


def _budget(index: DataFrame, counts: np.ndarray, q: Quantiser, width: int, config: Config) -> int:
    """Entries after which the walk has met ``coverage`` of the true neighbours of the probes."""
    probes = lowest(index, config.probes, config.seed + 1, "entry").select("entry", "v").toArrow()
    if not probes.num_rows:
        return 0
    own = probes.column(0).to_numpy()
    x = _unit(_matrix(probes.column(1).combine_chunks(), width))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, cells = np.full((len(x), config.k), -2.0), np.full((len(x), config.k), -1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                s = x @ _unit(_matrix(part.column(1), width)).T
                s[own[:, None] == part.column(0).to_numpy()[None, :]] = -2.0
                s, c = np.concatenate([scores, s], axis=1), np.concatenate([cells, np.broadcast_to(part.column(2).to_numpy(), s.shape)], axis=1)
                top = np.argpartition(-s, config.k - 1, axis=1)[:, : config.k]
                scores, cells = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), config.k)), pa.array(scores.ravel()), pa.array(cells.ravel())], ["probe", "score", "cell"])

    found = index.select("entry", "v", "cell").mapInArrow(best, "probe long, score double, cell long").filter("cell >= 0")
    top = least(found, ["probe"], [F.desc("score"), "cell"], config.k).collect()  # k rows of each probe
    need = []
    for r in top:
        u = x[r["probe"]]
        away = _distances(u[None, : q.half], q.left)[0][:, None] + _distances(u[None, q.half :], q.right)[0][None, :]
        need.append(int(counts[away <= away.flat[r["cell"]]].sum()))
    need.sort()
    return need[min(len(need) - 1, int(np.ceil(config.coverage * len(need))) - 1)] if need else 0


def _numbers(a: pa.Array) -> bytes:
    return a.to_numpy().tobytes()


def _flat(a: pa.Array) -> bytes:
    return a.flatten().to_numpy(zero_copy_only=False).tobytes()


def _lengths(a: pa.Array) -> bytes:
    return a.value_lengths().to_numpy().tobytes()


def _bytes(a: pa.Array) -> bytes:
    return b"".join(a.to_pylist())


def _packed(keys: int, fields: list[tuple[str, int, Callable[[pa.Array], bytes]]], names: list[str], size: int):
    """Rows sorted by their first ``keys`` columns (integers) into blocks of at most ``size`` rows of one key; each field is the bytes of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, held = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()) for k in key] + [pa.array([b"".join(f(p.column(at)) for p in open_)], pa.binary()) for _, at, f in fields], names + [n for n, _, _ in fields])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in range(keys)])
            cuts = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [b.num_rows]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                while i < j:
                    now = tuple(k[:, i].tolist())
                    if open_ and (now != key or held == size):
                        yield out()
                        open_, held = [], 0
                    take = min(j - i, size - held)
                    key, held = now, held + take
                    open_.append(b.slice(i, take))
                    i += take
        if open_:
            yield out()

    return run


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each query, by falling score and then by id."""
    order = np.lexsort((ids, -scores, queries))
    q = queries[order]
    begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(q)]))))
    order = order[place < k]
    return queries[order], ids[order], scores[order]


def _near(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y): of each row of x every wanted row of y that may be among its k nearest, ties and rounding allowed for."""
    rough = _unit(x) @ _unit(y).T
    rough[~wanted] = -np.inf
    bound = np.maximum(np.partition(rough, len(y) - k, axis=1)[:, len(y) - k], -2.0) if len(y) > k else np.full(len(x), -2.0)
    return np.nonzero(rough >= bound[:, None] - 1e-11)


def _rerank(width: int, k: int, step: int = 1 << 15):
    """Exact cosines of blocks of queries and of entries; of each query the best k of a batch are sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for asked, qm, reads, right, em, flat, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                queries, right = np.frombuffer(asked, np.int64), np.frombuffer(right, np.int32)
                cells, at = np.unique(right, return_inverse=True)
                wanted = np.unpackbits(np.frombuffer(reads, np.uint8).reshape(len(queries), -1), axis=1)[:, cells].astype(bool)
                some = np.flatnonzero(wanted.any(axis=1))
                if not len(some):
                    continue
                queries, x, y = queries[some], np.frombuffer(qm).reshape(-1, width)[some], np.frombuffer(em).reshape(-1, width)
                lengths, flat = np.frombuffer(lengths, np.int32), np.frombuffer(flat, np.int64)
                starts = np.cumsum(lengths) - lengths
                left, hit = _near(x, y, wanted[some][:, at], k)
                for i in range(0, len(left), step):
                    l, h = left[i : i + step], hit[i : i + step]
                    n = lengths[h]
                    ids = flat[np.repeat(starts[h] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    new = np.repeat(queries[l], n), ids, np.repeat(cosines(x[l], y[h]), n)
                    kept = _best(*(np.concatenate(pair) for pair in zip(kept, new, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], ["query", "id", "score"])

    return run


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the powers of two that bring their largest components near one: nothing is rounded, squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, each row summed in the same order wherever it lies."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of one vector and the rows of a matrix."""
    return cosines(np.broadcast_to(x, y.shape), y)


def _one_each(rows: DataFrame) -> DataFrame:
    """One row per id: of those that share one, the one with the smallest vector."""
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    if again.isEmpty():
        return rows
    least_ = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return rows.join(again, "id", "left_anti").unionByName(least_)


def search(rows: DataFrame, is_query: Column, config: Config = Config()) -> DataFrame:
    """``rows`` has id and v; returns query_id, rank, vec_id, score for the rows for which ``is_query`` (on id) holds."""
    spark = rows.sparkSession
    good = usable(rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    widths = good.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths is None:
        return empty
    width, k = widths["w"], config.k + 1
    good = _one_each(good.filter(F.size("v") == width))
    # equal vectors: one entry with the k smallest ids; the row limit of a group acts in every task before the shuffle
    flagged = good.select("id", "v", F.xxhash64("v").alias("part"))
    entries = least(flagged, ["part", "v"], ["id"], k).groupBy("part", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = write_shared(entries.select(F.element_at("ids", 1).alias("entry"), "ids", "v"), "ann-entries")
    n = entries.count()
    q = fit(entries, width, n, config)
    index = write_shared(entries.mapInArrow(_assign(q, width), "entry long, ids array<long>, v array<double>, cell int"), "ann-index")
    lefts, rights = len(q.left), len(q.right)
    counts = np.zeros(lefts * rights, np.int64)
    held = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most most_centroids ** 2
    counts[held.column(0).to_numpy()] = held.column(1).to_numpy()
    counts = counts.reshape(lefts, rights)
    budget = max(_budget(index, counts, q, width, config), k)

    asked = write_shared(good.filter(is_query).select("v", "id"), "ann-asked")
    asking = write_shared(asked.groupBy("v").agg(F.min("id").alias("query")).select("query", "v"), "ann-asking")
    parts = _parts(counts, config)
    query_parts = max(1, -(-asking.count() // (config.query_block * config.query_blocks)))
    sent = spark.sparkContext.broadcast((counts.ravel(), parts))  # a number per cell

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, dealt = sent.value
        here = here.tolist()
        for b in batches:
            who, rows_, groups, reads = b.column(0).to_numpy(), [], [], []
            for i, u in enumerate(_unit(_matrix(b.column(1), width))) if b.num_rows else ():
                met, cells = 0, []
                for c in q.walk(u):
                    if here[c]:
                        cells.append(c)
                        met += here[c]
                    if met >= budget:
                        break
                at = np.array(cells, np.int64)
                bits = np.zeros((lefts, rights), np.uint8)
                bits.flat[at] = 1
                for g in np.unique(at // rights).tolist():
                    rows_.append(i), groups.append(g), reads.append(np.packbits(bits[g]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int32()), pa.array(who[rows_] % query_parts, pa.int32()), pa.array(dealt[groups], pa.int32()), b.column(0).take(pa.array(rows_, pa.int64())), b.column(1).take(pa.array(rows_, pa.int64())), pa.array(reads, pa.binary())],
                ["left", "qp", "parts", "query", "v", "reads"],
            )

    def own_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dealt = sent.value
        for b in batches:
            if b.num_rows:
                left = b.column(3).to_numpy() // rights
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(b.column(0).to_numpy() % dealt[left], pa.int32()), pa.array(b.column(3).to_numpy() % rights, pa.int32()), b.column(0), b.column(2), b.column(1)], ["left", "part", "cell", "entry", "v", "ids"])

    routed = asking.mapInArrow(routes, "left int, qp int, parts int, query long, v array<double>, reads binary")
    blocks_q = routed.repartition("left", "qp").sortWithinPartitions("left", "qp", "query")
    blocks_q = blocks_q.mapInArrow(_packed(3, [("asked", 3, _numbers), ("qm", 4, _flat), ("reads", 5, _bytes)], ["left", "qp", "parts"], config.query_block), "left int, qp int, parts int, asked binary, qm binary, reads binary")
    blocks_q = blocks_q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks_e = index.mapInArrow(own_part, "left int, part int, cell int, entry long, v array<double>, ids array<long>").repartition("left", "part").sortWithinPartitions("left", "part", "cell", "entry")
    blocks_e = blocks_e.mapInArrow(_packed(2, [("right", 2, _numbers), ("em", 4, _flat), ("flat", 5, _flat), ("lengths", 5, _lengths)], ["left", "part"], config.block), "left int, part int, right binary, em binary, flat binary, lengths binary")
    blocks_e = blocks_e.withColumn("qp", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    pairs = blocks_q.hint("merge").join(blocks_e, ["left", "part", "qp"]).select("asked", "qm", "reads", "right", "em", "flat", "lengths")
    with batches_of(spark, 64):  # a pair of blocks is a row of about a megabyte
        scored = write_shared(pairs.mapInArrow(_rerank(width, k), "query long, id long, score double"), "ann-scored")
    # the best of each distinct query vector; then each row's own id goes
    best = least(scored, ["query"], [F.desc("score"), "id"], k)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("top"))
    names = asked.join(asking, "v").select(F.col("id").alias("query_id"), "query")
    own = names.join(best, "query").select("query_id", F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, config.k).alias("top"))
    return own.select("query_id", F.posexplode("top").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.down")).alias("score"))
