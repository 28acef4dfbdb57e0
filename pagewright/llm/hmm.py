"""A hidden Markov language model.

Tokens are the words of a text (runs of characters other than
``[\\x20\\x09-\\x0D]``, A-Z lowered) and one end. A hidden state emits a token
class, and the class emits the token:

* the end and every token with at least ``Config.hot_share`` of all training
  tokens are classes of their own (so at most 1 / hot_share of them);
* all others fall into ``Config.rare_classes`` classes by how they begin and
  end, and within its class a token of count c has probability
  (c + 0.1) / (C + 0.1 (V + 1)), all unseen tokens together taking one share.

Baum-Welch: every partition runs the scaled forward-backward recursion over
its training texts and sends on expected counts by state and class; their sums
give the next parameters. Everything is learned from all training rows:

* the starting point: each row falls into a group by the signs of a few random
  projections of its class frequencies, and the groups' class counts, summed
  over all rows, are the states' first emissions;
* one incremental pass: ``Config.shares`` rounds, each over another share of
  the rows (by a hash), that together see every row once;
* whole rounds over all rows until a round's gain in likelihood falls below
  ``Config.gain`` (log10 a token), at most ``Config.rounds``.

The scaled forward recursion then gives the exact likelihood of each class
sequence, and the counts of rare tokens come in by a join. Sums over
partitions are made in whole units, so that they don't depend on their order.

Defined cases: null and empty texts are the end alone; a null doc_id hashes as
an empty text; repeated rows are scored one by one; without training rows all
tokens are unseen; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.shared import write_shared

END = b""
SMOOTH = 0.1


@dataclass(frozen=True)
class Config:
    """Parameters of the model."""

    states: int = 8
    shares: int = 6
    rounds: int = 20
    gain: float = 0.003
    hot_share: float = 4e-6
    rare_classes: int = 4096
    smooth_classes: float = 0.05
    stay: float = 0.9
    cells: int = 400_000
    fixed_point: int = 10**10
    count_units: int = 10**6
    seed: int = 1


@dataclass
class Lexicon:
    """Token statistics; hot maps token to (class, count), at most 1 / hot_share entries."""

    total: int
    distinct: int
    hot: dict[bytes, tuple[int, int]]
    rare_total: np.ndarray
    rare_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.hot) + len(self.rare_total)


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (classes, K)
    history: tuple[float, ...] = ()  # mean log10 likelihood of a class at the beginning of each round


def tokens(text: bytes | None) -> list[bytes]:
    """The words; bytes.split() and bytes.lower() know exactly the ASCII white space and letters."""
    return (text or b"").lower().split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


# ---- counts ------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            seen.update(tokens(text))
            seen[END] += 1
        if len(seen) > 300_000:
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
    yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})


def token_counts(texts: DataFrame) -> DataFrame:
    """``(token, c)`` over all rows of ``texts`` (one binary column); the end is the empty token."""
    counts = texts.mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
    return write_shared(counts, "hmm-counts")


def rare_class(token: Column, n: int) -> Column:
    """Class of a rare token by its first and last bytes; _rare_class is the same on Python's side."""
    return (F.crc32(F.concat(F.substring(token, 1, 2), F.lit(b"-"), F.substring(token, -3, 3))) % n).cast("int")


def _ends(token: bytes) -> bytes:
    return token[:2] + b"-" + token[-3:]


def _rare_class(token: bytes, n: int) -> int:
    return crc32(_ends(token)) % n


def lexicon(counts: DataFrame, config: Config) -> Lexicon:
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = whole["n"] or 0, whole["v"]
    is_hot = (F.col("c") >= config.hot_share * total) | (F.length("token") == 0)
    top = sorted(((r["c"], bytes(r["token"])) for r in counts.filter(is_hot).collect()), key=lambda x: (-x[0], x[1]))  # at most 1 / hot_share rows
    hot = {t: (i, c) for i, (c, t) in enumerate(top)}
    hot.setdefault(END, (len(hot), 0))
    rare_total, rare_distinct = np.zeros(config.rare_classes, np.int64), np.zeros(config.rare_classes, np.int64)
    for r in counts.filter(~is_hot).groupBy(rare_class(F.col("token"), config.rare_classes).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        rare_total[r["k"]], rare_distinct[r["k"]] = r["n"], r["v"]
    return Lexicon(total, distinct, hot, rare_total, rare_distinct)


# ---- sequences of classes ------------------------------------------------------------------


def _encode(lex: Lexicon, config: Config):
    kind = np.uint16 if lex.classes <= 1 << 16 else np.uint32
    hot = {t: k for t, (k, _) in lex.hot.items()}
    logs = np.zeros(lex.classes)  # none for rare classes: their tokens' shares come in by a join
    for k, c in lex.hot.values():
        logs[k] = log10(c + SMOOTH)
    first, n = len(hot), config.rare_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            size, known, hot_log, seq, rare = [], [], [], [], []
            for text in b.column(2).to_pylist():
                words = tokens(text)
                words.append(END)
                classes = list(map(hot.get, words))
                others = [(i, words[i]) for i, k in enumerate(classes) if k is None] if None in classes else []
                for i, w in others:
                    ends = _ends(w)
                    k = cache.get(ends)
                    if k is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        k = cache[ends] = first + crc32(ends) % n
                    classes[i] = k
                found = np.array(classes, kind)
                size.append(len(words))
                known.append(len(words) - len(others))
                hot_log.append(float(logs[found].sum()))
                seq.append(found.tobytes())
                rare.append(b" ".join([w for _, w in others]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(hot_log, pa.float64()), pa.array(seq, pa.binary()), pa.array(rare, pa.binary())],
                ["doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "seq", "rare"],
            )

    return run, kind


def encode(docs: DataFrame, lex: Lexicon, config: Config) -> tuple[DataFrame, type]:
    """Every row with its class sequence and its rare tokens, under a row number that stays."""
    run, kind = _encode(lex, config)
    made = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, seq binary, rare binary")
    return write_shared(made.withColumn("row", F.monotonically_increasing_id()), "hmm-rows"), kind


# ---- forward, backward -----------------------------------------------------------------------


def _padded(seqs: list[np.ndarray], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, lengths, time-major class matrix) of sequences put together by length, at most ``cells`` cells or one sequence."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    i = 0
    while i < len(order):
        longest = len(seqs[order[i]])
        take = order[i : i + max(1, cells // max(1, longest))]
        lengths = np.array([len(seqs[k]) for k in take])
        grid = np.zeros((longest, len(take)), np.int64)
        for col, k in enumerate(take):
            grid[: lengths[col], col] = seqs[k]
        yield np.array(take), lengths, grid
        i += len(take)


def _active(lengths: np.ndarray, longest: int) -> np.ndarray:
    """How many of the sequences (longest first) have a token at each time."""
    return np.searchsorted(-lengths, -np.arange(longest), side="left")


def log_likelihood(seqs: list[np.ndarray], model: Model, cells: int = 400_000) -> np.ndarray:
    """Natural logarithm of each sequence's probability, by the scaled forward recursion."""
    out, ones = np.zeros(len(seqs)), np.ones(len(model.start))
    for take, lengths, grid in _padded(seqs, cells):
        n = _active(lengths, len(grid))
        logs = np.zeros(len(take))
        for t in range(len(grid)):
            e = model.emit.take(grid[t, : n[t]], axis=0)
            a = e * model.start if not t else (a[: n[t]] @ model.move) * e
            s = a @ ones
            a *= (1 / s)[:, None]
            logs[: n[t]] += np.log(s)
        out[take] = logs
    return out


@dataclass
class Expected:
    """Expected counts."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @classmethod
    def none(cls, states: int, classes: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))


def _steps(grid: np.ndarray, n: np.ndarray, model: Model, first: int, last: int, before: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scaled forward values, their scales and the emissions over the scales at the times first..last-1; ``before`` are the values at the time before."""
    a, ones = before, np.ones(len(model.start))
    for t in range(first, last):
        e = model.emit.take(grid[t, : n[t]], axis=0)
        a = (model.start if a is None else a[: n[t]] @ model.move) * e
        s = a @ ones
        r = (1 / s)[:, None]
        a *= r
        e *= r
        yield a, s, e


def expect(seqs: list[np.ndarray], model: Model, into: Expected, cells: int) -> None:
    """Add the sequences' expected counts under the model.

    Forward values are kept for about ``cells`` tokens; of longer sequences they are kept where a stretch begins
    and made again stretch by stretch on the way back.
    """
    states, back = len(model.start), np.ascontiguousarray(model.move.T)
    for _, lengths, grid in _padded(seqs, cells):
        n = _active(lengths, len(grid))
        size = max(1, cells // grid.shape[1])
        marks: list[np.ndarray | None] = [None]
        if len(grid) > size:
            for t, (a, _, _) in enumerate(_steps(grid, n, model, 0, len(grid), None), 1):
                if t % size == 0 and t < len(grid):
                    marks.append(a)
        next_beta = next_emit = None
        for k in range(len(marks) - 1, -1, -1):
            first, last = k * size, min(len(grid), (k + 1) * size)
            steps = list(_steps(grid, n, model, first, last, marks[k]))
            gammas = []
            into.log_likelihood += np.log(np.concatenate([s for _, s, _ in steps])).sum()
            for t in range(last - 1, first - 1, -1):
                alpha, _, emit = steps[t - first]
                if next_beta is None:
                    beta = np.ones((n[t], states))
                else:
                    ahead = next_beta * next_emit
                    into.move += alpha[: n[t + 1]].T @ ahead
                    beta = ahead @ back
                    if n[t] > n[t + 1]:
                        beta = np.concatenate([beta, np.ones((n[t] - n[t + 1], states))])
                next_beta, next_emit = beta, emit
                gammas.append(alpha * beta)
            gammas.reverse()
            if first == 0:
                into.start += gammas[0].sum(axis=0)
            at = np.concatenate([grid[t, : n[t]] for t in range(first, last)])
            gamma = np.concatenate(gammas)
            for j in range(states):
                into.emit[:, j] += np.bincount(at, weights=gamma[:, j], minlength=len(into.emit))


def maximised(got: Expected, old: Model, config: Config, prior: np.ndarray) -> Model:
    """Parameters from expected counts (move without the factor of the old matrix); classes are smoothed towards ``prior``."""
    start = got.start + 1.0
    move = got.move * old.move + 1.0
    emit = got.emit + config.smooth_classes * len(prior) * prior[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _summed(rows: DataFrame, count, states: int) -> dict[int, np.ndarray]:
    """Sums of the vectors that ``count`` (from batches of rows) sends on, in whole units, by their number."""
    names = [f"g{k}" for k in range(states)]
    sums = rows.mapInArrow(count, "at long, " + ", ".join(f"{x} long" for x in names)).groupBy("at").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    values = np.stack([sums.column(x).to_numpy() for x in names], axis=1) if sums.num_rows else np.zeros((0, states), np.int64)
    return dict(zip(sums.column("at").to_pylist(), values, strict=True))


def _sent(rows: np.ndarray, units: int) -> pa.RecordBatch:
    """The rows that aren't zero, in whole units, with their numbers."""
    whole = np.rint(rows * units).astype(np.int64)
    at = np.flatnonzero(whole.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(whole[at, k]) for k in range(rows.shape[1]))], ["at", *(f"g{k}" for k in range(rows.shape[1]))])


def started(learn: DataFrame, kind: type, classes: int, config: Config, prior: np.ndarray) -> Model:
    """A starting point from all rows: groups by signs of random projections of class frequencies, which tell languages and subjects apart."""
    k = config.states
    bits = max(1, int(np.ceil(np.log2(k))))
    rng = np.random.default_rng(config.seed)
    directions = rng.choice([-1.0, 1.0], (classes, bits)) / np.sqrt(prior)[:, None] ** 0.5
    sent = learn.sparkSession.sparkContext.broadcast((directions, prior @ directions))  # classes x bits numbers

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toward, middle = sent.value
        seen = np.zeros((classes, k))
        for b in batches:
            for raw in b.column(0).to_pylist():
                s = np.frombuffer(raw, kind)
                side = toward[s].sum(axis=0) > middle * len(s)
                np.add.at(seen, (s, int(side @ (1 << np.arange(bits))) % k), 1)
        yield _sent(seen, 1)

    emit = np.repeat(prior[:, None], k, axis=1)
    counts = np.zeros((classes, k))
    for at, row in _summed(learn.select("seq"), grouped, k).items():
        counts[at] = row
    sent.unpersist()
    total = counts.sum(axis=0)
    emit = np.where(total > 0, 0.5 * emit + 0.5 * counts / np.maximum(total, 1), emit)
    emit *= 1 + 0.01 * rng.random(emit.shape)
    move = np.full((k, k), (1 - config.stay) / max(1, k - 1))
    np.fill_diagonal(move, config.stay if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), move, emit / emit.sum(axis=0))


def baum_welch(learn: DataFrame, kind: type, model: Model, config: Config, prior: np.ndarray) -> tuple[Model, float]:
    """One round over the rows: the next model and the mean log10 likelihood of a class under the old one."""
    states, classes = len(model.start), len(prior)
    sent = learn.sparkSession.sparkContext.broadcast(model)  # classes x states numbers, bounded by hot_share

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Expected.none(states, classes)
        for b in batches:
            expect([np.frombuffer(s, kind) for s in b.column(0).to_pylist()], sent.value, got, config.cells)
        logs = np.zeros((1, states))
        logs[0, 0] = got.log_likelihood / np.log(10)
        yield _sent(np.concatenate([logs, got.start[None], got.move, got.emit]), config.count_units)

    whole = np.zeros((2 + states + classes, states))
    for at, row in _summed(learn.select("seq"), counted, states).items():
        whole[at] = row / config.count_units
    sent.unpersist()
    got = Expected(whole[1], whole[2 : 2 + states], whole[2 + states :])
    return maximised(got, model, config, prior), whole[0, 0] / max(1.0, got.emit.sum())


def train(rows: DataFrame, kind: type, lex: Lexicon, config: Config) -> Model:
    """Baum-Welch over all rows that aren't held out."""
    learn = rows.filter(~F.col("held_out"))
    seen = np.zeros(lex.classes)
    for k, c in lex.hot.values():
        seen[k] = c
    seen[len(lex.hot) :] = lex.rare_total
    prior = (seen + 0.5) / (seen + 0.5).sum()
    model, history = started(learn, kind, lex.classes, config, prior), []
    for share in range(config.shares):
        model, mean = baum_welch(learn.filter(F.pmod(F.xxhash64(F.lit(config.seed), "row"), F.lit(config.shares)) == share), kind, model, config, prior)
        history.append(mean)
    for _ in range(config.rounds):
        model, mean = baum_welch(learn, kind, model, config, prior)
        settled = len(history) > config.shares and mean - history[-1] < config.gain
        history.append(mean)
        if settled:
            break
    model.history = tuple(history)
    return model


# ---- scores ----------------------------------------------------------------------------------


def score(rows: DataFrame, kind: type, counts: DataFrame, lex: Lexicon, model: Model, config: Config) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = rows.sparkSession
    unit = config.fixed_point
    # log10(c + 0.1) of rare tokens, in whole units, so that sums don't depend on their order
    rare = rows.filter(F.octet_length("rare") > 0).select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("token"))
    small = counts.filter((F.col("c") < config.hot_share * lex.total) & (F.length("token") > 0))
    small = small.select(F.col("token").cast("string").alias("token"), F.round(F.log10(F.col("c") + SMOOTH) * unit).cast("long").alias("units"))
    unseen = int(round(log10(SMOOTH) * unit))
    met = rare.join(small.hint("shuffle_hash"), "token", "left")
    sums = met.groupBy("row").agg(F.sum(F.coalesce("units", F.lit(unseen))).alias("units"), F.count("units").alias("n_known"))

    sent = spark.sparkContext.broadcast(model)
    shares = np.log10(lex.rare_total + SMOOTH * (lex.rare_distinct + 1))
    first = len(lex.hot)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(s, kind) for s in b.column(b.schema.get_field_index("seq")).to_pylist()]
            logs = log_likelihood(seqs, sent.value, config.cells) / np.log(10)
            within = np.array([shares[s[s >= first].astype(np.int64) - first].sum() for s in seqs])
            kept = [b.column(b.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out", "n_tokens", "n_hot", "hot_log")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(logs), pa.array(within)], ["row", "doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "sequence", "within"])

    done = rows.select("row", "doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "seq").mapInArrow(
        forward, "row long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, sequence double, within double"
    )
    denominator = log10(lex.total + SMOOTH * (lex.distinct + 1))
    seen_end = 1 if lex.hot[END][1] else 0
    own = F.coalesce(F.col("units"), F.lit(0)) / float(unit)
    return done.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") - (1 - seen_end) + F.coalesce("n_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("hot_log") + own - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("sequence") + own - F.col("within")).alias("score"),
    )


def language_model_scores(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out and score all of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = token_counts(rows.filter(~F.col("held_out")).select("text"))
    lex = lexicon(counts, config)
    encoded, kind = encode(rows, lex, config)
    model = train(encoded, kind, lex, config)
    return score(encoded, kind, counts, lex, model, config)
