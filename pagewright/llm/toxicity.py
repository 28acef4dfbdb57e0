"""A counterfactual-regularised toxicity classifier.

Features are the presence of words and of word beginnings; those that tell the
classes apart are chosen by a signed root of the likelihood ratio. In labelled
texts with identity terms each term is swapped for another of its group,
sentence by sentence; the logistic regression's loss has a penalty on the
change of the score's logit under the swap, so that a neutral mention of a
group doesn't raise the score.

The classifier is fitted on at most ``Fit.max_positive`` + ``Fit.max_negative``
labelled rows (those whose doc_id hashes lowest); everything else covers all
rows. Scoring is one pass without a shuffle.

Defined cases: null and empty texts are scored by the intercept; labels that
are null are ignored, and of several labels of one doc_id the highest counts;
without any labelled row every score is 0; rows with a null doc_id are scored
but never learned from; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.sampling import lowest
from pagewright.shared import write_shared

# Groups of identity terms; a term is swapped for the next one of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "citizens", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {a.encode(): group[(i + 1) % len(group)].encode() for group in IDENTITY for i, a in enumerate(group)}
BEGINNINGS = (4, 5)
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_SENTENCE = re.compile(rb"(?<=[.!?\n])")


@dataclass(frozen=True)
class Fit:
    """Parameters of the fit; the first two bound the sample."""

    max_positive: int = 4000
    max_negative: int = 12000
    max_features: int = 4096
    least_root: float = 4.5
    ridge: float = 0.5
    fairness: float = 20.0
    rounds: int = 400


@dataclass
class Model:
    """Weights of words and of word beginnings, and the intercept."""

    words: dict[bytes, float] = field(default_factory=dict)
    begins: dict[bytes, float] = field(default_factory=dict)
    bias: float = -math.inf

    def score(self, text: bytes | None) -> float:
        w, b = features(text)
        z = self.bias + math.fsum(self.words[x] for x in sorted(w & self.words.keys())) + math.fsum(self.begins[x] for x in sorted(b & self.begins.keys()))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def features(text: bytes | None) -> tuple[set[bytes], set[bytes]]:
    """Distinct words without ASCII punctuation, A-Z lowered, and their beginnings."""
    words = set((text or b"").lower().translate(_PUNCTUATION).split())
    return words, {w[:n] for n in BEGINNINGS for w in words if len(w) > n}


def swapped(text: bytes) -> bytes | None:
    """The text with each sentence's identity terms swapped; None if it has none."""
    out, changed = [], False
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.translate(_PUNCTUATION).split()
        if any(w in SWAP for w in words):
            changed = True
            out.append(b" ".join(SWAP.get(w, w) for w in words))
        else:
            out.append(sentence)
    return b" ".join(out) if changed else None


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, fit: Fit, learn: Column) -> DataFrame:
    """``(label, text)`` of the sample; ``learn`` says of a doc_id whether its label may be used."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = known.filter(learn)
    some = lowest(known.filter("label = 1"), fit.max_positive, 5, "doc_id").unionByName(lowest(known.filter("label = 0"), fit.max_negative, 5, "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return write_shared(texts.join(F.broadcast(some), "doc_id").select("label", "text"), "toxicity-sample")  # the sample is bounded by fit


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Presence counts per feature of a task's rows, sent on before they grow large."""
    seen: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.binary()), "pos": pa.array([seen[k][1] for k in keys], pa.int64()), "neg": pa.array([seen[k][0] for k in keys], pa.int64())})

    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w, begins = features(text)
            for f in [b"=" + x for x in w] + [b"^" + x for x in begins]:
                seen.setdefault(f, [0, 0])[label] += 1
        if len(seen) > 500_000:
            yield out()
            seen.clear()
    yield out()


def choose(rows: DataFrame, fit: Fit, n_pos: int, n_neg: int) -> list[bytes]:
    """The features that tell the classes apart best, at most ``fit.max_features``."""
    counts = rows.repartition(16).mapInArrow(_count, "feature binary, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = float(n_pos + n_neg)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    have = F.col("pos") + F.col("neg")
    g = part(F.col("pos"), have * n_pos / total) + part(F.col("neg"), have * n_neg / total)
    g = g + part(n_pos - F.col("pos"), (total - have) * n_pos / total) + part(n_neg - F.col("neg"), (total - have) * n_neg / total)
    scored = counts.filter(have >= 3).withColumn("root", F.sqrt(F.greatest(F.lit(0.0), 2 * g)))
    best = scored.filter(F.col("root") >= fit.least_root).orderBy(F.desc("root"), "feature").limit(fit.max_features).collect()
    return [bytes(r["feature"]) for r in best]


def _rows_of(chosen: dict[bytes, int]):
    """Per sampled row its chosen features, and those of its counterfactual."""

    def columns(text: bytes) -> list[int]:
        w, begins = features(text)
        return sorted(chosen[f] for f in [b"=" + x for x in w] + [b"^" + x for x in begins] if f in chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            other = [swapped(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"label": pa.array(labels, pa.int32()), "own": pa.array([columns(t) for t in texts], pa.list_(pa.int32())), "other": pa.array([None if o is None else columns(o) for o in other], pa.list_(pa.int32()))})

    return run


def _fitted(x: list[list[int]], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, fit: Fit) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with ridge and counterfactual penalty, by accelerated gradient steps scaled per feature."""
    row = np.repeat(np.arange(len(x)), [len(r) for r in x])
    col = np.array([c for r in x for c in r], dtype=np.int64)
    d_row, d_col, d_val = [], [], []
    for i, (a, b) in enumerate(pairs):
        for c, v in [(c, 1.0) for c in set(a) - set(b)] + [(c, -1.0) for c in set(b) - set(a)]:
            d_row.append(i), d_col.append(c), d_val.append(v)
    d_row, d_col, d_val = np.array(d_row, np.int64), np.array(d_col, np.int64), np.array(d_val)
    fair = fit.fairness * len(x) / max(1, len(pairs)) * 0.01
    w, v = np.zeros(n), np.zeros(n)
    rate = float((weight * y).sum() + 0.5) / float(weight.sum() + 1)
    bias = v_bias = math.log(rate / (1 - rate))
    most = max((len(r) for r in x), default=1) + 1
    most_swaps = np.bincount(d_row).max() if len(d_row) else 0
    scale = most * 0.25 * np.bincount(col, weights=weight[row], minlength=n) + fit.ridge + fair * most_swaps * np.bincount(d_col, minlength=n)
    bias_scale = most * 0.25 * weight.sum()
    for k in range(fit.rounds):
        p = 1 / (1 + np.exp(-(v_bias + np.bincount(row, weights=v[col], minlength=len(x)))))
        err = weight * (p - y)
        grad = np.bincount(col, weights=err[row], minlength=n) + fit.ridge * v
        if len(pairs):
            change = np.bincount(d_row, weights=v[d_col] * d_val, minlength=len(pairs))
            grad += fair * np.bincount(d_col, weights=change[d_row] * d_val, minlength=n)
        new, new_bias = v - grad / scale, v_bias - err.sum() / bias_scale
        m = k / (k + 3)
        v, v_bias = new + m * (new - w), new_bias + m * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit: Fit = Fit()) -> Model:
    """Fit on the labelled rows for which ``learn`` (a condition on doc_id) holds."""
    learn = F.lit(True) if learn is None else learn
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    whole = {r["label"]: r["n"] for r in known.filter(learn).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sample(docs, labels, fit, learn)
    some = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = some.get(1, 0), some.get(0, 0)
    if n_pos + n_neg == 0:
        return Model()
    chosen = choose(rows, fit, n_pos, n_neg)
    chosen += sorted({b"=" + t for t in SWAP} - set(chosen))
    at = {f: i for i, f in enumerate(chosen)}
    data = rows.mapInArrow(_rows_of(at), "label int, own array<int>, other array<int>").collect()  # bounded by fit
    data.sort(key=lambda r: (r["label"], r["own"]))
    y = np.array([r["label"] for r in data], dtype=float)
    share = {c: (whole.get(c, 0) / (whole.get(0, 0) + whole.get(1, 0))) / (some.get(c, 0) / len(data)) for c in some}
    weight = np.array([share[r["label"]] for r in data])
    pairs = [(r["own"], r["other"]) for r in data if r["other"] is not None]
    w, bias = _fitted([r["own"] for r in data], y, weight, pairs, len(chosen), fit)
    model = Model(bias=bias)
    for f, i in at.items():
        if abs(w[i]) > 1e-9:
            (model.words if f[:1] == b"=" else model.begins)[f[1:]] = float(w[i])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` has doc_id and text; adds nothing but the score: (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the model scores at the threshold or above; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
