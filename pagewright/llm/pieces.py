"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Texts are cut into marked words (a word with the space marks before it), which
no piece of the vocabulary crosses. The distinct words of some texts are
sorted, so that walking them in order is a depth-first traversal of their
trie: the forward states of the prefix that a word shares with the one before
it are kept, and only those of its new characters are computed.

For unigram models a forward state is the best score of any segmentation of
the prefix, the earliest start winning ties. For BPE models, where a
segmentation's score depends on neighbours alone, transitions between pieces
score 0 if the merges, run on the two pieces, leave just these two, and minus
infinity otherwise; exactly one path survives, and it is the one the merges
would make of the whole word. Where a vocabulary's merges leave no path (it
has pieces that no merge reaches), the merges are run on the whole word.

The model file is read on the driver and sent to the tasks; it is never
trained. Texts are encoded where they lie, without a shuffle.

Defined cases: null and empty texts have no ids and decode to an empty text;
characters outside the vocabulary become their UTF-8 bytes' pieces (or the
unknown piece, where the model has no byte pieces); a text that holds U+2581
itself decodes to a space there, as the marks can't be told apart; special
pieces' names in a text are ordinary text; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Fixed values of the model file's format: field numbers, kinds of pieces, kinds of models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message; 32-bit fields as floats."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield tag >> 3, value


@dataclass
class Vocabulary:
    """A model file's pieces and settings."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    dummy_prefix: bool
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        pieces, scores, kinds, model, dummy, extra, charsmap = [], [], [], UNIGRAM, True, True, b""
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == PIECES:
                got = dict(_fields(value))
                pieces.append(got.get(1, b"").decode())
                scores.append(float(got.get(2, 0.0)))
                kinds.append(got.get(3, NORMAL))
            elif number == TRAINER:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == NORMALIZER:
                got = dict(_fields(value))
                charsmap, dummy, extra = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        if charsmap or extra or model not in (UNIGRAM, BPE) or USER in kinds:
            raise ValueError(f"{path}: only unigram and BPE models without text normalisation and user-defined pieces are supported")
        return cls.of(pieces, scores, kinds, model, dummy)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[int], model: int, dummy: bool = True) -> Vocabulary:
        v = cls(pieces, scores, kinds, model, dummy)
        v.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        v.byte_ids = [i for i, k in enumerate(kinds) if k == BYTE]
        v.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        if any(MARK in p.lstrip(MARK) for p in v.ids):
            raise ValueError("a piece crosses a space")
        return v


class Codec:
    """Encodes and decodes with one vocabulary; keeps the words it has met, up to ``most`` of them."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000) -> None:
        self.v = vocabulary
        self.most = most
        self.words: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        # lengths of the pieces that end with certain three characters, longest first; shorter pieces are always tried
        ends: dict[str, set[int]] = {}
        for p in vocabulary.ids:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {e: (*sorted(n, reverse=True), 2, 1) for e, n in ends.items()}
        joins = {c for p in vocabulary.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in joins)
        self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")).findall
        self.raw = [self._bytes(i) for i in range(len(vocabulary.pieces))]

    def _bytes(self, i: int) -> bytes:
        kind, piece = self.v.kinds[i], self.v.pieces[i]
        if kind == BYTE:
            return bytes([self.v.byte_ids.index(i)])
        return b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    # ---- BPE transitions

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scoring neighbours first, the leftmost of equals."""
        ids, scores = self.v.ids, self.v.scores
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges keep the two pieces (the second alone, if the first is -1); ids in, as they hash fast."""
        if len(self.fits) > 4 * self.most:
            self.fits.clear()
        second = self.v.pieces[right]
        both = [second] if left < 0 else [self.v.pieces[left], second]
        known = self.fits[left * len(self.v.pieces) + right] = self._merged("".join(both)) == both
        return known

    # ---- the traversal

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each word; ``words`` are sorted and distinct. A piece that isn't in the vocabulary is a single character."""
        ids, lengths, bpe = self.v.ids, self.lengths, self.v.model == BPE
        scores, fits = self.v.scores, self.fits
        low = min(scores, default=0.0) - 10.0  # the score of an unknown character
        size = len(self.v.pieces)
        state: list[tuple[float, int, int] | None] = [(0.0, 0, -1)]  # score, start and id of the last piece, -1 for none or an unknown character
        before = ""
        for word in words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del state[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best: tuple[float, int, int] | None = None
                for n in lengths.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    if n > end:
                        continue
                    start = end - n
                    k = ids.get(word[start:end])
                    if k is None:
                        continue
                    if bpe:
                        if state[start] is None:
                            continue
                        last = state[start][2]
                        fit = fits.get(last * size + k)
                        if fit is None:
                            fit = self._fit(last, k)
                        if fit:
                            best = (0.0, start, k)
                            break
                    else:
                        total = state[start][0] + scores[k]
                        if best is None or total > best[0]:
                            best = (total, start, k)
                if (best is None or not bpe) and word[end - 1] not in ids and state[end - 1] is not None:
                    total = state[end - 1][0] + low
                    if best is None or total > best[0]:
                        best = (total, end - 1, -1)
                state.append(best)
            before = word
            if state[-1] is None:
                yield word, self._merged(word)
                continue
            out, end = [], len(word)
            while end:
                start = state[end][1]
                out.append(word[start:end])
                end = start
            out.reverse()
            yield word, out

    def _packed(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            k = self.v.ids.get(p)
            if k is not None:
                ids.append(k)
            elif self.v.byte_ids:
                ids += [self.v.byte_ids[b] for b in p.encode()]
            else:
                ids.append(self.v.unknown)
        return array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        prefix = MARK if self.v.dummy_prefix else ""
        cut = [self.cut(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > self.most:
            self.words.clear()
        met = self.words
        new = sorted({w for words in cut for w in words if w not in met})
        for word, pieces in self.segment(new):
            met[word] = self._packed(pieces)
        out = [np.frombuffer(b"".join([met[w] for w in words]), np.int32) for words in cut]
        for w in [w for w in new if len(w) > 64]:
            del met[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids, in UTF-8."""
        text = b"".join([self.raw[i] for i in ids.tolist()])
        return text[1:] if self.v.dummy_prefix and text[:1] == b" " else text


_codecs: dict[int, Codec] = {}


def _codec(key: int, vocabulary: Vocabulary) -> Codec:
    """One codec per worker process, so that it knows words from earlier tasks."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _some(texts: list[bytes | None], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def round_trip(docs: DataFrame, path: str, chunk: int = 2_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids, the SHA-256 of the text decoded from them, and whether that is the text."""
    vocabulary = Vocabulary.read(path)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the model file
    key = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores), vocabulary.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _some(texts, chunk):
                part = [t or b"" for t in texts[i:j]]
                ids = codec.encode([t.decode() for t in part])
                sizes = np.array([len(x) for x in ids])
                back = [codec.decode(x) for x in ids]
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, np.concatenate(ids)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                        pa.array([x == y for x, y in zip(part, back, strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of rows with doc_id and ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(np.array(x or [], np.int32)).decode(errors="replace") for x in b.column(1).to_pylist()])], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
