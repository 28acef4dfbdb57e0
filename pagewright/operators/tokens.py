"""Budgets under a real tokenizer: the chunk builder's counting, cutting and packing by byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.bpe import PATTERN, Joined, Ranks, embedded, fitted
from pagewright.operators.builder import Tokenizer

PARTS = "array<struct<body:string,cut:boolean>>"
PACKS = "array<struct<at:int,tokens:bigint>>"
_met: dict[tuple[int, int, str], Ranks] = {}


def _kept(ranks: Ranks) -> Ranks:
    """One vocabulary per worker process, so that pieces are known from earlier tasks."""
    key = (len(ranks.file), hash(ranks.file), ranks.pattern)
    if key not in _met:
        _met.clear()
        _met[key] = ranks
    return _met[key]


class RankTokenizer(Tokenizer):
    """Tokens by a rank file (read on the driver, sent to the tasks once). Its counts don't add up over joined texts."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.ranks = Ranks.read(path, pattern)

    def _sent(self):
        from pyspark.sql import SparkSession

        return SparkSession.active().sparkContext.broadcast(self.ranks)  # as large as the file

    def count(self, text: Column) -> Column:
        sent = self._sent()

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ranks = _kept(sent.value)
            for texts in parts:
                yield texts.map(ranks.count, na_action="ignore").astype("Int64")

        return F.pandas_udf(run, "long")(text)

    def parts(self, line: Column, own: Column, body: Column, header: Column, most: int, overlap: Column, force: Column) -> Column:
        sent = self._sent()

        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            ranks = _kept(sent.value)
            for rows in parts:
                out = []
                for line_, own_, body_, header_, lap, must in zip(*rows, strict=True):
                    single = f"{header_}\n{body_}" if header_ else body_
                    if not must and ranks.fits(embedded(line_, single), most):
                        out.append([{"body": body_, "cut": False}])
                    else:
                        out.append([{"body": p, "cut": True} for p in fitted(ranks, own_, single, most, lap)] if single.strip() else [])
                yield pd.Series(out)

        return F.pandas_udf(run, PARTS)(line, own, body, header, overlap, force)

    def counted(self, tokens: Column, text: Column) -> Column:
        return tokens

    def packs(self, items: Column, unit: Callable[[Column], Column], most: int) -> Column:
        """As for words; what a pack's embedding text has of tokens is known from packing."""
        sent = self._sent()

        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            ranks = _kept(sent.value)
            for docs in parts:
                yield pd.Series([_packs(ranks, zip(*doc, strict=True), most) for doc in zip(*docs, strict=True)])

        # whether an item begins a unit, and what is counted of it
        begins = F.transform(items, lambda e, i: ~unit(e).eqNullSafe(unit(F.get(items, i - 1))) | (i == 0))
        return F.pandas_udf(run, PACKS)(begins, *[F.transform(items, _field(c)) for c in ("line", "header", "body", "alone")])


def _field(name: str) -> Callable[[Column], Column]:
    return lambda e: e[name]


def _packs(ranks: Ranks, items: Iterator[tuple], most: int) -> list[dict]:
    """Where the packs of a document's items begin, and the tokens of each under its first item's heading line."""
    joined, out, first, lonely = Joined(ranks), [], "", True

    def close() -> None:
        if out:
            out[-1]["tokens"] = joined.count() if joined.line == first else ranks.count(embedded(first, joined.body))

    for i, (begins, line, header, body, alone) in enumerate(items):
        sep = "\n\n" if header is None else "\n"
        if lonely or alone or begins or joined.count_with(line, sep, body) > most:
            close()
            out.append({"at": i})
            joined.begin(line, f"{header}\n{body}" if header else body)
            first = line
        else:
            joined.add(line, sep, body)
        lonely = alone
    close()
    return out
