"""Byte-level BPE by merge ranks: counts, token lengths, and running counts of growing texts.

A rank file has a line for each token: its bytes in base 64 and its rank. A text is cut by a pattern into pieces that no token
crosses, and the merges of a piece go by rank, the leftmost of equals first. The pieces' tokens are kept, so a text costs little
more than its cutting.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property

import regex

# Fixed value: the pattern that goes with rank files of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN = 65_536  # pieces after which a worker begins anew to keep tokens; as many older ones stay until then
LONG = 64  # bytes of a piece that isn't kept
BACK = 4  # pieces before the end of a text that what follows may change: a run of white space, a contraction, a mark with line ends
# What trimming takes off.
TRIM = "\t\n\x0b\x0c\r \xa0                　﻿"


class Ranks:
    """A vocabulary; it travels to the tasks as its bytes."""

    def __init__(self, file: bytes, pattern: str = PATTERN) -> None:
        self.file, self.pattern = file, pattern
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @classmethod
    def read(cls, path: str, pattern: str = PATTERN) -> Ranks:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def __reduce__(self) -> tuple:
        return Ranks, (self.file, self.pattern)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in self.file.splitlines() if line)}

    @cached_property
    def cut(self):
        return regex.compile(self.pattern).findall

    def _merged(self, data: bytes) -> tuple[int, ...]:
        """The lengths of a piece's tokens; the pairs wait in a heap, so a long piece takes n log n."""
        ranks = self.ranks
        if data in ranks:
            return (len(data),)
        size = len(data)
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))  # of the token that begins at a place
        waiting = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(waiting)
        gone = bytearray(size)
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            j = end[i]
            if gone[i] or j >= size or end[j] != stop:
                continue  # one of the two was merged meanwhile
            end[i], gone[j] = stop, 1
            if stop < size:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(waiting, (r, i, end[stop]))
            k = before[i]
            if k >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heapq.heappush(waiting, (r, k, stop))
        out, i = [], 0
        while i < size:
            out.append(end[i] - i)
            i = end[i]
        return tuple(out)

    def lengths(self, piece: str) -> tuple[int, ...]:
        """Bytes of each token of a piece."""
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece)
            data = piece.encode(errors="replace")
            if found is None:
                found = self._merged(data)
            if len(data) <= LONG:
                if len(self.known) >= KNOWN:  # what is asked for again moves on
                    self.older, self.known = self.known, {}
                self.known[piece] = found
        return found

    def count(self, text: str | None) -> int:
        lengths = self.lengths
        return sum([len(lengths(p)) for p in self.cut(text)]) if text else 0

    def fits(self, text: str, most: int) -> bool:
        """Whether a text has at most ``most`` tokens; a token has a byte at least, so that short texts needn't be counted."""
        return len(text) <= most and len(text.encode(errors="replace")) <= most or self.count(text) <= most

    def windows(self, text: str, size: int, overlap: int) -> list[str]:
        """Windows of ``size`` tokens, each ``overlap`` tokens into the one before, trimmed, blank ones left out; a text that fits is its own window, as it is.

        A window that begins or ends inside a character has a replacement character there.
        """
        data, ends, at = text.encode(errors="replace"), [0], 0
        for piece in self.cut(text):
            for n in self.lengths(piece):
                at += n
                ends.append(at)
        n = len(ends) - 1
        if n <= size:
            return [text]
        out = []
        for start in range(0, n, size - overlap):
            part = data[ends[start] : ends[min(n, start + size)]].decode(errors="replace").strip(TRIM)
            if part:
                out.append(part)
            if start + size >= n:
                break
        return out


def embedded(line: str, body: str) -> str:
    """A heading line and a trimmed body; empty parts are left out."""
    body = body.strip(TRIM)
    return f"{line}\n{body}" if line and body else line or body


def fitted(ranks: Ranks, line: str, body: str, most: int, overlap: int) -> list[str]:
    """Windows of a body that keep the budget together with their heading line.

    Tokens don't add up where texts meet, so the room for the body begins with what the line leaves and is tightened until every
    window keeps to it.
    """
    for room in range(max(1, most - ranks.count(line)), 0, -1):
        parts = ranks.windows(body, room, min(overlap, max(0, room - 1)))
        if all(ranks.count(embedded(line, p)) <= most for p in parts):
            return parts
    raise ValueError("the headings leave no room under the budget")


class Joined:
    """The tokens of a text that grows at its end: only the pieces at the seam are counted again."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        self.line, self.body, self.base, self.tail = "", "", 0, ""
        self.seen: tuple[str, list[str], list[int]] = ("", [], [])  # what was counted last, as it is often what is added next

    def _cut(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a text and how many tokens each has."""
        if self.seen[0] != text:
            lengths, pieces = self.ranks.lengths, self.ranks.cut(text)
            self.seen = (text, pieces, [len(lengths(p)) for p in pieces])
        return self.seen[1:]

    def _took(self, text: str, base: int) -> None:
        pieces, counts = self._cut(text)
        kept = max(0, len(pieces) - BACK)
        self.base = base + sum(counts[:kept])
        self.tail = "".join(pieces[kept:])

    def begin(self, line: str, body: str) -> None:
        self.line, self.body = line, body
        lead = body.lstrip(TRIM)
        self._took(f"{line}\n{lead}" if line and lead else line or lead, 0)

    def count(self) -> int:
        """The count as the text is, under its heading line and trimmed."""
        if not self.body.strip(TRIM):
            return self.ranks.count(embedded(self.line, self.body))
        return self.base + self.ranks.count(self.tail.rstrip(TRIM))

    def count_with(self, line: str, sep: str, more: str) -> int:
        """The count with more text behind, under a heading line that may be another one."""
        if line != self.line or not self.body.strip(TRIM):
            return self.ranks.count(embedded(line, f"{self.body}{sep}{more}"))
        return self.base + sum(self._cut(f"{self.tail}{sep}{more}".rstrip(TRIM))[1])

    def add(self, line: str, sep: str, more: str) -> None:
        body = f"{self.body}{sep}{more}"
        if line != self.line or not self.body.strip(TRIM):
            self.begin(line, body)
            return
        self.body = body
        self._took(f"{self.tail}{sep}{more}", self.base)
