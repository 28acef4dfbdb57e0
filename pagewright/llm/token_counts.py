"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens as the tokenizer's file says (special strings,
normalisation, a pattern). The distinct pre-tokens of words that a task hasn't
met yet are held as ragged numpy arrays: one array of symbols, one of the ranks of
neighbouring symbols, and each sequence's length. In a round every sequence
finds its lowest rank by a segmented minimum, and all its pairs of that rank
are merged at once, in all sequences together; a sequence whose pairs have no
rank leaves, and the symbols that it is left with are its tokens. Only ranks
next to a merge are looked up again. A text's count is the sum over its words,
a word's the sum over its pre-tokens.

Merging all pairs of one rank at once is what one merge after the other gives,
if a symbol is made by one pair only and by a later merge than its parts: then
no merge makes a pair of a lower rank. Vocabularies for which that isn't so
merge the leftmost pair alone in a round.

The tokenizer's file is read on the driver and sent to the tasks (its size is
the vocabulary's); it is never trained. Texts are counted where they lie,
without a shuffle; a task holds the words of some megabytes of text and at
most ``KNOWN`` words it has met before.

Files: BPE models of the tokenizers library's JSON form with byte-level
symbols, any split pattern out of classes, literals and repeats, and the
normalisations NFC, lower case and white space to spaces. Character classes
are those of Unicode 16, as in that library.

Defined cases: a null text counts as empty and has no tokens; special strings
inside a text are one token each; bytes that aren't UTF-8 count as U+FFFD;
rows with null or repeated ids are counted each for itself; an empty table
gives an empty result; extra columns are ignored, whatever their names. The
time is in proportion to the text, but for one pre-token of very many letters,
which takes up to as many rounds as it uses merges.
"""

from __future__ import annotations

import json
import re
import re._constants as sre
import re._parser as parser
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOWN = 1_000_000  # words whose counts a worker keeps
LONG = 64  # characters of a word that is counted, but not kept
CHUNK = 4_000_000  # bytes of text whose words are merged together
NONE = np.int32(np.iinfo(np.int32).max)  # no rank

# What Unicode 16 adds to the letters and numbers of version 15.1, as ranges.
NEW_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389"
    "\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d"
    "\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NEW_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
# Lower case that Unicode added after version 15.1.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Combining marks that are newer than the library's tables for NFC, which takes them for ordinary characters.
NEW_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac"
    "\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930-\U00011943\U000119e0\U00011a34\U00011a47"
    "\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae"
    "\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"  # which Python takes for white space, and the library doesn't
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pattern that byte-level files mean when they name none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_classes: dict[str, str] = {}


def _class(kind: str) -> str:
    """The inside of a character class for letters (L), numbers (N) or white space (s)."""
    if not _classes:
        ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
        for c in range(sys.maxunicode + 1):
            own = ranges.get(unicodedata.category(chr(c))[0])
            if own is not None:
                if own and own[-1][1] == c - 1:
                    own[-1][1] = c
                else:
                    own.append([c, c])
        for k, more in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
            _classes[k] = "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in ranges[k]) + more
        _classes["s"] = SPACES
    return _classes[kind]


ASCII = {"L": "A-Za-z", "N": "0-9", "s": "\t-\r "}


def translated(pattern: str, spelled: Callable[[str], str] = _class) -> str:
    """A pattern with ``\\p{L}``, ``\\p{N}`` and ``\\s`` spelled out for Python's own regexes."""
    out, inside = [], False
    for m in re.finditer(r"\\p\{(\w+)\}|\\([sS])|\\.|\[\^?|\]|.", pattern, re.S):
        kind = m[1] or m[2]
        if kind == "S":
            out.append(f"[^{spelled('s')}]")
        elif kind:
            out.append(spelled(kind) if inside else f"[{spelled(kind)}]")
        else:
            inside = m[0][0] == "[" or inside and m[0] != "]"
            out.append(m[0])
    return "".join(out)


def _may_match(parsed: list, char: int) -> bool:
    """Whether some part of a parsed pattern may match a character; what looks around or isn't known may."""
    for op, arg in parsed:
        if op is sre.LITERAL:
            hit = arg == char
        elif op is sre.NOT_LITERAL:
            hit = arg != char
        elif op is sre.IN:
            inside = any(o is sre.CATEGORY or o is sre.LITERAL and x == char or o is sre.RANGE and x[0] <= char <= x[1] for o, x in arg if o is not sre.NEGATE)
            hit = inside != (arg[0][0] is sre.NEGATE)
        elif op is sre.BRANCH:
            hit = any(_may_match(list(x), char) for x in arg[1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            hit = _may_match(list(arg[2]), char)
        elif op is sre.SUBPATTERN:
            hit = _may_match(list(arg[3]), char)
        else:
            hit = True
        if hit:
            return True
    return False


@dataclass
class Tokenizer:
    """What a tokenizer's file says, as arrays and patterns."""

    size: int
    first: np.ndarray  # symbol of each byte
    last: np.ndarray  # symbol of each byte at the end of a pre-token
    keys: np.ndarray  # left * size + right of each merge, ascending
    ranks: np.ndarray
    made: np.ndarray
    at_once: bool  # all pairs of a rank may be merged together
    pattern: str
    specials: tuple[str, ...]
    nfc: bool
    lower: bool

    @classmethod
    def read(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, vocab = said["model"], said["model"]["vocab"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: only plain byte-level BPE models are supported")
        kinds = said["normalizer"] or {"type": "Sequence", "normalizers": []}
        steps = {(n["type"], n.get("content")) for n in kinds.get("normalizers", [kinds])}
        before = said["pre_tokenizer"]
        before = {x["type"]: x for x in before.get("pretokenizers", [before])}
        split = before.get("Split")
        if steps - {("NFC", None), ("Lowercase", None), ("Replace", " ")} or set(before) - {"Split", "ByteLevel"} or "ByteLevel" not in before or before["ByteLevel"]["add_prefix_space"]:
            raise ValueError(f"{path}: only NFC, lower case, white space to spaces, a split and byte-level symbols are supported")
        if split and not (split["behavior"] == "Removed" and split["invert"] and not before["ByteLevel"]["use_regex"]) or not split and not before["ByteLevel"]["use_regex"]:
            raise ValueError(f"{path}: the split must keep what its pattern matches")
        added = said["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError(f"{path}: only special strings that are taken as they stand are supported")
        suffix = model.get("end_of_word_suffix") or ""
        # printable bytes stand for themselves, the others for the characters from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        shown, extra = [], 256
        for b in range(256):
            shown.append(chr(b if b in plain else extra))
            extra += b not in plain
        size = max(vocab.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True))
        since = np.full(size, -1)  # the merge that makes a symbol
        since[made] = np.arange(len(merges))
        single = {vocab[c + end] for c in shown for end in ("", suffix)}
        at_once = len(set(made.tolist())) == len(merges) and not single & set(made.tolist()) and bool((np.maximum(since[left], since[right]) < np.arange(len(merges))).all())
        keys = left * size + right
        order = np.argsort(keys)
        return cls(
            size, np.array([vocab[c] for c in shown], np.int32), np.array([vocab[c + suffix] for c in shown], np.int32),
            keys[order], order.astype(np.int32), made[order].astype(np.int32), at_once,
            split["pattern"]["Regex"] if split else BYTE_LEVEL, tuple(a["content"] for a in added),
            ("NFC", None) in steps, ("Lowercase", None) in steps,
        )


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100; stops at the first that isn't."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Counter:
    """Counts tokens with one tokenizer; keeps the counts of words it has met."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.t = tokenizer
        self.known: dict[str, int] = {}
        parsed = list(parser.parse(translated(tokenizer.pattern)))
        # where no pre-token holds white space, what stands between white space has a count of its own
        self.apart = not any(_may_match(parsed, ord(c)) for c in SPACE)
        self.cut = re.compile(translated(tokenizer.pattern)).findall
        self.cut_ascii = re.compile(translated(tokenizer.pattern, ASCII.__getitem__)).findall  # the same for texts of ASCII alone
        self.special = re.compile("|".join(re.escape(s) for s in sorted(tokenizer.specials, key=len, reverse=True)) or r"(?!)").split
        self.marks = re.compile(f"([{NEW_MARKS}])")
        self.lower = re.compile(f"[{''.join(map(chr, NEW_LOWER))}]").search

    # ---- from texts to pre-tokens

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.t.lower else text
        new = not _latin(text)  # may have characters that are newer than some table
        if self.t.nfc:
            text = "".join([unicodedata.normalize("NFC", p) for p in self.marks.split(text)]) if new else unicodedata.normalize("NFC", text)
        if self.t.lower:
            if new and self.lower(text):
                text = text.translate(NEW_LOWER)
            text = text.replace("Σ", "σ").lower()  # each character by itself, without a form for ends of words
        return text

    def words(self, text: str) -> tuple[list[str], int]:
        """The words of a text, whose counts add up, and the number of special strings in it: what stands between white space, or else its pre-tokens."""
        parts = self.special(text)
        if self.apart and not any(c in text for c in SEPARATORS):
            return [w for p in parts for w in self._normal(p).split()], len(parts) - 1
        return [w for p in parts for w in self.pre_tokens(self._normal(p))], len(parts) - 1

    def pre_tokens(self, text: str) -> list[str]:
        return (self.cut_ascii if text.isascii() else self.cut)(text)

    # ---- merging

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place of the merge of each pair; ``NONE`` where there is none."""
        key = left.astype(np.int64) * self.t.size + right
        at = np.minimum(np.searchsorted(self.t.keys, key), max(0, len(self.t.keys) - 1))
        return np.where(self.t.keys[at] == key, self.t.ranks[at], NONE), at

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each sequence of bytes is left with; none is empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = sizes.copy()
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.t.first[data]
        symbols[ends] = self.t.last[data[ends]]
        stop = np.zeros(len(data), bool)
        stop[ends] = True
        rank = np.full(len(data), NONE, np.int32)
        inner = np.flatnonzero(~stop)
        rank[inner] = self._ranks(symbols[inner], symbols[inner + 1])[0]
        own = np.arange(len(words))
        result = np.empty(len(self.t.keys), np.int32)  # by rank
        result[self.t.ranks] = self.t.made
        while len(own):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            low = np.minimum.reduceat(rank, starts)
            open_ = low != NONE
            if not open_.all():  # sequences without a ranked pair are done
                out[own[~open_]] = sizes[~open_]
                stay = np.repeat(open_, sizes)
                symbols, rank, stop = symbols[stay], rank[stay], stop[stay]
                own, sizes, low = own[open_], sizes[open_], low[open_]
                if not len(own):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, sizes))
            follow = np.flatnonzero(hits[1:] == hits[:-1] + 1) + 1
            if len(follow):  # of overlapping pairs, every second from the left
                begins = np.ones(len(hits), bool)
                begins[follow] = False
                runs = np.flatnonzero(begins)
                place = np.arange(len(hits)) - np.repeat(runs, np.diff(np.append(runs, len(hits))))
                hits = hits[place % 2 == 0]
            which = np.searchsorted(np.cumsum(sizes), hits, side="right")
            if not self.t.at_once:
                first = np.concatenate(([True], which[1:] != which[:-1]))
                hits, which = hits[first], which[first]
            symbols[hits] = result[rank[hits]]
            stop[hits] = stop[hits + 1]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            symbols, rank, stop = symbols[stay], rank[stay], stop[stay]
            sizes = sizes - np.bincount(which, minlength=len(sizes))
            at = hits - np.arange(len(hits))
            again = np.concatenate((at, at[at > 0] - 1))
            rank[again] = NONE
            again = again[~stop[again]]
            rank[again] = self._ranks(symbols[again], symbols[again + 1])[0]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        cut = [self.words(t) for t in texts]
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        new = list({w for words, _ in cut for w in words if w not in known})
        if new:
            parts = [self.pre_tokens(w) for w in new]
            distinct = list({p for ps in parts for p in ps})
            left = dict(zip(distinct, self.survivors([p.encode() for p in distinct]).tolist(), strict=True)) if distinct else {}
            known.update((w, sum([left[p] for p in ps])) for w, ps in zip(new, parts, strict=True))
        get = known.__getitem__
        out = np.array([sum(map(get, words)) + n for words, n in cut], np.int64)
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out


_counters: dict[int, Counter] = {}


def _counter(key: int, tokenizer: Tokenizer) -> Counter:
    """One counter per worker process, so that it knows words from earlier tasks."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(tokenizer)
    return _counters[key]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, and whether there are more than ``limit`` tokens."""
    tokenizer = Tokenizer.read(path)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    key = zlib.crc32(tokenizer.keys.tobytes() + tokenizer.pattern.encode() + repr((tokenizer.specials, tokenizer.nfc, tokenizer.lower)).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            found = np.zeros(len(texts), np.int64)
            parts = np.cumsum(sizes) // chunk  # rows of some megabytes together
            for i in np.unique(parts):
                at = np.flatnonzero(parts == i)
                found[at] = counter.counts([(texts[k] or b"").decode(errors="replace") for k in at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(found), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
