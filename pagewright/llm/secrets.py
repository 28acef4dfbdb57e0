"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: an AND of ORs
of literal strings that every match must contain, each string being an AND of
its trigrams. Postings (trigram, row) are made for the trigrams that the rules
ask for; a query's postings are intersected by counting, per row and string,
how many of its trigrams the row has. Rows that pass are verified with the
regex itself. A rule without a mandatory trigram scans every row.

Only DataFrame and SQL functions are used.

Defined cases: a null text counts as empty; rows with a null or a repeated
doc_id are kept, one result row for each, as rows are told apart by where
they lie; spans are code points, end
exclusive; matches are leftmost and non-overlapping within a rule, and a match
that fails its rule's length test is dropped together with its characters; a
web token (``jwt``) has parts of any length and begins at the start of the
text or after a character that no token holds; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.rows import from_files, placed
from pagewright.shared import write_shared


@dataclass(frozen=True)
class Rule:
    """``regex`` is the same for Java and RE2; ``group`` (0: the whole match) must be ``least`` characters long.

    ``lead``: group 1 is what stands before the match and isn't a part of it (the two dialects share no look-behind).
    """

    kind: str
    regex: str
    group: int
    least: int
    lead: bool = False


def either_case(word: str) -> str:
    """The word with both cases of each ASCII letter."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in word)


# The base rules, in the order in which spans of one start are listed.
_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Further rules that the index makes cheap: private key blocks and prefixed service tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    # begins only where no token character stands before it, so that a run of any length has one start and is read once
    Rule("jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, True),
)


# ---- the queries -------------------------------------------------------------------------

BROADCAST_ROWS = 200_000  # candidates, about a hundred bytes each, that are sent to every task
MOST_STRINGS = 64  # alternatives that are spelled out before a piece counts as open


def _spelled(node: list, most: int) -> list[set[str] | None]:
    """The parts of a parsed regex in order: the strings a part can be, or None where it is open."""
    parts: list[set[str] | None] = []
    for op, arg in node:
        if op is sre.LITERAL:
            parts.append({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            parts.append({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            parts += _spelled(arg[3], most)
        elif op is sre.BRANCH:
            whole: set[str] | None = set()
            for branch in arg[1]:
                one = _joined(_spelled(branch, most), most)
                whole = None if whole is None or len(one) != 1 or one[0] is None else whole | one[0]
            parts.append(whole if whole is not None and len(whole) <= most else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _joined(_spelled(inner, most), most)
            if low == 0 and high == 1 and len(one) == 1 and one[0] is not None:
                parts.append(one[0] | {""})
            else:
                parts += _spelled(inner, most) * min(low, 3) + ([None] if high != low or low > 3 else [])
        elif op is sre.AT:
            continue
        else:
            parts.append(None)
    return parts


def _joined(parts: list[set[str] | None], most: int) -> list[set[str] | None]:
    """Neighbouring parts put together as long as the strings stay few."""
    out: list[set[str] | None] = []
    for p in parts:
        if p is not None and out and out[-1] is not None and len(out[-1]) * len(p) <= most:
            out[-1] = {a + b for a, b in product(out[-1], p)}
        else:
            out.append(p)
    return out


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets (lower case); empty where nothing is mandatory."""
    query = []
    for strings in _joined(_spelled(list(parser.parse(regex)), MOST_STRINGS), MOST_STRINGS):
        if strings and all(len(s) >= 3 for s in strings):
            query.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))
    return query


# ---- the index ---------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, text)``: row is a hash of where the row lies; rows that share it share their candidates, which only costs verification."""
    rows = placed(from_files(docs))
    return rows.select(F.xxhash64("at").alias("row"), F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))


def postings(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(trigram, row)`` for every trigram that a rule's query asks for; ``rows`` has row and text."""
    asked = sorted(set().union(*(g for r in rules for clause in trigram_query(r.regex) for g in clause), frozenset()))
    lower = F.lower("text")
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in asked]))
    return rows.select("row", lower.alias("low")).select("row", F.explode(has).alias("trigram"))


def _has_all(kind: str, clause: int, string: int, need: int) -> Column:
    """Whether the row's postings cover all trigrams of one string of a query."""
    return F.size(F.filter("has", lambda x: (x["kind"] == kind) & (x["clause"] == clause) & (x["string"] == string))) == need


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(row, kinds)``: the rules whose trigram query the row passes."""
    plan = [(r.kind, c, s, t, len(grams)) for r in rules for c, clause in enumerate(trigram_query(r.regex)) for s, grams in enumerate(clause) for t in sorted(grams)]
    clauses = {r.kind: len(trigram_query(r.regex)) for r in rules}
    asked = rows.sparkSession.createDataFrame(plan, "kind string, clause int, string int, trigram string, need int")
    found = postings(rows, rules).join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    # per row: which strings have all their trigrams, which clauses one of their strings, which rules all their clauses
    per_row = found.groupBy("row").agg(F.collect_set(F.struct("kind", "clause", "string", "trigram", "need")).alias("has"))
    kinds = []
    for kind, n in clauses.items():
        if not n:
            continue
        tests = []
        for c in range(n):
            strings = {(s, need) for k, cl, s, _, need in plan if k == kind and cl == c}
            tests.append(reduce(or_, [_has_all(kind, c, s, need) for s, need in sorted(strings)]))
        kinds.append(F.when(reduce(and_, tests), F.lit(kind)))
    return per_row.select("row", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


# ---- verification ------------------------------------------------------------------------

STEP = 256  # matches whose places are added up in one array

def _spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches, as structs (start, end, kind); the matches and the gaps between them make the text."""
    regex = F.lit(rule.regex if rule.kind != "hex" else f"[0-9a-f]{{{rule.least},}}")
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, regex, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.regex if rule.kind != "hex" else f"[0-9a-f]{{{rule.least},}}", -1), lambda g: F.char_length(g))
    before = F.regexp_extract_all(text, regex, F.lit(1)) if rule.lead else F.transform(whole, lambda m: F.lit(""))
    lengths = {"length": whole, "tested": tested, "lead": before}
    pieces = F.arrays_zip(gaps.alias("gap"), *[F.transform(v, lambda m: F.char_length(m)).alias(k) for k, v in lengths.items()])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,tested:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"] + p["lead"]
        end = acc["at"] + p["gap"] + p["length"]
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), (p["tested"] - p["lead"]).alias("tested"))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(p["length"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    # some pieces at a time, so that the growing arrays stay small: the time is in proportion to the matches
    cuts = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STEP).cast("int"))
    parts = F.transform(cuts, lambda k: F.aggregate(F.slice(pieces, k * STEP + 1, STEP), start, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,spans:array<struct<start:int,end:int,kind:string,tested:int>>>>").alias("out"))

    def place(acc: Column, part: Column) -> Column:
        based = F.struct(acc["at"].alias("base"), part["spans"].alias("spans"))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(based)).alias("out"))

    placed_ = F.aggregate(parts, none, place)["out"]

    def kept(part: Column) -> Column:
        good = F.filter(part["spans"], lambda s: s["tested"] >= rule.least)
        return F.transform(good, lambda s: F.struct((s["start"] + part["base"]).alias("start"), (s["end"] + part["base"]).alias("end"), s["kind"].alias("kind")))

    return F.flatten(F.transform(placed_, kept))


def _listed(spans: Column, order: list[str]) -> Column:
    """kind:start:end by start, then kind in the given order, comma-joined."""
    places = F.array(*[F.lit(k) for k in order])
    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(places, s["kind"]).alias("place"), s["end"], s["kind"])))
    return F.array_join(F.transform(by, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, and per rule an array of spans in a column of the rule's name."""
    rules = base + more
    rows = keyed(docs)
    found = write_shared(candidates(rows, rules), "secret-candidates")
    # few candidates go to the texts where they lie; many are joined to them by a shuffle
    few = found.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(found) if few else found.hint("shuffle_hash"), "row", "left").drop("row")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    for r in rules:
        asked = F.array_contains("kinds", r.kind) if trigram_query(r.regex) else F.col("text").rlike(f"[0-9a-f]{{{r.least}}}" if r.kind == "hex" else r.regex)
        joined = joined.withColumn(r.kind, F.when(F.coalesce(asked, F.lit(False)), _spans(F.col("text"), r)).otherwise(none))
    return joined.drop("kinds")


def report(scanned: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, the number of base spans per kind, the digest of the base spans and the list of all spans."""
    order = [r.kind for r in base + more]
    own = _listed(F.concat(*[F.col(r.kind) for r in base]), order)
    return scanned.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(own, 256).alias("base_sha256"),
        _listed(F.concat(*[F.col(k) for k in order]), order).alias("spans"),
    )
