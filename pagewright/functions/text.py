"""Text expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))  # the same, one by one
# Runs of them, written so that a character below U+1680 is told by one look at a table and one comparison; a single space isn't met, as it stays.
_ANY = r"[\t\n\x0B\f\r \xA0[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
_RUNS = rf"{_ANY}(?:(?<! ){_ANY}*|{_ANY}+)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_block_text(text: Column) -> Column:
    """LF line ends, runs of blanks as one space, trimmed lines, at most one empty line, trimmed ends."""

    def lined(t: Column) -> Column:
        t = F.regexp_replace(t, " ?\n ?", "\n")
        return F.regexp_replace(t, "\n{3,}", "\n\n")

    def spaced(t: Column) -> Column:
        t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        t = F.regexp_replace(t, "[\t ]+", " ")
        return bound(t, lambda x: F.when(x.contains("\n"), lined(x)).otherwise(x))

    # most lines have nothing to replace, and looking for four strings costs far less than the expressions
    plain = bound(text, lambda x: F.when(x.contains("\t") | x.contains("\r") | x.contains("\n") | x.contains("  "), spaced(x)).otherwise(x))
    return trimmed(plain)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda all_: None if all_ is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in all_])


def _beyond_ascii(text: Column) -> Column:
    """The text if composition may change it, else null, which costs nothing to send."""
    return F.when(F.octet_length(text) != F.char_length(text), text)


def canonical(text: Column, compose: bool = False) -> Column:
    """Lower case, white space runs as one space, trimmed; with ``compose`` after NFKC."""
    t = F.lower(F.coalesce(nfkc(_beyond_ascii(text)), text) if compose else text)
    return F.trim(F.regexp_replace(t, _RUNS, " "))


def canonical_all(texts: Column) -> Column:
    """Hashes of ``canonical(text, compose=True)`` of an array of texts."""
    composed = F.zip_with(_nfkc_all(F.transform(texts, _beyond_ascii)), texts, lambda a, b: F.coalesce(a, b))
    return F.transform(composed, lambda t: F.sha2(canonical(t), 256))


def garbled_count(text: Column) -> Column:
    """Replacement characters, white squares and control characters other than LF, CR, TAB."""
    kept = F.regexp_replace(text, r"[\x{FFFD}\x{25A1}\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.char_length(text) - F.char_length(kept)


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, r"[ \t\r\n\f\x0B]+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Words; the additive stand-in for a tokenizer whose vocabulary isn't at hand."""

    def counted(t: Column) -> Column:
        # words that single spaces part are counted by these, which costs far less than a regex
        odd = t.contains("  ") | t.contains("\t") | t.contains("\r") | t.contains("\f") | t.contains("\x0b")
        ends = F.startswith(t, F.lit(" ")).cast("int") + F.endswith(t, F.lit(" ")).cast("int")
        spaces = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
        return F.when(odd, F.regexp_count(t, F.lit(r"[^ \t\r\n\f\x0B]+"))).when(t == "", 0).otherwise(spaces + 1 - ends).cast("long")

    return bound(F.replace(F.replace(text, F.lit("\n\n"), F.lit(" ")), F.lit("\n"), F.lit(" ")), counted)


def exploded(array: Column, pos: str, item: str) -> tuple[Column, Column]:
    """A column (pos, item) of an array's items, and what to filter by: for arrays that cost much. An inner explode has the optimizer work its array out a second time, to see whether it is empty."""
    return F.posexplode_outer(array).alias(pos, item), F.col(item).isNotNull()


def word_windows(text: Column, size: Column, overlap: Column) -> Column:
    """An array of windows of ``size`` words, each ``overlap`` words into the one before; the last ends with the text."""

    def cut(all_: Column) -> Column:
        w, size, stride = all_["w"], all_["size"], all_["stride"]
        last = F.when(F.size(w) <= size, 0).otherwise(F.ceil((F.size(w) - size) / stride)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, (i * stride + 1).cast("int"), size.cast("int")), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(parts)

    # words and sizes are bound once, not worked out again for every window
    return bound(size, lambda s: bound(F.struct(words(text).alias("w"), s.alias("size"), (s - overlap).alias("stride")), cut))


def trimmed(text: Column) -> Column:
    """Without white space at its ends; no expression looks at what lies between."""
    return F.btrim(text, F.lit(BLANKS))


def embedding_text(heading_path: Column, body: Column) -> Column:
    """The heading path's line, then the trimmed body; empty parts are left out."""
    path = F.when(F.size(heading_path) > 0, F.concat(F.lit("标题路径："), F.array_join(heading_path, " > ")))
    rest = trimmed(body)
    return F.concat_ws("\n", path, F.when(rest != "", rest))


def short_summary(text: Column, size: int = 500) -> Column:
    """White space runs as one space, trimmed, the first characters."""
    return F.left(F.trim(F.regexp_replace(text, _RUNS, " ")), F.lit(size))


def table_row(cells: Column) -> Column:
    """A pipe-delimited row; pipes in cells are escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def safe_file_name(name: Column) -> Column:
    """Last path segment without control and reserved characters and leading dots, 240 characters, never empty."""
    n = F.element_at(F.split(name, r"[/\\]"), -1)
    n = F.regexp_replace(n, r"[\x00-\x1F\x7F]", "")
    n = F.regexp_replace(F.regexp_replace(n, r"\s+", " "), r'[<>:"|?*]', "_")
    n = F.left(F.regexp_replace(F.trim(n), r"^\.+", ""), F.lit(240))
    return F.when(F.coalesce(n, F.lit("")) == "", "unnamed").otherwise(n)
