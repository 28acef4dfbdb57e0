"""Cumulative-snapshot collapse and chat formatting.

Chat logs often hold a conversation once per turn, each snapshot with all
turns so far. Every prefix of a conversation gets a rolling hash (a sum of
128-bit hashes of position, role and text, so that it can be formed in blocks);
conversations whose whole hash is a proper prefix of a longer one are taken
out by an anti-join, equal ones leave the smallest conv_id, and the maximal
conversations that stay are rendered.

A conversation's turns are numbered and summed in two steps, by blocks of
``BLOCK`` turn numbers and then inside them, and rendered in parts of a block
each, so that a task holds the rows whose turn numbers share a block, and not
a whole conversation. Rows of one conversation that repeat a turn number, or
have none, share a block however many they are.

Prefixes are compared by their hashes and lengths, not by their turns: two
different ones of n conversations meet with a probability of about n * n /
2 ** 128.

Defined cases: turns are ordered by turn (null first), then role and text; a
null role or text differs from an empty one for the comparison and is rendered
as empty; rows without a conv_id take no part; role and text can't break the
format, as its markers are spelled with a space inside them; repeated rows are
repeated turns; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.shared import write_shared

BLOCK = 1024
WORDS = 4  # 32-bit words of a turn's hash


def _marked(c: Column) -> Column:
    return F.concat(F.coalesce(F.char_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, block, position (from 1), role, text, and the rolling hash h0.. of the prefix that ends here."""
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("slot", F.coalesce(F.shiftright("turn", 10), F.lit(-(1 << 63))))  # BLOCK is 2 ** 10; null turns come first
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    counts = rows.groupBy("conv_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv_id", "slot").orderBy(*order)
    rows = rows.join(counts, ["conv_id", "slot"]).withColumn("position", F.col("ahead") + F.row_number().over(inside)).drop("ahead", "turn")
    sha = F.sha2(F.concat(F.col("position").cast("string"), F.lit("|"), _marked(F.col("role")), F.lit("|"), _marked(F.col("text"))), 256)
    rows = write_shared(rows.withColumn("sha", sha), "chat-turns")
    for k in range(WORDS):
        rows = rows.withColumn(f"g{k}", F.conv(F.substring("sha", 1 + 8 * k, 8), 16, 10).cast("long"))
    sums = rows.groupBy("conv_id", "slot").agg(*[F.sum(f"g{k}").alias(f"s{k}") for k in range(WORDS)])
    sums = sums.select("conv_id", "slot", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"s{k}") for k in range(WORDS)])
    upto = Window.partitionBy("conv_id", "slot").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, ["conv_id", "slot"])
    return rows.select("conv_id", "slot", "position", "role", "text", *[(F.col(f"s{k}") + F.sum(f"g{k}").over(upto)).alias(f"h{k}") for k in range(WORDS)])


def collapse(prefixes: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, kept, kept_by (the conversation that holds its turns; itself if kept)."""
    key = ["position", *[f"h{k}" for k in range(WORDS)]]
    sizes = prefixes.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    rows = prefixes.select("conv_id", *key).join(sizes, "conv_id")
    whole = rows.filter("position = n_turns")
    copies = whole.groupBy(*key).agg(F.min("conv_id").alias("first"))
    # of each prefix only its longest holder is kept, task by task first: a common first turn is one row
    holders = rows.filter("position < n_turns").groupBy(*key).agg(F.max(F.struct("n_turns", F.bitwise_not("conv_id").alias("other"))).alias("holder"))
    holders = holders.select(*key, F.bitwise_not("holder.other").alias("holder"))
    maximal = copies.join(holders, key, "left_anti").select(*key, F.col("first").alias("kept_by"))
    inside = copies.join(holders, key).select(*key, F.col("holder").alias("kept_by"))
    named = whole.join(maximal.unionByName(inside), key)
    return named.select("conv_id", "n_turns", (F.col("conv_id") == F.col("kept_by")).alias("kept"), "kept_by")


def rendered(turns: DataFrame) -> DataFrame:
    """Chat markup of numbered turns, in parts of one block each: conv_id, part, text."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")

    line = F.concat(F.lit("<|im_start|>"), plain(F.col("role")), F.lit("\n"), plain(F.col("text")), F.lit("<|im_end|>\n"))
    lines = turns.select("conv_id", F.floor((F.col("position") - 1) / BLOCK).cast("int").alias("part"), F.struct("position", line.alias("line")).alias("x"))
    parts = lines.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("x")).alias("x"))  # at most BLOCK turns
    return parts.select("conv_id", "part", F.array_join(F.col("x.line"), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation and rendered part: conv_id, n_turns, kept, kept_by, part, text.

    Conversations that aren't kept have one row with part and text null.
    """
    prefixes = write_shared(numbered(turns), "chat-prefixes")
    found = write_shared(collapse(prefixes), "chat-kept")
    kept = prefixes.join(found.filter("kept").select("conv_id"), "conv_id", "left_semi")
    return found.join(rendered(kept), "conv_id", "left").select("conv_id", "n_turns", "kept", "kept_by", "part", "text")
