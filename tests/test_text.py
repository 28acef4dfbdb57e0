"""Text expressions against the regular expressions that define them, and how often a plan works them out."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from helpers import same_rows
from pagewright.functions import text
from pagewright.plans import texts
from pagewright.plans.registry import QUERIES, SQL
from pagewright.sources import pdf

SF = "/root/testdata/sf0.001"


def test_texts_are_what_the_sql_makes_of_them(spark, duck):
    """Blanks of all kinds; a text that ends with a next-line sign keeps the blank before it, which isn't at its end."""
    draw = random.Random(4)
    signs = ["a", "B", "ä", "語", " ", "  ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", " ", " ", " ", " ", "　", "﻿", "​", "\x1c"]
    rows = [(i, "".join(draw.choice(signs) for _ in range(draw.randint(0, 14)))) for i in range(1500)] + [(2000, "a \x85"), (2001, ""), (2002, None)]
    got = spark.createDataFrame(rows, "id long, text string").select("id", text.trimmed(F.col("text")).alias("t"), text.canonical(F.col("text")).alias("c"), text.normalize_block_text(F.col("text")).alias("n"), text.token_count(F.col("text")).alias("w"))
    duck.execute("CREATE OR REPLACE TEMP TABLE odd (id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO odd VALUES (?, ?)", rows)
    said = duck.execute(f"SELECT id, regexp_replace(text, '^{text.SPACE}+|{text.SPACE}+$', '', 'g'), {texts.sql_canon('text')}, {texts.sql_norm('text')}, len({texts.sql_words('text')}) FROM odd ORDER BY id").fetchall()
    assert sorted(map(tuple, got.collect())) == said


def test_a_file_is_made_and_read_once(spark):
    """Lines aren't cut again for every page, and pages aren't parsed again for the rows of broken files."""
    made = texts._pdf_files(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("split(text") == 1
    ran = texts.pdf_coverage(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert ran.count("MapInPandas") == 1


def test_objects_are_found_by_their_word():
    data = b"%PDF\n1 0 obj\n<<>>\nendobj 12 0\n obj 3 0 object 007 00 obj\x00 4 0obj x5 0 obj"
    assert list(pdf._objects(data)) == [(int(m[1]), m.start()) for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj(?![a-z])", data)]


def test_sizes_of_windows_are_worked_out_once(spark):
    """Not once more for every window."""
    rows = spark.createDataFrame([("a b c d e f g", "xx")], "t string, s string")
    size = F.char_length(F.concat(F.lit("once"), "s"))
    found = rows.select(text.word_windows(F.col("t"), size - 3, size - 4).alias("w"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat(once") == 2  # a size and an overlap
    assert found.first()["w"] == ["a b c", "b c d", "c d e", "d e f", "e f g"]


def test_files_of_odd_texts_are_what_the_sql_says(spark, tmp_path):
    """Null, empty and blank texts have no page, a null key has no text, and no file has too many pages."""
    odd = [(0, None), (1, ""), (2, " \n\t\n "), (3, ""), (4, "one\n\n　\ntwo"), (None, "one\ntwo"), (8, None), (10, "a b\n" * 31), (11, "x\n" * 60_031)]
    spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("pdf_coverage", "pdf_blocks"):
        same_rows(QUERIES[name](spark, str(tmp_path)), con, SQL[name])
