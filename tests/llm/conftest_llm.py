"""Small tables with every awkward row."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `size` int, `key` string, `row` int, `_metadata` int, __file string, __row int, __copies int, __copy int, at int, doc string"


def documents(spark, rows, folder=None, kind="parquet"):
    """A documents table with extra columns whose names clash with ones the operators use; read from files of some kind if a folder is given."""
    full = [(d, t, "en", s, None, 1, "k", 2, 3, "f", 4, 5, 6, 7, "d") for d, t, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if folder is None:
        return df
    df.write.format(kind).save(str(folder))
    return spark.read.schema(df.schema).format(kind).load(str(folder))


@pytest.fixture
def awkward():
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, "alpha beta gamma delta epsilon zeta", "a"), (2, "alpha  beta\tgamma delta epsilon zeta ", "a"), (3, None, "b"), (4, "", None), (5, " \n", "b"),
        (6, long_text, "c"), (7, long_text, "c"), (7, long_text, "c"), (None, "null id", None), (9, "ünï çödé \U0001f600", "a"), (10, "one", "z"),
    ]
