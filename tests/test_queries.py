"""Every query that SQL can express, against DuckDB; the others run."""

import pytest

from helpers import SF, same_rows
from pagewright.plans import flows, knowledge, publication, tables, texts  # noqa: F401
from pagewright.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    if name in SQL:
        same_rows(frame, duck, SQL[name])
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
