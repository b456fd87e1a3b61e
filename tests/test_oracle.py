"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from scrivia.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA, rows_of, rows_of_sql


#: Queries that find nothing in the smallest tables; they have rows in larger ones.
NO_ROWS_HERE = {"u5_j14_difference"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, duck):
    columns, rows = rows_of(QUERIES[name](spark, DATA))
    wanted_columns, wanted = rows_of_sql(duck, ORACLE_SQL[name])
    assert columns == wanted_columns
    assert rows == wanted
    assert rows or name in NO_ROWS_HERE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
