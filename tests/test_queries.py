"""Every query of the library against DuckDB, over the smallest tables."""

import pytest

from cairn.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_same_as_duckdb(name, same_rows):
    same_rows(q.queries()[name], q.oracle_sql()[name])


def test_every_query_has_sql():
    assert q.queries().keys() == q.oracle_sql().keys()
