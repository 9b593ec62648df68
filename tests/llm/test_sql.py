"""Every corpus query with SQL gives the rows that DuckDB gives."""

import pytest

from peakforge.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    expected = duck.sql(f"select {', '.join(columns)} from ({registry.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(expected, key=str) and expected
