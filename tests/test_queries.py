"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from peakforge import queries as q
from peakforge import queries_more  # noqa: F401


def rows(found, columns):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, "" if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, duck, sf, name):
    df = q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    expected = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({q.SQL[name]})").fetchall()
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect(), columns) == rows(expected, columns)


def test_index_without_sql(spark, sf):
    recall = {r["rank"]: r for r in q.QUERIES["ann_recall"](spark, sf).collect()}
    last = recall[max(recall)]
    assert last["cumulative_found"] >= 0.9 * last["cumulative_total"]
    assert q.QUERIES["ivf_search"](spark, sf).groupBy("query_id", "idx").count().where("count > 1").count() == 0
    assert 0 < q.QUERIES["ivf_entropy"](spark, sf).first()["entropy"] <= 4


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
