import pytest

from graphloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    rows = df.collect()
    assert len({tuple(map(str, r)) for r in rows}) == len(rows)
