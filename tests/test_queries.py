import pytest
from pyspark.sql import functions as F

from graphloom import oracles, queries
from graphloom.operators import visits


@pytest.fixture(autouse=True, scope="module")
def runs_made_once():
    """Questions under all presets are answered once for the queries of this module; runs do not depend on each other."""
    made, run = {}, queries._run

    def once(spark, sf_dir, *presets):
        if sf_dir not in made:
            made[sf_dir] = run(spark, sf_dir, *[p[0] for p in visits.PRESETS])
        outcomes, branches, gold = made[sf_dir]
        mine = F.col("preset").isin(*presets)
        return outcomes.where(mine), branches.where(mine), gold

    queries._run = once
    yield
    queries._run = run


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], oracles.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_query_without_sql_runs(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0
