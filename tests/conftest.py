import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    session = local_session("8", 4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Compares a query with its SQL on the smallest tables, as multisets of rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(small)):
        con.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        return v if v is None or isinstance(v, (bool, int, str)) else str(v)

    def check(query, sql):
        df = query(spark, small)
        cols = sorted(df.columns)
        got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
        told = con.execute(sql)
        names = [d[0] for d in told.description]
        want = sorted(([plain(r[names.index(c)]) for c in cols] for r in told.fetchall()), key=repr)
        assert cols == sorted(names)
        assert got == want

    return check
