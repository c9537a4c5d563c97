"""Every registered query of the library proper against its SQL, on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

import docloom.plans.more  # noqa: E402, F401
import docloom.plans.passages  # noqa: E402, F401
import docloom.plans.reports  # noqa: E402, F401
import docloom.plans.shapes  # noqa: E402, F401
import docloom.plans.studies  # noqa: E402, F401
from docloom.plans.queries import QUERIES, SQL  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(([plain(r[i]) for i in at] for r in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
