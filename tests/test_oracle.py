"""Every query with SQL agrees with DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

from memspark.plans.oracle import SQL as FIRST_SQL
from memspark.plans.report_sql import REPORT_SQL
from memspark.plans.reports import QUERIES

SQL = FIRST_SQL | REPORT_SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols and got == want
