"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from cellweave.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, data, duck):
    df = catalog.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    q = duck.execute(sql)
    names = [d[0] for d in q.description]
    expected = q.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    pick = lambda rs, cols: sorted(tuple(shown(r[cols.index(n)]) for n in order) for r in rs)
    assert pick(rows, df.columns) == pick(expected, names)
