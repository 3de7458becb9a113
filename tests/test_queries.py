"""Every query that has SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from tillage.plans import more_queries  # noqa: F401 - registers
from tillage.plans.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the given tables are absent")


def rows(df, columns):
    key = lambda v: (v is not None, isinstance(v, str), v if not isinstance(v, float) else round(v, 6))
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted([tuple(map(clean, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)], key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, D).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    con = duckdb.connect()
    for t in sorted(os.listdir(D)):
        con.execute(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)), (x, y)
