"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from monthmill.plans import registry
from monthmill.plans.base import REGISTRY



@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows(columns, values):
    fixed = [{c: None if isinstance(v, float) and math.isnan(v) else v for c, v in zip(columns, row)} for row in values]
    return sorted((tuple(r[c] for c in sorted(columns)) for r in fixed), key=str)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_equals_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    sql = registry.oracles().get(name)
    if sql is None:
        return
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4)), (a, b)
