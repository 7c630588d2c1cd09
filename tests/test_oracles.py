"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from variantframe.plans import registry

SF = "/root/testdata/sf0.001"
#: Scale-dependent: the gate's row count is written for sf0.01's customers in both, so it agrees at any scale.
NAMES = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert cols == sorted(rel.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(repr(tuple(map(norm, r))) for r in rel.select(quoted).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship():
    assert registry.FLAGSHIP in registry.QUERIES
