import glob
import math
import os

import duckdb
import pytest

from tideline.plans import catalog
from tideline.plans.padding import padded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_definition(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    result = con.execute(catalog.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(result.description)}
    assert sorted(df.columns) == sorted(at)
    columns = sorted(at, key=lambda c: (c in {c for c, kind in df.dtypes if kind == "double"}, c))
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, v if v is not None else 0) for v in r])
    got, want = order([tuple(r[c] for c in columns) for r in df.collect()]), order([tuple(r[at[c]] for c in columns) for r in result.fetchall()])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4)) for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("policy", ["extend", "reflect", "zero", "none"])
def test_edges_of_padding(spark, policy):
    schema = "g string, x double, y double"
    assert padded(spark.createDataFrame([], schema), "x", "y", ["g"], 3, policy).collect() == []
    rows = [(None, 1.0, 2.0), ("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 3.0, None)]
    got = padded(spark.createDataFrame(rows, schema), "x", "y", ["g"], 3, policy).collect()
    assert sum(r.g is None for r in got) == 1
    assert sorted(r["rank"] for r in got if r.g == "a") == list(range(2 if policy == "none" else 4))
