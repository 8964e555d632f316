"""Every registered query against its SQL on the smallest tables."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from qspark.plans import registry

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (np.ndarray, list)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    return str(bool(v)) if isinstance(v, (bool, np.bool_)) else str(v)


def table(p: pd.DataFrame) -> list:
    p = p[sorted(p.columns)]
    # a whole number in one and a float in the other are compared as floats
    return sorted(tuple(plain(float(v)) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else plain(v) for v in r) for r in p.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_array_rank_of_equal_prices(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    prices = {1: [5.0, 5.0, 1.0, 9.0, 9.0, 9.0], 2: [None, 3.0, None, 3.0, 1.0], 3: [nan, 1.0, nan, inf, -inf], 4: [-0.0, 0.0, -1.0, -0.0], 5: [None, None], 6: [7.0], None: [2.0, 2.0, 1.0]}
    made = [(c, p) for c, ps in prices.items() for p in ps]
    rows = [(k, c, p, "5-LOW") for k, (c, p) in enumerate(made)] + [(k, 7, p, "5-LOW") for k, p in ((1, 5.0), (None, 7.0), (3, 1.0), (4, 5.0))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(f"SELECT o_custkey, x, b FROM ({registry.ORACLES['array_rank']})").fetchall()}
    got = {r["o_custkey"]: (r["x"], r["b"]) for r in registry.QUERIES["array_rank"](spark, str(tmp_path)).collect()}
    assert got == want and got[1] == ([1, 1, 0, 3, 3, 3], [0, 0, 0, 1, 1, 1]) and got[7] == ([1, 0, 1, 3], [0, 0, 0, 2])
