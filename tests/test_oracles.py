"""Every registered query against its DuckDB oracle on the sf0.01 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF01
from docweave.plans import catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES = {name: fn for name, fn in E.queries().items() if name in catalog.QUERIES}
ORACLES = {name: sql for name, sql in E.oracle_sql().items() if name in QUERIES}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    return v


def _bag(rows, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    return con


def test_contract():
    assert set(ORACLES) == set(QUERIES)  # every registered query has a DuckDB oracle
    assert len(QUERIES) >= 100


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["entity", "map"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF01)
    cols = sorted(sdf.columns)
    srows = [r.asDict() for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert sorted(dcols) == cols
    assert len(srows) == len(drows)
    assert _bag(srows, cols) == _bag(drows, cols)

