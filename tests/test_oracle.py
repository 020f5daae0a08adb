"""Every registered query with a SQL twin agrees with DuckDB at sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from hearth.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"kmeans_sweep", "ridge_price_model", "cluster_price_model"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    return v


def _rows(records, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = [r.asDict() for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert _rows(srows, cols) == _rows(drows, cols)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["province", "n_listings", "mean_price", "min_price", "max_price"]
