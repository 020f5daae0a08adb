"""Exact quantiles by histogram refinement agree with numpy (quantile_cont)."""
import numpy as np
import pytest

from hearth.operators.outliers import iqr_bounds, split_outliers
from hearth.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("kind", ["uniform", "heavy_dupes", "skewed", "hot_key"])
def test_exact_matches_numpy(spark, kind):
    rng = np.random.default_rng(7)
    n = 3000
    if kind == "uniform":
        x = rng.uniform(-1e6, 1e6, n)
    elif kind == "heavy_dupes":
        x = rng.integers(0, 5, n).astype(float)
    elif kind == "skewed":
        x = np.exp(rng.normal(0, 6, n))
    else:  # one value holds a third of the rows
        x = np.concatenate([np.full(n // 3, 42.0), rng.normal(0, 1, n - n // 3)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    # few bins force several refinement passes
    got = exact_quantiles(df, "x", probs, bins=8)
    want = np.percentile(x, [p * 100 for p in probs])
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_all_null_column_gives_null_bounds(spark):
    df = spark.createDataFrame([(None,), (None,)], "price double")
    b = iqr_bounds(df, "price", relative_error=None)
    assert b.lower is None and b.upper is None
    kept, out, _ = split_outliers(df, "price", relative_error=None)
    assert kept.count() == 0 and out.count() == 0
    b2 = iqr_bounds(df, "price", relative_error=0.05)
    assert b2.lower is None


def test_null_price_in_neither_set(spark):
    rows = [(float(v),) for v in range(1, 101)] + [(None,), (10000.0,)]
    df = spark.createDataFrame(rows, "price double")
    kept, out, b = split_outliers(df, "price", relative_error=None)
    assert kept.count() + out.count() == 101
    assert [r.price for r in out.collect()] == [10000.0]


@pytest.mark.parametrize("n", [40_000, 200_000])
@pytest.mark.parametrize("extreme", [[np.inf], [-np.inf], [np.inf, -np.inf, np.inf], [1e308, -1e308], [5e-324, 1.7e308, -1.7e308]])
def test_extremes_do_not_change_the_route(spark, n, extreme):
    """One infinity or an overflowing span neither stalls the search nor shifts a rank."""
    df = spark.range(0, n, 1, 4).selectExpr("CAST((id * 7919) % 10007 AS DOUBLE) + id / 1000000.0 AS x")
    df = df.unionByName(spark.createDataFrame([(v,) for v in extreme], "x double"))
    got = exact_quantiles(df, "x", [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])
    ids = np.arange(n)
    x = np.concatenate([(ids * 7919) % 10007 + ids / 1e6, extreme])
    assert got == pytest.approx([float(np.min(x)), *np.quantile(x, [0.1, 0.25, 0.5, 0.75]), float(np.max(x))], rel=1e-12)


def test_only_infinities(spark):
    df = spark.createDataFrame([(np.inf,), (np.inf,), (-np.inf,)], "x double")
    assert exact_quantiles(df, "x", [0.0, 0.5, 1.0]) == [-np.inf, np.inf, np.inf]


def test_sketch_keeps_its_rank_error(spark):
    from hearth.operators.quantiles import approx_quantiles
    n, error = 20_000, 0.05
    df = spark.range(n).selectExpr("CAST((id * 7919) % 20011 AS DOUBLE) AS x")
    x = np.sort((np.arange(n) * 7919) % 20011)
    for p, v in zip([0.25, 0.5, 0.75], approx_quantiles(df, "x", [0.25, 0.5, 0.75], error)):
        assert abs(np.searchsorted(x, v) - p * n) <= error * n + 1
