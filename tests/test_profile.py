"""Profiling operators against brute force on small literal frames."""
import numpy as np
import pytest

from hearth.operators import profile


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (3.0,), (3.0,), (9.0,)], "p double")
    assert profile.mode_value(df, "p").first()["mode"] == 3.0
    ct = profile.central_tendency(df, "p").first()
    assert ct["mode"] == 3.0 and ct["median"] == 5.0 and ct["mean"] == pytest.approx(5.0)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(30, 200, 500).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    h = profile.histogram(df, "v", 50).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=50)
    assert [r.n for r in h] == list(counts)
    assert [r.bin_lower for r in h] == pytest.approx(list(edges[:-1]))
    assert sum(r.n for r in h) == len(x)   # the maximum lands in the last bin


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    h = profile.histogram(df, "v", 10).collect()
    assert sum(r.n for r in h) == 2


def test_duplicate_report_and_dedup(spark):
    rows = [("a", 1), ("a", 1), ("b", None), ("b", None), ("c", 2)]
    df = spark.createDataFrame(rows, "k string, v int")
    r = profile.duplicate_report(df).first()
    assert (r.total_rows, r.unique_rows, r.duplicate_rows) == (5, 3, 2)
    assert profile.dedup_rows(df).count() == 3


def test_missing_counts_long_and_profile(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("1", None, float("nan")), (None, "x", 1.0), ("6+", "y", None)],
                               "rooms string, s string, d double")
    long = {r["column"]: r["missing_count"] for r in profile.missing_counts_long(df).collect()}
    assert long == {"rooms": 1, "s": 1, "d": 1}
    prof = {r["column"]: r for r in profile.missing_profile(
        df, {"rooms": F.col("rooms").try_cast("int")}).collect()}
    assert prof["rooms"].unparseable_count == 1
    assert prof["d"].nan_count == 1 and prof["d"].null_count == 1


def test_boxplot_matches_numpy(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(100, 10, 400), [500.0, -300.0, 260.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "p double")
    b = profile.boxplot_stats(df, "p").first()
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    inside = x[(x >= q1 - 1.5 * iqr) & (x <= q3 + 1.5 * iqr)]
    assert b.q1 == pytest.approx(q1, abs=1e-4) and b.median == pytest.approx(med, abs=1e-4)
    assert b.whisker_low == pytest.approx(inside.min(), abs=1e-4)
    assert b.whisker_high == pytest.approx(inside.max(), abs=1e-4)
    assert b.n_fliers == len(x) - len(inside)


def test_summary_stats(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    r = profile.summary_stats(df, ["a"]).first()
    assert r["count"] == 3 and r["mean"] == pytest.approx(7 / 3, abs=1e-4)
    assert r["stddev"] == pytest.approx(np.std([1, 2, 4], ddof=1), abs=1e-4)
