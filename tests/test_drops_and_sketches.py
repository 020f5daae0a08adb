"""Dedup over drops, stored sketches, profiles with the write, checked files, samples."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth import session
from hearth.functions.sql import register_functions
from hearth.operators import extract, profile, sketches
from hearth.session import scratch_path
from hearth.sources import files
from hearth.streaming import drops


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def test_rows_are_new_once_over_drops_and_restarts(spark):
    schema = "a string, b string, c int"
    parts = [[("x", "y", 1), ("x", "y", 1), (None, "", 2), ("", None, 2)], [("x", "y", 1), ("xy", "", 1), ("", None, 2)], [(None, None, None), ("x", "y", 1)], []]
    source, out, ckpt, counts, counts_ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt", "counts", "counts-ckpt"))
    from hearth.streaming.listing_stream import run_available
    seen, last = [], None
    for part in parts:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(source)
        drops.append_available(drops.new_rows(stream_of(spark, source, schema)), out, ckpt)
        last = run_available(drops.row_counter(stream_of(spark, source, schema)), counts, counts_ckpt) or last
        seen += part
        got = [tuple(r) for r in spark.read.parquet(out).collect()]
        assert sorted(got, key=str) == sorted(set(seen), key=str)
        assert tuple(drops.duplicate_report(spark, last, out).first()) == (len(seen), len(set(seen)), len(seen) - len(set(seen)))


def test_digests_tell_rows_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("-", "ab"), ("1:a", "b"), ("a,1:b", None), ("a", "1:b"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(drops.row_digest(df)).distinct().count() == len(rows)


def test_state_is_bounded_by_an_event_time(spark):
    schema = "a string, ts timestamp"
    day = lambda d: dt.datetime(2024, 1, d)
    source, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    for part in ([("x", day(1)), ("x", day(1))], [("y", day(9))], [("z", day(20))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        drops.append_available(drops.new_rows(stream_of(spark, source, schema), "ts", "2 days"), out, ckpt)
    assert sorted(r.a for r in spark.read.parquet(out).collect()) == ["x", "y", "z"]
    with pytest.raises(ValueError):
        drops.new_rows(stream_of(spark, source, schema), "ts")


# ---- sketches ------------------------------------------------------------

def test_sketches_of_drops_merge_within_the_error(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 2.5), rng.exponential(size=3000) * 100])
    rows = [(k % 5, "ab"[k % 2], float(v)) for k, v in enumerate(values)] + [(0, "a", None), (1, "b", float("nan")), (2, "a", float("inf")), (3, "c", None)]
    df = spark.createDataFrame(rows, "drop int, g string, v double")
    store = scratch_path(spark, "sketches")
    for d in (0, 1, 2, 3, 4, 2, 2):
        sketches.add_drop(df.where(F.col("drop") == d), d, ["g"], "v", store)
    p = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = sketches.quantiles(sketches.stored(spark, store), ["g"], p)
    errors = sketches.rank_errors(df, ["g"], "v", found).collect()
    assert len(errors) == 2 * len(p) and max(r.rank_error for r in errors) <= sketches.RANK_ERROR
    assert {(r.g, r.n, r.value) for r in found.where("g = 'c'").collect()} == {("c", 0, None)}
    m = {r.g: r for r in sketches.merged(sketches.stored(spark, store), ["g"]).collect()}
    assert (m["a"].n_rows, m["a"].n, m["a"].n_infinite, m["c"].n_rows) == (5002, 5000, 1, 1)
    assert sum(r.n_rows for r in sketches.merged(sketches.stored(spark, store, [1, 3]), []).collect()) == sum(x[0] in (1, 3) for x in rows)
    whole = sketches.quantiles(sketches.stored(spark, store), [], [0.5]).first()
    assert whole.n == 10000 and abs(np.mean(values <= whole.value) - 0.5) < 0.21


def test_bounds_from_sketches_are_near_the_exact_ones(spark):
    df = spark.range(20001).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"))
    store = scratch_path(spark, "sketches")
    sketches.add_drop(df, 0, ["g"], "v", store)
    r = sketches.iqr_bounds(sketches.stored(spark, store), ["g"]).first()
    assert abs(r.lower + 10000) < 3000 and abs(r.upper - 30000) < 3000


# ---- profile with the write ----------------------------------------------

def test_profile_comes_with_the_write(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, "b", None), (4.0, None, None)], "x double, `s.t` string, n int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("profiled", "one write")
    staged, report = profile.profile_while_staging(df, "p", ["x"])
    jobs = len(tracker.getJobIdsForGroup("profiled"))
    spark.sparkContext.setJobGroup("plain", "one write")
    session.stage(df, "q")
    assert jobs == len(tracker.getJobIdsForGroup("plain"))  # the figures cost no job of their own
    got = {r["column"]: tuple(r)[1:] for r in report.collect()}
    assert got["x"] == (3, 1, 2, 2.5, pytest.approx(math.sqrt(4.5)), 1.0, 4.0)
    assert got["s.t"] == (3, 1, None, None, None, None, None) and got["n"][:2] == (3, 3)
    assert staged.count() == 3
    _, empty = profile.profile_while_staging(df.limit(0), "e", ["x"])
    assert {tuple(r)[1:3] for r in empty.collect()} == {(0, 0)}


# ---- histograms with infinities ------------------------------------------

def test_histogram_leaves_out_what_is_not_finite(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 10.0, inf, -inf, float("nan"), None)], "v double")
    rows = profile.histogram(df, "v", 5).collect()
    assert [r.n for r in rows] == [2, 1, 0, 0, 1] and rows[0].bin_lower == 0.0 and rows[-1].bin_upper == 10.0
    wide = spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,)], "v double")
    assert [r.n for r in profile.histogram(wide, "v", 4).collect()] == [1, 0, 1, 1]
    only = spark.createDataFrame([(inf,), (None,)], "v double")
    assert [(r.bin_lower, r.n) for r in profile.histogram(only, "v", 2).collect()] == [(None, 0)] * 2
    pairs = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (inf, 0.5), (0.5, None), (0.5, float("nan"))], "a double, b double")
    assert sorted(map(tuple, profile.binned_pairs(pairs, "a", "b", 2).collect())) == [(1, 1, 1), (2, 2, 1)]
    assert profile.binned_pairs(only.withColumn("w", F.lit(1.0)), "v", "w", 2).count() == 0


# ---- checked CSV, partitioned sink, SQL functions ------------------------

def test_malformed_lines_are_kept_and_named(spark, tmp_path):
    lines = ["a,b,c", '1,"x, y",3', "2,short", "3,x,y,long", '4,"two ""q""",z', "", "  ", ",,", '5,"open,z']
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    rows = files.read_csv_checked(spark, str(tmp_path / "t.csv"), ["a", "b", "c"], header="a,b,c")
    got = {r.a: (r.b, r.c, r[files.MALFORMED]) for r in rows.collect()}
    assert got["1"] == ("x, y", "3", None) and got["4"] == ('two "q"', "z", None) and got[None] == (None, None, None)
    assert got["2"][2] == "2,short" and got["3"][2] == "3,x,y,long" and got["2"][0] == "short"
    assert got["5"][2] == '5,"open,z'
    report = {r.fault: r.n_lines for r in files.malformed_report(rows, 3).collect()}
    assert report == {"sound": 3, "short": 2, "long": 1}
    assert rows.where(F.col(files.MALFORMED).isNotNull()).select("a").count() == 3


def test_one_partition_is_overwritten(spark):
    path = scratch_path(spark, "parts")
    files.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "p string, v int"), path, ["p"])
    files.overwrite_partitions(spark.createDataFrame([("b", 9), ("c", 4)], "p string, v int"), path, ["p"])
    rows = spark.read.schema("v int, p string").parquet(path)
    assert sorted((r.v, r.p) for r in rows.collect()) == [(1, "a"), (3, None), (4, "c"), (9, "b")]
    plan = rows.where("p = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "= b)" in plan


def test_sql_functions_equal_the_column_functions(spark):
    from hearth.functions.parse import price_usd
    names = register_functions(spark)
    assert "price_usd" in names
    texts = ["$120,000", "֏ 48,000,000", "€90,000", "$ 52,000 monthly", "12 000", "", None, "negotiable"]
    df = spark.createDataFrame([(t,) for t in texts], "price string")
    got = [tuple(r) for r in spark.sql("SELECT price_usd(price) AS p, price_usd(price, 100D) AS q, price_usd(price, usd_per_eur => 2D) AS r FROM {d}", d=df).collect()]
    assert [g[0] for g in got] == [r[0] for r in df.select(price_usd("price")).collect()]
    assert got[1][1] == 480000.0 and got[2][2] == 180000.0
    assert spark.sql("SELECT text_before('a, b'), text_before('a;b', ';'), whole_number('6+'), whole_number('6')").first() == ("a", "a", None, 6)
    plan = spark.sql("SELECT price_usd(price) FROM {d}", d=df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" in plan and "python" not in plan.lower()


# ---- samples and label columns -------------------------------------------

def test_sample_is_the_same_under_any_partitioning(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = None
    for n in (1, 7):
        got = sorted(map(tuple, profile.bottom_k(df.repartition(n), F.col("k"), 25, ["g"]).collect()))
        assert len(got) == 75 and (want is None or got == want)
        want = got
    parts = [profile.bottom_k(df.where(F.col("k") % 2 == r), F.col("k"), 25, ["g"]) for r in (0, 1)]
    merged = profile.bottom_k(parts[0].unionByName(parts[1]), F.col("k"), 25, ["g"])
    assert sorted(map(tuple, merged.collect())) == want  # mergeable
    assert profile.bottom_k(df.limit(0), F.col("k"), 5, ["g"]).count() == 0
    few = profile.bottom_k(df.where("k < 4"), F.col("k"), 25, ["g"])
    assert few.count() == 4
    assert "WindowGroupLimit" in profile.bottom_k(df, F.col("k"), 5, ["g"])._jdf.queryExecution().executedPlan().toString()


def test_every_pair_is_in_the_wide_row(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    wide, labels = extract.page_details_columns(pages, 4)
    assert wide.columns == ["page_id", "detail_1", "detail_2", "detail_3", "detail_4", "rest"] and len(labels) == 4
    got = set()
    for r in wide.collect():
        own = [(lab, r[f"detail_{k + 1}"]) for k, lab in enumerate(labels) if r[f"detail_{k + 1}"] is not None]
        assert not set(labels) & set(r.rest)
        got |= {(r.page_id, *p) for p in own + list(r.rest.items())}
    assert got == {tuple(r) for r in extract.page_details_long(pages).collect()} and wide.count() == pages.count()
    none, no_labels = extract.page_details_columns(pages.select("page_id", F.lit("<p></p>").alias("html")), 2)
    assert no_labels == [] and {(r.detail_1, r.detail_2, len(r.rest)) for r in none.collect()} == {(None, None, 0)}
