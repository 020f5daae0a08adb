"""Fused profiling: each function is one (or a fixed few) distributed pass(es).

The notebook pulls whole columns to pandas for its charts; here the numbers
behind each chart are computed in Spark and come back as small DataFrames
(bins, five-number rows, per-column counts), so nothing grows on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.parse import unparseable
from hearth.session import stage_observed
from hearth.operators.quantiles import approx_quantiles, cached_values, exact_quantiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: per column, the number of nulls (one pass)."""
    cols = columns or df.columns
    return df.agg(*[F.count_if(F.isnull(c)).alias(c) for c in cols])


def missing_counts_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing_count) rows: the one-row count, unpivoted in Spark."""
    cols = columns or df.columns
    wide = missing_counts(df, cols)
    return wide.unpivot([], cols, "column", "missing_count")


def missing_profile(df: DataFrame, parsed: dict | None = None) -> DataFrame:
    """(column, null_count, nan_count, unparseable_count), one pass.

    ``parsed`` maps a text column to the Column that parses it; a present,
    non-blank text whose parse is null counts as unparseable
    (``'negotiable'``, ``'6+'``).  NaN is counted for floating columns.
    """
    parsed = parsed or {}
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    aggs, names = [], []
    for c in df.columns:
        col = F.col(c)
        nan = (F.sum(F.isnan(col).cast("int")) if isinstance(types[c], _FLOATING)
               else F.lit(0))
        if c in parsed:
            unp = F.count_if(unparseable(col.cast("string"), parsed[c]))
        else:
            unp = F.lit(0)
        aggs.append(F.struct(F.lit(c).alias("column"),
                             F.count_if(F.isnull(col)).alias("null_count"),
                             F.coalesce(nan.cast("bigint"), F.lit(0).cast("bigint")).alias("nan_count"),
                             F.coalesce(unp.cast("bigint"), F.lit(0).cast("bigint")).alias("unparseable_count")))
        names.append(c)
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def profile_while_staging(df: DataFrame, name: str, numeric: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` staged, and its profile collected by that write: one row per column
    with (column, n_rows, missing_count, count, mean, stddev, min, max); the
    last five for ``numeric`` columns only.

    What leaves the executors is one row of aggregates per task."""
    cols = df.columns
    numeric = [c for c in (numeric or []) if c in cols]
    metrics = {"rows": F.count(F.lit(1))}
    for k, c in enumerate(cols):
        metrics[f"missing{k}"] = F.count_if(F.col(f"`{c}`").isNull())
        if c in numeric:
            x = F.col(f"`{c}`").cast("double")
            metrics |= {f"count{k}": F.count(x), f"mean{k}": F.avg(x), f"stddev{k}": F.stddev_samp(x), f"min{k}": F.min(x), f"max{k}": F.max(x)}
    staged, seen = stage_observed(df, name, metrics)
    rows = [(c, seen["rows"], seen[f"missing{k}"], *(seen.get(f"{m}{k}") for m in ("count", "mean", "stddev", "min", "max"))) for k, c in enumerate(cols)]
    schema = "column string, n_rows bigint, missing_count bigint, count bigint, mean double, stddev double, min double, max double"
    return staged, df.sparkSession.createDataFrame(rows, schema)


def bottom_k(df: DataFrame, key: Column, k: int, strata: list[str]) -> DataFrame:
    """A repeatable sample: the ``k`` rows of each stratum with the smallest
    md5 of ``key`` (all, if fewer).

    The same rows under any partitioning, and mergeable: the bottom k of the
    bottom k of parts.  Each task drops all but its own k per stratum before the
    shuffle.  Rows of equal keys are ordered by all their columns."""
    names = df.columns
    order = [F.col("_md5"), *[F.col(f"`{c}`") for c in names]]
    ranked = df.withColumn("_md5", F.md5(key.cast("string")))
    ranked = ranked.withColumn("_at", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return ranked.where(F.col("_at") <= k).select(*[F.col(f"`{c}`") for c in names])


def row_count_sql(df: DataFrame, view: str = "listings") -> DataFrame:
    """Register ``df`` as a view and count it with SQL (one row: n_rows)."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"SELECT COUNT(*) AS n_rows FROM {view}")


def duplicate_report(df: DataFrame) -> DataFrame:
    """(total_rows, unique_rows, duplicate_rows) in one aggregation job.

    ``groupBy(all columns).count()`` collapses copies map-side (partial
    aggregation), so a row copied a billion times costs one shuffle record
    per map task, not a billion.
    """
    per_row = df.groupBy(*df.columns).count()
    return per_row.agg(
        F.sum("count").cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_rows"))


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row dedup (``SELECT DISTINCT *``)."""
    return df.dropDuplicates()


def group_count(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def summary_stats(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Long-form describe(): (column, count, mean, stddev, min, max), one pass, typed."""
    structs = []
    for c in columns:
        x = F.col(c).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column"),
            F.count(x).alias("count"),
            F.round(F.avg(x), digits).alias("mean"),
            F.round(F.stddev_samp(x), digits).alias("stddev"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ))
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a"))


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value, smallest on ties (one row: mode, mode_count).

    A distributed group-count followed by a top-1: each partition keeps its
    best candidate, so no value->count map of the whole column is built in
    one place (unlike the ``mode`` aggregate).
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("mode_count"))
    # Null sorts last instead of being filtered out (a filter here would be
    # pushed below the aggregate and re-evaluate a computed column).
    return (counts.orderBy(F.col(col).isNull(), F.col("mode_count").desc(), F.col(col).asc()).limit(1)
                  .select(F.col(col).alias("mode"), "mode_count"))


def central_tendency(df: DataFrame, col: str, exact: bool = True,
                     median_error: float = 0.01, digits: int = 4) -> DataFrame:
    """One row: mean, median, mode (the numbers drawn on the price histogram).

    The value column is persisted once and shared by the three statistics.
    """
    with cached_values(df, col) as x:
        mean = x.agg(F.avg("x").alias("m")).first()["m"]
        if exact:
            median = exact_quantiles(x, "x", [0.5], persist=False)[0]
        else:
            median = approx_quantiles(x, "x", [0.5], median_error)[0]
        top = mode_value(x, "x").first()
    mode = None if top is None or top["mode"] is None else float(top["mode"])
    spark = df.sparkSession
    one = spark.createDataFrame([(mean, median, mode)], "mean double, median double, mode double")
    return one.select(*[F.round(c, digits).alias(c) for c in ("mean", "median", "mode")])


def _finite(col: str) -> Column:
    x = F.col(col)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _bin_of(col: str, lo: float, hi: float, bins: int) -> Column:
    """1..bins for the finite values between ``lo`` and ``hi``, else null.  Halves
    keep the width of an extreme range finite."""
    at = (_finite(col) / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * F.lit(bins)
    return F.when(_finite(col).isNotNull(), F.least(F.floor(at), F.lit(bins - 1)) + 1).cast("int")  # least() skips nulls


def histogram(df: DataFrame, col: str, bins: int = 50, digits: int = 6, persist: bool = True) -> DataFrame:
    """Equal-width histogram (bin, bin_lower, bin_upper, n), empty bins included.

    Bins are numpy-style: ``bins`` equal widths between min and max, the
    last one closed on the right.  The range is one aggregate (two numbers
    to the driver), the counts one group-by with at most ``bins`` groups.
    Nulls, NaN and infinities are in no bin.
    ``persist=False`` for a stored column, which is cheaper to scan twice.
    """
    spark = df.sparkSession
    with cached_values(df, col, persist) as x:
        st = x.agg(F.min(_finite("x")).alias("mn"), F.max(_finite("x")).alias("mx")).first()
        mn, mx = st["mn"], st["mx"]
        n: dict[int, int] = {}
        if mn is not None:
            mn, mx = (mn - 0.5, mx + 0.5) if mx == mn else (mn, mx)
            # at most bins + 1 rows; null is the bin of everything that is in none
            n = {r["bin"]: r["n"] for r in x.groupBy(_bin_of("x", mn, mx, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    edge = lambda k: None if mn is None else round(mn + k * (mx / bins - mn / bins), digits)
    rows = [(b, edge(b - 1), edge(b), n.get(b, 0)) for b in range(1, bins + 1)]
    return spark.createDataFrame(rows, "bin int, bin_lower double, bin_upper double, n bigint").coalesce(1)


def boxplot_stats(df: DataFrame, col: str, label: str = "all", digits: int = 4,
                  persist: bool = True) -> DataFrame:
    """Five-number summary as a box plot draws it (numpy-linear quartiles,
    whiskers at the furthest data within 1.5 IQR, flier count)."""
    q1, med, q3 = exact_quantiles(df, col, [0.25, 0.5, 0.75], persist=persist)
    spark = df.sparkSession
    schema = ("series string, n bigint, q1 double, median double, q3 double, iqr double, "
              "whisker_low double, whisker_high double, n_fliers bigint")
    if q1 is None:
        return spark.createDataFrame([(label, 0, None, None, None, None, None, None, 0)], schema)
    iqr = q3 - q1
    lf, uf = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    x = F.col(col).cast("double")
    row = df.agg(
        F.count(x).alias("n"),
        F.min(F.when(x >= lf, x)).alias("wl"),
        F.max(F.when(x <= uf, x)).alias("wh"),
        F.sum(((x < lf) | (x > uf)).cast("int")).cast("bigint").alias("nf"),
    ).first()
    f = lambda v: None if v is None else float(v)
    one = spark.createDataFrame(
        [(label, row["n"], q1, med, q3, iqr, f(row["wl"]), f(row["wh"]), row["nf"])], schema)
    return one.select("series", "n", *[F.round(c, digits).alias(c) for c in
                                       ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")],
                      "n_fliers")


def boxplot_with_and_without_outliers(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """Box-plot rows for the series and for the series after the exact IQR
    cut (the notebook's side-by-side box plots), from one cached column."""
    from hearth.operators.outliers import IQR_FACTOR
    with cached_values(df, col) as x:
        q1, q3 = exact_quantiles(x, "x", [0.25, 0.75], persist=False)
        allb = boxplot_stats(x, "x", "with_outliers", digits, persist=False)
        if q1 is None:
            kept = x.select(F.lit(None).cast("double").alias("x"))
        else:
            lo, hi = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
            kept = x.select(F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.col("x")).alias("x"))
        keptb = boxplot_stats(kept, "x", "without_outliers", digits, persist=False)
        rows = allb.collect() + keptb.collect()
    return df.sparkSession.createDataFrame(rows, allb.schema)


def binned_pairs(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """2-D equal-width bins of (x, y) with counts: the data behind an
    actual-vs-predicted scatter, bounded by ``bins * bins`` rows however
    many points there are.  Rows with a null, NaN or infinity in either column
    are dropped."""
    spark, schema = df.sparkSession, "x_bin int, y_bin int, n bigint"
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).persist()
    try:
        st = pairs.agg(F.min(_finite("x")).alias("x0"), F.max(_finite("x")).alias("x1"),
                       F.min(_finite("y")).alias("y0"), F.max(_finite("y")).alias("y1")).first()
        if st["x0"] is None or st["y0"] is None:
            return spark.createDataFrame([], schema)

        def bin_of(c, lo, hi):
            lo, hi = float(lo), float(hi)
            if hi == lo:
                lo, hi = lo - 0.5, hi + 0.5
            return _bin_of(c, lo, hi, bins)

        b = pairs.select(bin_of("x", st["x0"], st["x1"]).alias("x_bin"), bin_of("y", st["y0"], st["y1"]).alias("y_bin"))
        rows = b.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")).collect()  # <= (bins + 1) ** 2 rows
    finally:
        pairs.unpersist()
    return spark.createDataFrame([r for r in rows if r["x_bin"] is not None and r["y_bin"] is not None], schema)


def text_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, min, max) of text columns, as ``describe`` gives them (one pass)."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max")) for c in cols]
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a"))
