"""Quantiles over stored sketches: each drop is read once, ever.

A drop adds one KLL sketch of a value per group (a few kilobytes, whatever the
rows) and its moments to a store; quantiles, counts, means and IQR cuts over
any choice of drops merge the stored rows and scan no listing again.  The
sketches are Spark's own aggregates: partial sketches leave the map tasks, so
a hot group costs one sketch per task.

The store is partitioned by drop, and writing a drop again replaces it, so a
repeated job counts nothing twice.  Nulls and NaN stay out of the sketches; infinities are
counted, not sketched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accuracy parameter of a sketch; the rank error (of a merged one too) is about 1.3 % at 200.
K = 200
#: Rank error that holds with room for k = 200 (the documented bound is 1.65 % for a single query).
RANK_ERROR = 0.03


def add_drop(df: DataFrame, drop: int, groups: list[str], col: str, path: str, k: int = K) -> None:
    """Sketch the drop's ``col`` per group into the store (one pass, one shuffle of sketches)."""
    x = F.col(col).cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    rows = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(finite).alias("n"), F.count_if(F.abs(x) == float("inf")).alias("n_infinite"),
        F.sum(finite).alias("total"), F.min(finite).alias("least"), F.max(finite).alias("most"),
        F.kll_sketch_agg_double(finite, k).alias("sketch"))
    (rows.withColumn("drop", F.lit(drop)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("drop").parquet(path))


def stored(spark: SparkSession, path: str, drops: list[int] | None = None) -> DataFrame:
    """The store's rows; ``drops`` reads only their folders."""
    rows = spark.read.parquet(path)
    return rows if drops is None else rows.where(F.col("drop").isin(drops))


def merged(rows: DataFrame, groups: list[str]) -> DataFrame:
    """One sketch and the summed moments per group of ``groups`` (any subset of the store's)."""
    some = F.when(F.col("n") > 0, F.col("sketch"))
    return rows.groupBy(*groups).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("n_infinite").alias("n_infinite"),
        F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double(some).alias("sketch"))


def quantiles(rows: DataFrame, groups: list[str], probabilities: list[float]) -> DataFrame:
    """(groups, n, probability, value): estimated quantiles; null where a group has no value."""
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", asked))
    at = F.arrays_zip(asked.alias("probability"), F.coalesce(found, F.array_repeat(F.lit(None).cast("double"), len(probabilities))).alias("value"))
    return merged(rows, groups).select(*groups, "n", F.explode(at).alias("q")).select(*groups, "n", "q.probability", "q.value")


def iqr_bounds(rows: DataFrame, groups: list[str], factor: float = 1.5) -> DataFrame:
    """(groups, lower, upper) of the IQR cut from the stored sketches."""
    q = quantiles(rows, groups, [0.25, 0.75]).groupBy(*groups).agg(
        F.max(F.when(F.col("probability") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("probability") == 0.75, F.col("value"))).alias("q3"))
    room = factor * (F.col("q3") - F.col("q1"))
    return q.select(*groups, (F.col("q1") - room).alias("lower"), (F.col("q3") + room).alias("upper"))


def rank_errors(df: DataFrame, groups: list[str], col: str, estimates: DataFrame) -> DataFrame:
    """For one group column at least: (groups, n, probability, rank_error): how far each estimate's true rank lies
    from its probability, by one pass over the rows (a check, not a report).

    A value's copies span ranks; the error is the distance to that span."""
    asked = estimates.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("probability", "value"))).alias("_asked"))  # a few per group
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    x = F.col("_x")
    values = df.select(*groups, F.col(col).cast("double").alias("_x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    pairs = values.join(asked.select(*[F.col(g).alias(f"_{g}") for g in groups], "_asked"), on)
    below = F.transform("_asked", lambda q: F.when(x < q["value"], 1).otherwise(0))
    upto = F.transform("_asked", lambda q: F.when(x <= q["value"], 1).otherwise(0))
    n_asked = estimates.select("probability").distinct().count()  # the caller's few probabilities
    cells = pairs.select(*groups, F.col("_asked.probability").alias("_p"), below.alias("_below"), upto.alias("_upto"))
    counts = cells.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.first("_p").alias("_p"),
        *[F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("_below", "_upto") for k in range(n_asked)])
    each = F.array(*[F.struct(F.col("_p")[k].alias("probability"), F.col(f"_below{k}").alias("below"), F.col(f"_upto{k}").alias("upto")) for k in range(n_asked)])
    rows = counts.select(*groups, "n", F.explode(each).alias("c")).select(*groups, "n", "c.*")
    p = F.col("probability")
    off = F.greatest(F.col("below") / F.col("n") - p, p - F.col("upto") / F.col("n"), F.lit(0.0))
    return rows.select(*groups, "n", "probability", off.alias("rank_error"))
