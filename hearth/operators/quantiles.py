"""Quantiles of a numeric column, approximate and exact.

* ``approx_quantiles`` is Spark's ``approxQuantile`` (a mergeable
  Greenwald-Khanna sketch): one pass, bounded memory, rank error
  ``relative_error * n``.  This is what the notebook uses (0.05 for the
  quartiles, 0.01 for the median).
* ``exact_quantiles`` gives the linearly interpolated quantile
  (``percentile`` / DuckDB ``quantile_cont``) without ever gathering the
  column, or its distinct values, in one task or on the driver.  Spark's
  own exact ``percentile`` keeps a value->count map of the whole group in
  one aggregation buffer, and ``approxQuantile(..., 0.0)`` ships every
  value to the driver; neither survives a 100 TB column.

  Instead each order statistic is found by histogram refinement: a pass
  buckets the values inside the current window into ``bins`` equal-width
  buckets (a distributed group-count whose result has at most
  ``bins`` rows per searched rank), the bucket holding the wanted rank
  becomes the next window (bounded by its real min and max), and the loop
  ends when the window holds one distinct value.  Floating-point bucketing is
  monotone in the value, so a bucket is always a contiguous run of the sorted
  column and the counts are exact.  A window's smallest and largest value fall
  into different buckets, so every pass shrinks it; infinities are counted
  apart and never bucketed.  The route is the same for every table size.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BINS = 4096


def _clean(df: DataFrame, col: str | Column) -> DataFrame:
    """One double column ``x``; NaN becomes null.

    Deliberately a projection, not a filter: Catalyst pushes a filter on a
    computed column through the projections below it and inlines the whole
    expression (a parsed price, say) into the scan-side filter, evaluating
    it several times per row.  Nulls are skipped by the aggregates instead.
    """
    c = F.col(col) if isinstance(col, str) else col
    x = c.cast("double")
    return df.select(F.when(~F.isnan(x), x).alias("x"))


@contextmanager
def cached_values(df: DataFrame, col: str | Column, persist: bool = True):
    """Persist just the value column (as double ``x``, NaN -> null) for the
    duration of several passes: bounds, quantiles and aggregates of one
    series then share a single evaluation of the plan that produces it."""
    x = _clean(df, col)
    if persist:
        x = x.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield x
    finally:
        if persist:
            x.unpersist()


def approx_quantiles(df: DataFrame, col: str, probs: list[float],
                     relative_error: float = 0.05) -> list[float | None]:
    """Spark's sketch quantiles; ``None`` for each prob if the column is all null."""
    got = df.approxQuantile(col, list(probs), relative_error)
    if not got:
        return [None] * len(probs)
    return [float(v) for v in got]


def _bucket(a: float, b: float, bins: int) -> Column:
    """0..bins-1 for values of [a, b]; halves where the span itself overflows."""
    if b <= a:
        return F.lit(0)
    scale = 1.0 if math.isfinite(b - a) else 0.5
    share = (F.col("x") * scale - F.lit(a * scale)) / F.lit(b * scale - a * scale)
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def _order_statistics(x: DataFrame, ranks: list[int], lo: float, hi: float, bins: int) -> dict[int, float]:
    """Exact 0-based order statistics of the finite values of ``x``."""
    # rank -> (window low, window high, number of values below the window)
    windows = {r: (lo, hi, 0) for r in ranks}
    found: dict[int, float] = {}
    while windows:
        # Ranks that share a window share one histogram.
        groups: dict[tuple[float, float, int], list[int]] = {}
        for r, w in windows.items():
            groups.setdefault(w, []).append(r)
        keys = list(groups)
        tagged = []
        for gid, (a, b, _) in enumerate(keys):
            inside = (F.col("x") >= a) & (F.col("x") <= b)
            tagged.append(F.when(inside, F.struct(F.lit(gid).alias("g"), _bucket(a, b, bins).alias("b"))))
        hist = (x.select("x", F.explode(F.filter(F.array(*tagged), lambda s: s.isNotNull())).alias("t"))
                 .groupBy(F.col("t.g").alias("g"), F.col("t.b").alias("b"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                 .collect())
        by_group: dict[int, list] = {}
        for row in hist:
            by_group.setdefault(row["g"], []).append(row)
        next_windows: dict[int, tuple[float, float, int]] = {}
        for gid, key in enumerate(keys):
            _, _, below = key
            buckets = sorted(by_group.get(gid, []), key=lambda r: r["b"])
            for r in groups[key]:
                seen = below
                for bk in buckets:
                    if seen + bk["n"] > r:
                        if bk["mn"] == bk["mx"]:
                            found[r] = float(bk["mn"])
                        else:
                            next_windows[r] = (bk["mn"], bk["mx"], seen)
                        break
                    seen += bk["n"]
                else:  # pragma: no cover - counts are exact, so unreachable
                    raise RuntimeError(f"rank {r} not found in histogram")
                if next_windows.get(r) == key:
                    raise RuntimeError(f"the window {key} of rank {r} does not shrink")
        windows = next_windows
    return found


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation that survives equal infinities and overflowing spans."""
    if share == 0 or a == b:
        return a
    return a + share * (b - a) if math.isfinite(b - a) else a * (1 - share) + b * share


def exact_quantiles(df: DataFrame, col: str | Column, probs: list[float],
                    bins: int = DEFAULT_BINS, persist: bool = True) -> list[float | None]:
    """Linearly interpolated quantiles (``quantile_cont``) of non-null values."""
    x = _clean(df, col)
    if persist:
        x = x.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        finite = F.when(F.abs("x") < F.lit(math.inf), F.col("x"))
        st = x.agg(F.count("x").alias("n"), F.count_if(F.col("x") == F.lit(-math.inf)).alias("below"),
                   F.count(finite).alias("finite"), F.min(finite).alias("mn"), F.max(finite).alias("mx")).first()
        n, below, count = st["n"], st["below"], st["finite"]
        if not n:
            return [None] * len(probs)
        positions = []
        ranks: set[int] = set()
        for p in probs:
            if not 0.0 <= p <= 1.0:
                raise ValueError(f"probability out of range: {p}")
            h = (n - 1) * p
            lo_r = int(math.floor(h))
            hi_r = min(lo_r + 1, n - 1)
            positions.append((h, lo_r, hi_r))
            ranks.update((lo_r, hi_r))
        stats = {r: -math.inf if r < below else math.inf for r in ranks}
        wanted = sorted(r - below for r in ranks if below <= r < below + count)
        if wanted:
            inside = _order_statistics(x, wanted, float(st["mn"]), float(st["mx"]), bins)
            stats.update({r + below: v for r, v in inside.items()})
        return [_between(stats[lo_r], stats[hi_r], h - lo_r) for h, lo_r, hi_r in positions]
    finally:
        if persist:
            x.unpersist()


def quantiles(df: DataFrame, col: str, probs: list[float],
              relative_error: float | None = 0.05) -> list[float | None]:
    """``relative_error=None`` (or 0) -> exact; otherwise the sketch."""
    if not relative_error:
        return exact_quantiles(df, col, probs)
    return approx_quantiles(df, col, probs, relative_error)
