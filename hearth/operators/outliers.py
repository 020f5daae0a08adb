"""Interquartile-range outlier cut.

The bounds are two numbers, so they come back to the driver (as the
notebook's eager ``approxQuantile`` does) and return to the plan as
literals: the kept/outlier filters stay inside whole-stage codegen, need
no join, and a filter on a stored column still reaches the scan.
Rows with a null value are in neither set (three-valued logic).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.operators.quantiles import quantiles

# Fixed values of the notebook: Tukey's fences and the sketch error.
IQR_FACTOR = 1.5
QUARTILE_ERROR = 0.05


@dataclass(frozen=True)
class IqrBounds:
    q1: float | None
    q3: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - IQR_FACTOR * self.iqr

    @property
    def upper(self) -> float | None:
        return None if self.q3 is None else self.q3 + IQR_FACTOR * self.iqr


def iqr_bounds(df: DataFrame, col: str, relative_error: float | None = QUARTILE_ERROR) -> IqrBounds:
    """Quartiles and fences; ``relative_error=None`` for exact quartiles.

    An all-null column gives null bounds instead of failing.
    """
    q1, q3 = quantiles(df, col, [0.25, 0.75], relative_error)
    return IqrBounds(q1, q3)


def bounds_frame(df: DataFrame, col: str, relative_error: float | None = QUARTILE_ERROR) -> DataFrame:
    """The bounds as a one-row DataFrame (q1, q3, iqr, lower_bound, upper_bound)."""
    b = iqr_bounds(df, col, relative_error)
    spark = df.sparkSession
    return spark.createDataFrame(
        [(b.q1, b.q3, b.iqr, b.lower, b.upper)],
        "q1 double, q3 double, iqr double, lower_bound double, upper_bound double")


def keep_condition(col: str, b: IqrBounds):
    if b.lower is None:
        return F.lit(False)
    return (F.col(col) >= F.lit(b.lower)) & (F.col(col) <= F.lit(b.upper))


def outlier_condition(col: str, b: IqrBounds):
    if b.lower is None:
        return F.lit(False)
    return (F.col(col) < F.lit(b.lower)) | (F.col(col) > F.lit(b.upper))


def split_outliers(df: DataFrame, col: str, relative_error: float | None = QUARTILE_ERROR,
                   bounds: IqrBounds | None = None) -> tuple[DataFrame, DataFrame, IqrBounds]:
    """(kept, outliers, bounds)."""
    b = bounds or iqr_bounds(df, col, relative_error)
    return df.where(keep_condition(col, b)), df.where(outlier_condition(col, b)), b


def remove_outliers(df: DataFrame, col: str, relative_error: float | None = QUARTILE_ERROR) -> DataFrame:
    return split_outliers(df, col, relative_error)[0]
