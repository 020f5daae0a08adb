"""Intermediate tables in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.session import scratch_path

#: A side is broadcast by hint only if its counted rows times its row bytes stay under this.
BROADCAST_BYTES = 32 << 20


#: For tables with large values: readers hold a row group at once, so these keep it small.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}


def materialise(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast of a *materialised* ``df`` if its counted size is under
    ``BROADCAST_BYTES``; otherwise leave the join to the optimizer (shuffle)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def small(df: DataFrame, size: Column) -> DataFrame:
    """The same for rows of varying size: ``size`` is a row's bytes."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df
