"""Listing drops as streams: scoring with a saved model, and dedup across drops.

A drop is a set of files that arrives in a folder.  Each function here takes
the streaming DataFrame of ``listing_stream`` and a checkpoint; run again with
the same checkpoint it takes up where it ended, and every drop counts once.

* ``append_available`` -- the sink: everything that has arrived is processed
  and appended as Parquet.  The folder's own log names the files of finished
  batches only, so a batch that is repeated after a failure is read once.
* ``scored`` -- a loaded ``PipelineModel`` over arriving listings.  Its
  transformers work row by row, its category tables are fixed: no state.
* ``new_rows`` -- rows not seen in this or an earlier drop.  The state is one
  16-byte digest per distinct row; with an event time and a delay it is
  bounded by the rows of that time.
* ``row_counter`` -- all rows so far; with ``new_rows`` the running duplicate
  report.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keeps large state outside the JVM heap (executors' local disks, with snapshots in the checkpoint).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_available(rows: DataFrame, out_dir: str, checkpoint_dir: str) -> None:
    """Process what has arrived and append it to ``out_dir``."""
    query = (rows.writeStream.format("parquet").outputMode("append").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    query.awaitTermination()


def scored(stream: DataFrame, model: PipelineModel, keep: list[str], prediction: str = "prediction") -> DataFrame:
    """``keep`` columns and the prediction (null where a feature is missing) of each listing."""
    out = model.transform(stream)
    value = F.col(prediction)
    return out.select(*keep, F.when(~F.isnan(value), value).alias(prediction))


def row_digest(df: DataFrame) -> Column:
    """128 bits over all columns; a null differs from every value, and no two
    different rows give the same text."""
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-"))
             for t in (F.col(f"`{f.name}`").cast("string") for f in df.schema.fields)]
    return F.unhex(F.md5(F.concat_ws(",", *cells)))


def new_rows(stream: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows that no earlier row of the stream equals, each once.

    Without ``event_time`` the state grows with the distinct rows.  With it,
    copies that come within ``delay`` of each other are recognised, and older
    digests are forgotten."""
    names = stream.columns
    keyed = stream.withColumn("_row", row_digest(stream))
    if event_time is None:
        return keyed.dropDuplicates(["_row"]).select(*[F.col(f"`{c}`") for c in names])
    if delay is None:
        raise ValueError("an event time needs a delay")
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_row"]).select(*[F.col(f"`{c}`") for c in names])


def row_counter(stream: DataFrame) -> DataFrame:
    """One row: all rows so far."""
    return stream.groupBy().agg(F.count(F.lit(1)).alias("total_rows"))


def duplicate_report(spark: SparkSession, counted_dir: str, unique_dir: str) -> DataFrame:
    """(total_rows, unique_rows, duplicate_rows) after the last drop, from the
    counter's last epoch and the appended new rows (their footers only)."""
    unique = spark.read.parquet(unique_dir).agg(F.count(F.lit(1)).alias("unique_rows"))
    total = spark.read.parquet(counted_dir).select("total_rows")
    both = total.unionByName(unique, allowMissingColumns=True).agg(F.max("total_rows").alias("total_rows"), F.max("unique_rows").alias("unique_rows"))
    return both.withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_rows"))
