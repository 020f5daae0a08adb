"""Feature engineering: category indices, vectors, expansion, scaling, splits.

Built on Spark ML stages (``StringIndexer``, ``VectorAssembler``,
``PolynomialExpansion``, ``StandardScaler``, ``Pipeline``).  Two additions:

* ``FrequencyIndex`` -- the same index ``StringIndexer`` assigns (frequency
  descending, ties by label) for columns with any number of labels, such as a
  street address.  ``StringIndexer.fit`` collects every label to the driver
  and broadcasts the label array back; with one label per row that is the
  whole column on the driver.  Here the labels of all columns are counted,
  range-sorted and numbered in one distributed pass, and the fitted
  label->index tables are joined to whatever is transformed; the optimizer
  picks the join by their size.  One route for every column and size.
* ``hash_split`` / ``hash_folds`` -- repeatable train/test splits and CV
  folds from a hash of a key, independent of partitioning (``randomSplit``
  draws per partition, so the same rows and seed give different splits when
  the partitioning changes).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import stage

def string_indexer(columns: list[str] | tuple[str, ...], suffix: str = "_indexed",
                   handle_invalid: str = "keep") -> StringIndexer:
    """One multi-column ``StringIndexer`` (one counting pass for all columns)."""
    return StringIndexer(inputCols=list(columns), outputCols=[c + suffix for c in columns],
                         handleInvalid=handle_invalid, stringOrderType="frequencyDesc")


# Partitions over which the null rows of a join are spread.
NULL_SPREAD = 1024
# A column's label table is broadcast only if its labels, counted at the fit, stay under so many bytes.
BROADCAST_LABELS = 32 << 20


@dataclass
class FrequencyIndex:
    """Fitted indices: ``labels`` has (column, label, idx), ``sizes`` the number of
    labels and ``weights`` their bytes per column.

    Columns whose labels are few (by ``weights``) are looked up without moving
    a row; only the others cost a shuffle join each.

    ``transform`` works on any later batch.  ``handle_invalid`` treats nulls and
    labels that were not seen at the fit alike: ``keep`` gives them index =
    number of labels, ``skip`` drops their rows, ``error`` raises.
    """

    labels: DataFrame
    sizes: dict[str, int]
    weights: dict[str, int]
    suffix: str
    handle_invalid: str

    def transform(self, df: DataFrame, out_cols: dict[str, str] | None = None) -> DataFrame:
        """``df`` with one index column per fitted column after its own columns."""
        names = df.columns
        out = df
        for col in self.sizes:
            out = self._joined(out, col, (out_cols or {}).get(col, col + self.suffix))
        return out.select(*names, *[c for c in out.columns if c not in names])

    def _joined(self, df: DataFrame, col: str, out_col: str) -> DataFrame:
        table = self.labels.where(F.col("column") == col).select(
            F.col("label").alias("_label"), F.col("idx").alias("_idx"), F.lit(None).cast("bigint").alias("_none"))
        if self.weights[col] <= BROADCAST_LABELS:
            rows = df.join(F.broadcast(table.drop("_none")), F.col(col).cast("string") == F.col("_label"), "left")
        else:
            # Nulls match nothing; a second key deals them out instead of hashing
            # them all to one partition.
            spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != col], F.spark_partition_id()), F.lit(NULL_SPREAD))
            rows = df.withColumn("_null", F.when(F.col(col).isNull(), spread))
            rows = rows.join(table, (F.col(col).cast("string") == F.col("_label")) & F.col("_null").eqNullSafe(F.col("_none")), "left")
        if self.handle_invalid == "skip":
            rows = rows.where(F.col("_idx").isNotNull())
            other = F.lit(None).cast("double")
        elif self.handle_invalid == "error":
            other = F.raise_error(F.concat(F.lit(f"no index of {col} for: "), F.coalesce(F.col(col).cast("string"), F.lit("null")))).cast("double")
        else:
            other = F.lit(float(self.sizes[col]))
        return rows.withColumn(out_col, F.coalesce(F.col("_idx"), other)).drop("_null", "_label", "_idx", "_none")

    def save(self, path: str) -> None:
        """The labels as Parquet (partitioned by column), the rest as one JSON row."""
        spark = self.labels.sparkSession
        self.labels.write.mode("overwrite").partitionBy("column").parquet(f"{path}/labels")
        head = json.dumps({"sizes": self.sizes, "weights": self.weights, "suffix": self.suffix, "handle_invalid": self.handle_invalid})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FrequencyIndex:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        schema = "label string, idx double, column string"
        return FrequencyIndex(spark.read.schema(schema).parquet(f"{path}/labels"), **head)


def fit_index(df: DataFrame, columns: list[str] | tuple[str, ...], suffix: str = "_index",
              handle_invalid: str = "keep", partitions: int | None = None) -> FrequencyIndex:
    """Counts the labels of all columns in one pass and numbers them.

    ``error`` raises here if the fitted rows hold a null, as ``StringIndexer`` does.
    """
    if handle_invalid not in ("keep", "skip", "error"):
        raise ValueError(f"unknown handle_invalid: {handle_invalid}")
    spark = df.sparkSession
    cols = list(columns)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("string").alias("label")) for k, c in enumerate(cols)]))
    counts = df.select(cells.alias("x")).groupBy("x.c", "x.label").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("c"), F.col("n").desc(), F.col("label").asc_nulls_last()]
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range-partition by the index order (partition p holds a contiguous run
    # of it) and sort inside each partition; then a row's position in its
    # partition is the low 33 bits of monotonically_increasing_id().  No
    # window, no second shuffle.  Written once, so that the numbering cannot
    # change between its uses.
    ranged = stage(counts.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
                   .select("c", "label", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid")), "index-order")
    # <= n_parts + columns rows: a column's labels fill a contiguous run of partitions
    cells_of = (ranged.groupBy("pid", "c").agg(F.count("label").alias("n"), F.min("mid").alias("first"), F.sum(F.octet_length("label") + 16).alias("bytes"),
                                               F.count_if(F.col("label").isNull()).alias("nulls")).collect())
    sizes, weights = {c: 0 for c in cols}, {c: 0 for c in cols}
    offsets = []
    for row in sorted(cells_of, key=lambda r: (r["c"], r["pid"])):
        if handle_invalid == "error" and row["nulls"]:
            raise ValueError(f"column {cols[row['c']]!r} has null values (handle_invalid='error')")
        offsets.append((row["pid"], row["c"], cols[row["c"]], sizes[cols[row["c"]]] - row["first"]))
        sizes[cols[row["c"]]] += row["n"]
        weights[cols[row["c"]]] += row["bytes"] or 0
    at = spark.createDataFrame(offsets, "pid int, c int, column string, shift bigint")
    labels = ranged.where(F.col("label").isNotNull()).join(F.broadcast(at), ["pid", "c"]).select(  # <= n_parts + columns rows
        "column", "label", (F.col("mid") + F.col("shift")).cast("double").alias("idx"))
    return FrequencyIndex(labels, sizes, weights, suffix, handle_invalid)


def frequency_index(df: DataFrame, col: str, out_col: str | None = None,
                    handle_invalid: str = "keep", partitions: int | None = None) -> DataFrame:
    """Fits the index of one column and applies it to the same rows."""
    model = fit_index(df, [col], handle_invalid=handle_invalid, partitions=partitions)
    return model.transform(df, {col: out_col or f"{col}_index"})


def index_columns(df: DataFrame, columns: list[str] | tuple[str, ...], suffix: str = "_index",
                  handle_invalid: str = "keep") -> DataFrame:
    """Fits the indices of several columns in one pass and applies them to the same rows."""
    return fit_index(df, columns, suffix, handle_invalid).transform(df)


def assembler(columns: list[str] | tuple[str, ...], out_col: str = "features",
              handle_invalid: str = "keep") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out_col, handleInvalid=handle_invalid)


def cast_double(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Cast the feature columns to double in one projection (before assembling)."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def poly_expansion(in_col: str = "features", out_col: str = "poly_features",
                   degree: int = 2) -> PolynomialExpansion:
    return PolynomialExpansion(degree=degree, inputCol=in_col, outputCol=out_col)


def scaler(in_col: str = "poly_features", out_col: str = "scaled_features",
           with_mean: bool = False, with_std: bool = True) -> StandardScaler:
    return StandardScaler(inputCol=in_col, outputCol=out_col, withMean=with_mean, withStd=with_std)


def vector_columns(vec: str, n: int, prefix: str, digits: int | None = 6) -> list[Column]:
    """Unpack a vector column to ``prefix0..prefix{n-1}`` doubles (for checks).

    Prefer ``unpack_vector`` for many elements: it converts once per row.
    """
    arr = vector_to_array(F.col(vec))
    cols = []
    for i in range(n):
        e = arr[i]
        if digits is not None:
            e = F.round(e, digits)
        cols.append(e.alias(f"{prefix}{i}"))
    return cols


def unpack_vector(df: DataFrame, keep: list[str], vec: str, n: int, prefix: str,
                  digits: int | None = 6) -> DataFrame:
    """``keep`` columns plus the vector's elements, converting the vector to
    an array once per row (the array column is referenced n times, so the
    optimizer keeps it as one projection instead of n conversions)."""
    a = df.select(*keep, vector_to_array(F.col(vec)).alias("_arr"))
    out = []
    for i in range(n):
        e = F.col("_arr")[i]
        out.append((F.round(e, digits) if digits is not None else e).alias(f"{prefix}{i}"))
    return a.select(*keep, *out)


def hash_bucket(key: Column | str, buckets: int = 100) -> Column:
    """0..buckets-1 from the first 32 bits of md5(key): stable across runs,
    engines and partitionings."""
    k = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_split(df: DataFrame, key: Column | str, train_pct: int = 80,
               salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash bucket of ``key`` (``salt`` gives another split)."""
    k = F.col(key) if isinstance(key, str) else key
    b = hash_bucket(F.concat(F.lit(salt), k.cast("string")) if salt else k)
    return df.where(b < train_pct), df.where(b >= train_pct)


def hash_folds(df: DataFrame, key: Column | str, folds: int = 5, col: str = "fold") -> DataFrame:
    """Add an integer fold column 0..folds-1 (for ``CrossValidator(foldCol=...)``)."""
    k = F.col(key) if isinstance(key, str) else key
    return df.withColumn(col, hash_bucket(F.concat(F.lit("fold:"), k.cast("string")), folds))


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 1234):
    """The notebook's ``randomSplit`` (depends on partitioning; see hash_split)."""
    return df.randomSplit(list(weights), seed=seed)


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
