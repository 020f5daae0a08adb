"""Delimited-file sources and sinks for listing tables.

The notebook reads its CSV with ``inferSchema`` (an extra full pass, and a
column with one bad value silently becomes a string).  Here a CSV is read
schema-first: the header gives the column names (all text, no inference
pass), names are normalised to snake_case ('Floor Area' -> 'floor_area'),
and each column is converted to its declared type with ``try_cast`` so a
bad value becomes null instead of failing under ANSI casts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.sources.listings import RAW_SCHEMA, snake_case

#: What the parser makes of an empty unquoted field; a quoted one stays an empty text.
NO_VALUE = "\u0001"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
             sep: str = ",", header: bool = True, infer_schema: bool = False,
             multi_line: bool = False) -> DataFrame:
    """Read delimited text into ``schema`` (by header name, any column order).

    A quote inside a quoted field is doubled.  ``multi_line`` allows line
    breaks inside quoted fields, at the price that a file is no longer split.
    """
    reader = (spark.read.option("header", header).option("sep", sep).option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"').option("nullValue", NO_VALUE))
    if infer_schema:
        df = reader.option("inferSchema", True).csv(path)
        return df.toDF(*[snake_case(c) for c in df.columns])
    text = reader.csv(path)   # every column as string; the header names them
    text = text.toDF(*[snake_case(c) for c in text.columns])
    cols = []
    for f in schema.fields:
        if f.name in text.columns:
            c = F.col(f.name)
            cols.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return text.select(*cols)


#: Column with the text of a malformed line (null for a sound one).
MALFORMED = "_malformed"


def read_csv_checked(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: str | None = None) -> DataFrame:
    """All lines as text ``columns``, and the whole line in ``_malformed`` where
    it has too few or too many fields.

    Such a line keeps the fields it has; none is dropped and none fails the job.
    ``header`` is the text of a line to leave out, blank lines are left out.
    Lines are parsed whole, so a line is judged the same whatever columns a query
    asks for (the file reader's parser reads only those).
    """
    fields = [*(f"`{c}` string" for c in columns), f"{MALFORMED} string"]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "sep": sep, "quote": '"', "escape": '"', "nullValue": NO_VALUE}
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header is not None:
        lines = lines.where(F.col("value") != header)
    return lines.select(F.from_csv("value", ", ".join(fields), options).alias("_row")).select("_row.*")


def fault_of(line: Column, columns: int, sep: str = ",") -> Column:
    """'short' or 'long' of a malformed line, by its number of fields (quoted ones read as the parser reads them)."""
    wide = ", ".join(f"f{k} string" for k in range(columns + 1))
    fields = F.from_csv(line, wide, {"sep": sep, "quote": '"', "escape": '"', "nullValue": NO_VALUE, "emptyValue": ""})
    return F.when(line.isNull(), F.lit(None)).when(fields[f"f{columns}"].isNotNull(), "long").otherwise("short")


def malformed_report(rows: DataFrame, columns: int, sep: str = ",") -> DataFrame:
    """(fault, n_lines): sound, short and long lines of ``read_csv_checked``, in one pass."""
    fault = F.coalesce(fault_of(F.col(MALFORMED), columns, sep), F.lit("sound"))
    return rows.groupBy(fault.alias("fault")).agg(F.count(F.lit(1)).alias("n_lines"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """Write with a header row; nulls as empty fields, empty texts as ``""``, text
    with ``sep``, quotes or line breaks quoted and its quotes doubled."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
       .option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for; the others stay as they are."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
