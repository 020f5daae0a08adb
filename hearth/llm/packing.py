"""Packing into length buckets with the least padding.

The global histogram of lengths feeds a dynamic program that chooses the
bucket bounds; batches of at most ``budget`` padded tokens then form inside
each bucket.  A document longer than ``max_length`` is cut into pieces of
``max_length`` tokens and a rest, so the histogram has at most ``max_length``
bins, however large the corpus.

Defined results: a null or empty text has no token and no row; repeated rows
each get their pieces; rows of one bucket are ordered by the md5 of their id,
piece and length, rows equal in all of these are interchangeable; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm import _arrow as A
from hearth.llm._store import materialise

#: A token is a run of ASCII letters and digits, or any other non-space character.


@dataclass(frozen=True)
class PackRules:
    buckets: int = 8
    max_length: int = 2048
    budget: int = 16384
    #: Rows that one numbering task handles (memory bound, no influence on the result).
    cell_rows: int = 200_000


_ALNUM = A.lut(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n: the tokens of each text, counted on its bytes in one pass (no
    list of tokens is built): starts of runs, and characters that are no space."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for piece, data, offsets in A.slices(batch, "t"):
                starts, _, _, alnum = A.runs(data, offsets, _ALNUM)
                token = A.NOT_SPACE[data] & ~alnum & ((data & 0xC0) != 0x80)  # one for each code point
                token[starts] = True
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, piece.num_rows), pa.array(A.per_doc(token, offsets))], names=["doc_id", "n"])
                done += piece.num_rows

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType())]))


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds that minimise ``sum(count * (bound - length))`` with at most
    ``buckets`` buckets; of equal costs the smaller split points are taken."""
    d = len(lengths)
    if d == 0:
        return []
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    big = np.iinfo(np.int64).max // 4
    cost = np.full(d + 1, big, np.int64)
    cost[0] = 0
    back = np.zeros((buckets + 1, d + 1), np.int64)
    best = []
    for k in range(1, buckets + 1):
        new = np.full(d + 1, big, np.int64)
        for j in range(1, d + 1):  # buckets end at lengths[j - 1]
            total = cost[:j] + lengths[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            back[k, j] = np.argmin(total)
            new[j] = total[back[k, j]]
        best.append(new[d])
        cost = new
    k, j, bounds = int(np.argmin(best)) + 1, d, []
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j, k = int(back[k, j]), k - 1
    return bounds[::-1]


def packed(docs: DataFrame, rules: PackRules = PackRules(), id_col: str = "doc_id", text_col: str = "text",
           length: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket (its padded
    length), batch (numbered from 0 inside the bucket), slot, padding.

    ``length`` may be any token count; the default counts words and marks.
    """
    top = rules.max_length
    if length is None:
        sized = token_counts(docs, id_col, text_col)
    else:
        sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    # filtered when read: a filter in the same plan would be pushed below a computed length and run it twice
    sized = materialise(sized, "lengths").filter("n > 0")
    bins = sized.groupBy("n").agg(F.count("*").alias("c"))
    # full pieces of longer documents all have max_length, so bins hold at most max_length rows
    bins = bins.select(F.explode(F.array(
        F.struct((F.col("n") % top).alias("l"), F.col("c").alias("c")),
        F.struct(F.lit(top).cast("long").alias("l"), (F.floor(F.col("n") / top) * F.col("c")).alias("c")))).alias("b"))
    hist = bins.groupBy("b.l").agg(F.sum("b.c").alias("c")).filter("l > 0 and c > 0").orderBy("l").collect()
    total = sum(r["c"] for r in hist)
    bounds = best_bounds(np.array([r["l"] for r in hist], np.int64), np.array([r["c"] for r in hist], np.int64), rules.buckets)
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("first_token"),
                           F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n_tokens"))
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece"), F.col("n_tokens")))
    digits = 0
    while total > rules.cell_rows * 16 ** digits:
        digits += 1  # cells are prefixes of the order key: their number has no influence on the order
    rows = pieces.withColumns({"bucket": bucket, "_key": key}).withColumn("_cell", F.substring("_key", 1, digits))
    cells = rows.groupBy("bucket", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("bucket").alias("_b"), F.col("_cell").alias("_c"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_cell").orderBy("_key", F.col("doc_id").asc_nulls_first(), "piece", "n_tokens")
    rows = rows.withColumn("_at", F.row_number().over(inside)).join(
        cells, (F.col("bucket") == F.col("_b")) & (F.col("_cell") == F.col("_c")))
    at = F.col("_before") + F.col("_at") - 1
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(rules.budget) / F.col("bucket")))
    return rows.select("doc_id", "piece", "first_token", "n_tokens", "bucket", F.floor(at / per).alias("batch"),
                       (at % per).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
