"""Line dedup by site-relative frequency [DataFrame functions only].

A line is boilerplate of a host if the share of the host's pages that contain
it exceeds ``max_share``; such lines are dropped from the host's pages.  The
share is read with care for small hosts: its lower Wilson bound counts, which
comes close to the share itself as the pages grow in number (two of two pages
count 0.42, two of ten 0.07, 200 of 1,000 0.18).  A line on one page only is
never boilerplate.

Lines are the ``\\n``-separated pieces of the whole text; only lines with a
word count and can be dropped, blank ones stay.  Defined results: a null text
is an empty one (and stays null in ``drop_boilerplate``); a null host is a
host of its own; repeated rows are pages of their own; a share equal to the
limit stays; an empty table gives an empty result; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm._store import BROADCAST_BYTES, materialise

HAS_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineRules:
    max_share: float = 0.1
    #: Normal quantile of the bound (one-sided 95 %).
    z: float = 1.645


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def share_bound(part: Column, whole: Column, z: float) -> Column:
    """Lower Wilson bound of a share."""
    share, zz = part / whole, z * z
    spread = z * F.sqrt((share * (1 - share) + zz / (4 * whole)) / whole)
    return (share + zz / (2 * whole) - spread) / (1 + zz / whole)


def boilerplate(docs: DataFrame, rules: LineRules, host_col: str, text_col: str) -> DataFrame:
    """One row per host: the md5 digests of its boilerplate lines.

    Counts are summed before the shuffle, so neither a hot host nor a hot line
    gathers rows.  A host's list is bounded by its mean lines per page divided
    by ``max_share``, whatever the number of pages.
    """
    pages = docs.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    once = pages.select("_host", F.explode(F.array_distinct(_lines(F.col("_text")))).alias("_line"))
    counts = (once.filter(F.col("_line").rlike(HAS_WORD)).groupBy("_host", F.md5("_line").alias("_key"))
              .agg(F.count("*").alias("_pages")).filter("_pages > 1"))
    totals = pages.groupBy(F.col("_host").alias("_of")).agg(F.count("*").alias("_total"))
    found = counts.join(totals, F.col("_host").eqNullSafe(F.col("_of"))).filter(
        share_bound(F.col("_pages"), F.col("_total"), rules.z) > rules.max_share)
    return materialise(found.groupBy("_host").agg(F.collect_list("_key").alias("_drop")), "boilerplate")


def _joined(docs: DataFrame, rules: LineRules, host_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """``docs`` with its host's digests joined, the kept lines and the dropped
    count.  The columns of ``docs`` must not begin with an underscore."""
    bad = boilerplate(docs, rules, host_col, text_col).withColumnRenamed("_host", "_at")
    weight = bad.agg(F.sum(64 + 40 * F.size("_drop"))).first()[0] or 0
    side = F.broadcast(bad) if weight <= BROADCAST_BYTES else bad
    rows = docs.join(side, F.col(host_col).eqNullSafe(F.col("_at")), "left").drop("_at")
    lines = _lines(F.col(text_col))
    # the few digests that this page shares with its host's list, then one test per line
    here = F.array_intersect(F.transform(lines, F.md5), F.col("_drop"))
    rows = rows.withColumn("_here", F.when(F.col("_drop").isNotNull(), here)).drop("_drop")
    is_bad = F.size("_here") > 0
    kept = F.when(is_bad, F.filter(lines, lambda x: ~F.array_contains(F.col("_here"), F.md5(x)))).otherwise(lines)
    return rows, kept, is_bad


def line_report(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
                host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: its lines, those dropped, and the text that is left."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("source"), F.col(text_col).alias("text"))
    rows, kept, _ = _joined(docs, rules, "source", "text")
    n = F.size(_lines(F.col("text")))
    return rows.withColumn("_kept", kept).select(
        "doc_id", "source", n.cast("long").alias("n_lines"), (n - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("text"))


def drop_boilerplate(docs: DataFrame, rules: LineRules = LineRules(), host_col: str = "source",
                     text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the boilerplate lines cut out of the texts (``chars_col``, if
    present, is the new length); a document keeps its row even if all its lines go."""
    names = docs.columns
    host, text = (f"c{names.index(c)}" for c in (host_col, text_col))
    rows, kept, is_bad = _joined(docs.toDF(*(f"c{k}" for k in range(len(names)))), rules, host, text)
    rows = rows.withColumn("_new", F.when(is_bad, F.array_join(kept, "\n")).otherwise(F.col(text)))
    new = {text_col: F.col("_new")}
    if chars_col in names:
        new[chars_col] = F.when(is_bad, F.length("_new").cast("long")).otherwise(F.col(f"c{names.index(chars_col)}"))
    return rows.select(*(new.get(c, F.col(f"c{k}")).alias(c) for k, c in enumerate(names)))
