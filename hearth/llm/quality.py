"""Quality rules judged at host level.

Every document is measured once; the share of failing documents of each host
is shrunk towards the other hosts by an empirical beta prior, and the host's
verdict is joined back to its documents.

Defined results: a null text is an empty one; a null host is a host of its
own; an empty table gives an empty result; repeated rows count as often as
they occur and each gets its own row; ties cannot occur (verdicts compare
rates with thresholds, ``>=``); other columns are never read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm import _arrow as A
from hearth.llm._store import bounded, materialise

SYMBOLS = A.lut(b"#*$%&|<>")
NOT_BREAK = ~A.lut(b"\n")
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules and of the host verdicts (shares, all over all documents)."""

    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbols_per_word: float = 0.5
    max_dup_line_share: float = 0.5
    word_length: tuple[float, float] = (2.0, 25.0)
    #: Shrunk failure rate from which a host's documents need to pass every rule.
    watch: float = 0.5
    #: Shrunk failure rate from which the whole host is rejected.
    block: float = 0.8


def _repeated_words(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document inside 5-word windows found twice or more in it."""
    docs = len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    count = len(ids) - WINDOW + 1
    if count <= 0:
        return np.zeros(docs, np.int64)
    start = np.flatnonzero(doc[:count] == doc[WINDOW - 1:])
    h = A.mix(doc[start].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        h = A.mix(h ^ (ids[start + k].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    left, right = start[order][:-1][same], start[order][1:][same]
    if any((ids[left + k] != ids[right + k]).any() for k in range(WINDOW)) or (doc[left] != doc[right]).any():
        # two different windows share a hash: settle all by their ids
        rows = np.column_stack([doc[start], *(ids[start + k] for k in range(WINDOW))])
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = start[counts[inverse.ravel()] > 1]
    else:
        found = np.unique(np.concatenate([left, right]))
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    return A.per_doc(np.cumsum(cover[:-1]) > 0, first)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line, of each document."""
    starts, ends, first, mask = A.runs(data, offsets, NOT_BREAK)
    ids, _ = A.encode(data, mask, ends - starts)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_word, out=words[1:])
    full = words[ends] > words[starts]
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))[full]
    span = int(ids.max(initial=0)) + 1
    lines = np.bincount(doc, minlength=docs)
    return lines, lines - np.bincount(np.unique(doc * span + ids[full]) // span, minlength=docs)


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first, mask = A.runs(data, offsets, A.NOT_SPACE)
    ids, _ = A.encode(data, mask, ends - starts)
    lines, dup = _duplicate_lines(data, offsets, mask)
    return {
        "n_words": np.diff(first),
        "word_chars": A.per_doc(mask & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": A.per_doc(SYMBOLS[data], offsets),
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": _repeated_words(ids, first),
    }


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (renamed c0, c1, ...) and the measures of every
    whole text, one row per row."""
    narrow = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)),
                         F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in A.slices(batch, "t"):
                found = measure_slice(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], *(pa.array(found[m].astype(np.int64)) for m in MEASURES)],
                    names=[*rows.schema.names[:-1], *MEASURES])

    fields = [*narrow.schema.fields[:-1], *(T.StructField(m, T.LongType()) for m in MEASURES)]
    return narrow.mapInArrow(run, T.StructType(fields))


def judged(rows: DataFrame, rules: HostRules) -> DataFrame:
    """Adds ``base_failed`` and ``soft_failed`` to measured rows."""
    n = F.col("n_words")
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * n)
    low, high = rules.word_length
    soft = ((F.col("n_symbols") > rules.max_symbols_per_word * n)
            | (F.col("n_dup_lines") > rules.max_dup_line_share * F.col("n_lines"))
            | (F.col("word_chars") < low * n) | (F.col("word_chars") > high * n))
    return rows.withColumns({"base_failed": base, "soft_failed": soft})


def host_verdicts(rows: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    The beta prior is fitted to all hosts by moments: the overall rate is its
    mean, the spread of the hosts' rates beyond binomial noise its width.
    """
    failed = F.col("base_failed") | F.col("soft_failed")
    hosts = materialise(
        rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
                      F.sum(F.col("n_docs") * rate * rate).alias("s2")).first()  # one row
    k, n = total["k"], total["n"] or 0
    mean = (total["f"] + 0.5) / (n + 1) if n else 0.5
    var = max(0.0, (total["s2"] or 0.0) / n - (total["f"] / n) ** 2) if n else 0.0
    noise = mean * (1 - mean) * k / n if n else 0.0  # average binomial variance, weighted by documents
    spread = max(var - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("rate")).withColumn(
        "verdict", F.when(F.col("rate") >= rules.block, "block").when(F.col("rate") >= rules.watch, "watch").otherwise("trust"))


def with_host_verdict(rows: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """Joins the verdicts back and adds ``kept``.  The host table is broadcast
    only under the size bound; beyond it AQE splits a hot host's rows."""
    small = bounded(hosts.select(F.col("host").alias("_host"), F.col("verdict").alias("host_verdict")), 128)
    joined = rows.join(small, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    verdict = F.col("host_verdict")
    kept = ~F.col("base_failed") & (verdict != "block") & ~((verdict == "watch") & F.col("soft_failed"))
    return joined.withColumn("kept", F.coalesce(kept, F.lit(False)))


def quality_report(docs: DataFrame, rules: HostRules = HostRules(), id_col: str = "doc_id",
                   text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: measures, base verdict, host verdict, ``kept``."""
    rows = measured(docs, [id_col, host_col], text_col).withColumnsRenamed({"c0": "doc_id", "c1": "host"})
    rows = materialise(judged(rows, rules), "quality")
    return with_host_verdict(rows, host_verdicts(rows, "host", rules), "host")


def quality_filter(docs: DataFrame, rules: HostRules = HostRules(), text_col: str = "text",
                   host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns as they were.

    Texts are measured twice (host totals first) rather than shuffled or stored.
    """
    names = docs.columns
    narrow = judged(measured(docs, [host_col], text_col), rules)
    hosts = host_verdicts(narrow, "c0", rules)
    rows = judged(measured(docs, names, text_col), rules)
    rows = with_host_verdict(rows, hosts, f"c{names.index(host_col)}").filter("kept")
    return rows.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)))
