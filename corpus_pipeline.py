"""The corpus pipeline: raw documents to packed training pieces.

Each stage takes what its predecessor kept, calls one operator of
``hearth/llm`` over all of it, and returns a DataFrame that is written as
Parquet and read again as the next stage's input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hearth.llm import decontam, jaccard, lines, packing, quality
from hearth.llm._store import materialise
from hearth.llm.queries import ORACLE
from hearth.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source are cut out of its texts."""
    return lines.drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return jaccard.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in length buckets and token-budget batches."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]


def _oracle_sql() -> str:
    """The stages' SQL twins, each reading its predecessor's rows (ids are unique)."""

    def twin(name: str, table: str) -> str:
        return "(" + re.sub(r"\bdocuments\b", table, ORACLE[name]) + ")"

    return f"""
WITH rules AS MATERIALIZED (SELECT doc_id, source, text FROM documents JOIN {twin("op3_host_quality", "documents")} r USING (doc_id) WHERE kept),
cut AS MATERIALIZED (SELECT doc_id, source, text FROM {twin("op5_site_lines", "rules")} x),
single AS MATERIALIZED (SELECT doc_id, text FROM cut JOIN {twin("op7_jaccard_join", "cut")} j USING (doc_id) WHERE class_id = doc_id),
leaky AS MATERIALIZED (SELECT DISTINCT doc_id FROM {twin("op4_simhash_decontamination", "single")} l),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM leaky))
SELECT * FROM {twin("op6_length_buckets", "clean")} y"""


ORACLE_SQL = _oracle_sql()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
