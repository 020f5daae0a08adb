"""The parsing functions as SQL functions, for analyses written in SQL text.

``CREATE TEMPORARY FUNCTION ... RETURN`` bodies are expressions that the
optimizer inlines: no UDF, the same plan as the Column functions of
``parse``.  The rates are parameters with defaults.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from hearth.functions.parse import DRAM_PER_USD, DRAM_SIGN, EURO_SIGN, NUMBER_CHARS, USD_PER_EUR

FUNCTIONS = (
    f"""number_in(raw STRING) RETURNS DOUBLE
        RETURN try_cast(regexp_replace(raw, '{NUMBER_CHARS}', '') AS DOUBLE)""",
    f"""price_usd(raw STRING, dram_per_usd DOUBLE DEFAULT {DRAM_PER_USD}D, usd_per_eur DOUBLE DEFAULT {USD_PER_EUR}D) RETURNS DOUBLE
        RETURN CASE WHEN contains(raw, '{DRAM_SIGN}') THEN number_in(raw) / dram_per_usd
                    WHEN contains(raw, '{EURO_SIGN}') THEN number_in(raw) * usd_per_eur
                    ELSE number_in(raw) END""",
    """whole_number(raw STRING) RETURNS INT RETURN try_cast(raw AS INT)""",
    """text_before(raw STRING, sep STRING DEFAULT ',') RETURNS STRING RETURN substring_index(raw, sep, 1)""",
)


def register_functions(spark: SparkSession) -> list[str]:
    """Define the functions for this session; returns their names."""
    for body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return [body.split("(")[0] for body in FUNCTIONS]
