"""Parsing of dirty listing text into numbers, as JVM-side Column expressions.

Spark 4 runs with ANSI casts, where ``CAST('6+' AS INT)`` raises; every
string-to-number conversion here is a ``try_cast`` so a bad value becomes
null instead of failing the job.

Two modes mirror the source notebook:

* ``"intended"`` (default) -- what the notebook says it does: detect the
  currency on the *raw* text, keep digits and the decimal point, convert
  dram and euro to US dollars.
* ``"as_written"`` -- what its code actually computes: strip ``$ , ֏ €``
  (the comma is part of that character class), cast to float, then test the
  *number* for a currency sign, which never matches, so no conversion
  happens; ``12 000`` or ``$ 52,000 monthly`` do not parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source notebook's for the same results:
# currency signs, conversion rates and the character classes it strips.
DRAM_SIGN = "֏"
EURO_SIGN = "€"
DRAM_PER_USD = 400.0
USD_PER_EUR = 1.10
AS_WRITTEN_PRICE_STRIP = r"[\$,֏,€]"
AS_WRITTEN_DIGITS_ONLY = r"[^0-9]"
# Ours: keep digits and the decimal point.
NUMBER_CHARS = r"[^0-9.]"

MODES = ("intended", "as_written")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")


def parse_number(c: Column | str, to: str = "double") -> Column:
    """Keep digits and '.', then ``try_cast``: '2.75 m' -> 2.75, '12 000' -> 12000."""
    return F.regexp_replace(_col(c), NUMBER_CHARS, "").try_cast(to)


def parse_int(c: Column | str) -> Column:
    """Strict integer parse (the notebook's cast): '3' -> 3, '6+' -> null."""
    return _col(c).try_cast("int")


def price_usd(c: Column | str, mode: str = "intended",
              dram_per_usd: float = DRAM_PER_USD,
              usd_per_eur: float = USD_PER_EUR) -> Column:
    """Listing price in US dollars (double)."""
    _check_mode(mode)
    raw = _col(c)
    if mode == "intended":
        num = parse_number(raw, "double")
        return (F.when(raw.contains(DRAM_SIGN), num / dram_per_usd)
                 .when(raw.contains(EURO_SIGN), num * usd_per_eur)
                 .otherwise(num))
    num = F.regexp_replace(raw, AS_WRITTEN_PRICE_STRIP, "").try_cast("float")
    as_text = num.cast("string")
    return (F.when(as_text.contains(DRAM_SIGN), num / dram_per_usd)
             .when(as_text.contains(EURO_SIGN), num * usd_per_eur)
             .otherwise(num.cast("double")))


def ceiling_height(c: Column | str, mode: str = "intended") -> Column:
    """Ceiling height in metres; as written, the point is lost ('2.75 m' -> 275)."""
    _check_mode(mode)
    if mode == "intended":
        return parse_number(c, "double")
    return F.regexp_replace(_col(c), AS_WRITTEN_DIGITS_ONLY, "").try_cast("float").cast("double")


def unparseable(raw: Column | str, parsed: Column) -> Column:
    """True where text was present but did not parse (e.g. 'negotiable')."""
    r = _col(raw)
    return r.isNotNull() & (F.trim(r) != "") & parsed.isNull()
