"""Flags, bands and naming helpers as Column expressions.

``when(...).otherwise(...)`` sends null to the else branch (a null floor
count is "high-rise", a null balcony is "no balcony"), exactly like the
notebook; the floor bands use a bare boolean cast so null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth.functions.parse import ceiling_height

# Fixed values that must equal the source notebook's: the category texts it
# maps to 1 and its thresholds.
NEW_CONSTRUCTION_YES = "Yes"
ELEVATOR_YES = "Available"
LOW_RISE_MAX_FLOORS = 5
CEILING_LOW_MAX = 2.75
FLOOR_BAND_LOW_MAX = 6
FLOOR_BAND_MID = (7, 13)
BALCONY_YES = ("Open balcony", "Multiple balconies")
RENOVATION_YES = ("Major Renovation", "Euro Renovation", "Designer Renovation",
                  "Cosmetic Renovation")
FURNITURE_YES = ("Available", "Partial Furniture")

# Output names of the derived columns (the notebook's names, snake_case).
FLOOR_BAND_NAMES = ("floors_le_6", "floors_7_to_13", "floors_gt_13")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def equals_flag(c: Column | str, value: str) -> Column:
    """1 where ``c == value``, else 0 (null -> 0)."""
    return F.when(_col(c) == value, 1).otherwise(0)


def at_most_flag(c: Column | str, threshold: float) -> Column:
    """0 where ``c <= threshold``, else 1 (null -> 1)."""
    return F.when(_col(c) <= threshold, 0).otherwise(1)


def member_flag(c: Column | str, values: tuple[str, ...]) -> Column:
    """1 where ``c`` is one of ``values``, else 0 (null -> 0)."""
    return F.when(_col(c).isin(*values), 1).otherwise(0)


def floor_bands(c: Column | str = "floor") -> dict[str, Column]:
    """One-hot floor bands (<=6, 7..13, >13) as int; null floor -> all null."""
    f = _col(c)
    lo, hi = FLOOR_BAND_MID
    return {
        FLOOR_BAND_NAMES[0]: (f <= FLOOR_BAND_LOW_MAX).cast("int"),
        FLOOR_BAND_NAMES[1]: ((f >= lo) & (f <= hi)).cast("int"),
        FLOOR_BAND_NAMES[2]: (f > hi).cast("int"),
    }


def listing_flags(mode: str = "intended") -> dict[str, Column]:
    """All binary flags of the notebook over the raw listing columns."""
    return {
        "new_construction_flag": equals_flag("new_construction", NEW_CONSTRUCTION_YES),
        "elevator_flag": equals_flag("elevator", ELEVATOR_YES),
        "skyscraper": at_most_flag("floors_in_building", LOW_RISE_MAX_FLOORS),
        "high_ceiling": at_most_flag(ceiling_height("ceiling_height", mode), CEILING_LOW_MAX),
        "balcony_binary": member_flag("balcony", BALCONY_YES),
        "renovation_flag": member_flag("renovation", RENOVATION_YES),
        "furniture_binary": member_flag("furniture", FURNITURE_YES),
    }
