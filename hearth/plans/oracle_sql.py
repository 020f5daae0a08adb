"""SQL fragments for the DuckDB oracle, written from the documented semantics

The currency signs and rates, the stripped character class, the flag texts and
the thresholds in these fragments are fixed values that must equal those of
the source analysis."""

from __future__ import annotations


def num_sql(col: str, cast: str = "DOUBLE") -> str:
    return f"TRY_CAST(regexp_replace({col}, '[^0-9.]', '', 'g') AS {cast})"


def price_intended_sql(col: str = "price") -> str:
    n = num_sql(col)
    return (f"CASE WHEN contains({col}, '֏') THEN {n} / 400 "
            f"WHEN contains({col}, '€') THEN {n} * 1.10 ELSE {n} END")


def price_as_written_sql(col: str = "price") -> str:
    # Strip $ , ֏ € then cast to float; the currency test on the number never fires.
    return f"CAST(TRY_CAST(regexp_replace({col}, '[\\$,֏,€]', '', 'g') AS FLOAT) AS DOUBLE)"


def height_sql(col: str = "ceiling_height", mode: str = "intended") -> str:
    if mode == "intended":
        return num_sql(col)
    return f"CAST(TRY_CAST(regexp_replace({col}, '[^0-9]', '', 'g') AS FLOAT) AS DOUBLE)"


def typed_listings_sql(mode: str = "intended", keep_address: bool = False) -> str:
    """SELECT list of the typed listing projection (mirrors clean.typed_listings)."""
    price = price_intended_sql() if mode == "intended" else price_as_written_sql()
    h = height_sql("ceiling_height", mode)
    cols = [
        "province", "construction_type", "balcony", "furniture",
        f"{price} AS price",
        "CASE WHEN new_construction = 'Yes' THEN 1 ELSE 0 END AS new_construction",
        "CASE WHEN elevator = 'Available' THEN 1 ELSE 0 END AS elevator",
        "floors_in_building", "floor_area",
        f"{h} AS ceiling_height",
        f"CASE WHEN {h} <= 2.75 THEN 0 ELSE 1 END AS high_ceiling",
        "floor",
        "CASE WHEN renovation IN ('Major Renovation', 'Euro Renovation', 'Designer Renovation', "
        "'Cosmetic Renovation') THEN 1 ELSE 0 END AS renovation",
        "CASE WHEN floors_in_building <= 5 THEN 0 ELSE 1 END AS skyscraper",
        "CAST(floor <= 6 AS INTEGER) AS floors_le_6",
        "CAST(floor >= 7 AND floor <= 13 AS INTEGER) AS floors_7_to_13",
        "CAST(floor > 13 AS INTEGER) AS floors_gt_13",
        "CASE WHEN balcony IN ('Open balcony', 'Multiple balconies') THEN 1 ELSE 0 END AS balcony_binary",
        "CASE WHEN furniture IN ('Available', 'Partial Furniture') THEN 1 ELSE 0 END AS furniture_binary",
        "TRY_CAST(rooms AS INTEGER) AS rooms",
        "TRY_CAST(bathrooms AS INTEGER) AS bathrooms",
    ]
    if keep_address:
        cols.insert(0, "address")
    return ",\n  ".join(cols)
