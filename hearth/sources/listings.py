"""The ``listings`` table: raw, listing-style records derived from the driver tables.

The notebook the library re-expresses reads one scraped CSV of apartment
listings.  No such file ships with it, so a table with the same columns and
the same kinds of dirt (mixed currencies, unit suffixes, ``6+`` counts,
``negotiable`` prices, missing values, exact duplicate rows from promoted
listings) is projected from ``orders`` joined to ``customer`` and ``nation``.
The rules are in FIXTURES.md; the same rules are written once more, in plain
SQL, for the DuckDB oracle (``LISTINGS_SQL``).

Every row of ``orders`` becomes a listing, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.sources.tables import read_table

# Raw listing columns in the order of the source table, snake_case.  The
# notebook's spellings ("Floor Area", "Number of Rooms", ...) resolve
# case-insensitively in Spark; we normalise once at load instead.
RAW_SCHEMA = T.StructType([
    T.StructField("province", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("construction_type", T.StringType()),
    T.StructField("new_construction", T.StringType()),
    T.StructField("elevator", T.StringType()),
    T.StructField("floors_in_building", T.IntegerType()),
    T.StructField("floor_area", T.IntegerType()),
    T.StructField("rooms", T.StringType()),
    T.StructField("bathrooms", T.StringType()),
    T.StructField("ceiling_height", T.StringType()),
    T.StructField("floor", T.IntegerType()),
    T.StructField("balcony", T.StringType()),
    T.StructField("furniture", T.StringType()),
    T.StructField("renovation", T.StringType()),
])
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

# Source spelling -> our column name (for CSVs written with the original headers).
SOURCE_NAMES = {
    "province": "province",
    "address": "address",
    "price": "price",
    "Construction Type": "construction_type",
    "New Construction": "new_construction",
    "Elevator": "elevator",
    "Floors in the Building": "floors_in_building",
    "Floor Area": "floor_area",
    "Number of Rooms": "rooms",
    "Number of Bathrooms": "bathrooms",
    "Ceiling Height": "ceiling_height",
    "Floor": "floor",
    "Balcony": "balcony",
    "Furniture": "furniture",
    "Renovation": "renovation",
}


def snake_case(name: str) -> str:
    """Map a source header to our column name ('Floor Area' -> 'floor_area')."""
    for src, ours in SOURCE_NAMES.items():
        if src.lower() == name.strip().lower():
            return ours
    out = "".join(ch.lower() if ch.isalnum() else "_" for ch in name.strip())
    return "_".join(p for p in out.split("_") if p)


def _pick(key: Column, mod: int, values: list[str | None]) -> Column:
    """``CASE key % mod WHEN 0 THEN values[0] WHEN 1 THEN values[1] ... END``."""
    expr = F.when(key % mod == 0, F.lit(values[0]).cast("string"))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(key % mod == i, F.lit(v).cast("string"))
    return expr


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the raw listing table (all rows of ``orders``, promoted ones twice).

    One scan of each table and one pass over the joined rows: the duplicate
    copies of promoted listings come from ``explode`` rather than a second
    scan + join + union.  The join of orders to customer is left to the
    optimizer (sort-merge at scale, broadcast only when its size estimate is
    under the threshold); nation is a 25-row dimension.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey))

    k = F.col("o_orderkey")
    q = F.col("o_custkey")
    t = F.floor(F.col("o_totalprice")).cast("bigint")
    t_dram = (F.floor(F.col("o_totalprice")) * 400).cast("bigint")

    price = (F.when(k % 40 == 7, F.lit(None).cast("string"))
             .when(k % 40 == 8, F.lit("negotiable"))
             .when(k % 4 == 0, F.concat(F.lit("֏ "), F.format_number(t_dram, 0)))
             .when(k % 4 == 1, F.concat(F.lit("€"), F.format_number(t, 0)))
             .otherwise(F.concat(F.lit("$"), F.format_number(t, 0))))

    cols = {
        "province": F.col("n_name"),
        "address": F.concat(F.lit("Street "), (q % 300).cast("string"), F.lit(", "),
                            k.cast("string")),
        "price": price,
        "construction_type": _pick(k, 3, ["Stone", "Panels", "Monolith"]),
        "new_construction": F.when(k % 5 == 0, "Yes").otherwise("No"),
        "elevator": F.when(k % 7 < 4, "Available").otherwise("Not Available"),
        "floors_in_building": F.when(k % 37 == 0, F.lit(None)).otherwise(1 + k % 20).cast("int"),
        "floor_area": (30 + q % 170).cast("int"),
        "rooms": F.when(k % 9 == 8, "6+").otherwise((1 + k % 9).cast("string")),
        "bathrooms": F.when(q % 4 == 3, "3+").otherwise((1 + q % 4).cast("string")),
        "ceiling_height": F.concat((2 + q % 2).cast("string"), F.lit("."),
                                   (k % 10).cast("string"), F.lit(" m")),
        "floor": F.when(k % 37 == 0, F.lit(None)).otherwise(1 + q % (1 + k % 20)).cast("int"),
        "balcony": _pick(q, 5, ["No balcony", "Open balcony", "Multiple balconies",
                                "No balcony", None]),
        "furniture": _pick(q, 4, ["Available", "Partial Furniture", "Not Available",
                                  "By Agreement"]),
        "renovation": F.concat(_pick(k, 6, ["No", "Old", "Euro", "Cosmetic", "Major",
                                            "Designer"]), F.lit(" Renovation")),
    }
    copies = F.explode(F.sequence(F.lit(1), F.when(k % 50 == 0, 2).otherwise(1)))
    return (j.select(*[e.alias(name) for name, e in cols.items()], copies.alias("_copy"))
             .drop("_copy"))


# The same table for DuckDB, written independently from the FIXTURES.md rules
# (UNION ALL of the promoted copies instead of explode).
_LISTING_PROJECTION = """
    SELECT
      n.n_name AS province,
      concat('Street ', CAST(o.o_custkey % 300 AS VARCHAR), ', ', CAST(o.o_orderkey AS VARCHAR)) AS address,
      CASE
        WHEN o.o_orderkey % 40 = 7 THEN NULL
        WHEN o.o_orderkey % 40 = 8 THEN 'negotiable'
        WHEN o.o_orderkey % 4 = 0 THEN concat('֏ ', format('{{:,}}', CAST(floor(o.o_totalprice) * 400 AS BIGINT)))
        WHEN o.o_orderkey % 4 = 1 THEN concat('€', format('{{:,}}', CAST(floor(o.o_totalprice) AS BIGINT)))
        ELSE concat('$', format('{{:,}}', CAST(floor(o.o_totalprice) AS BIGINT)))
      END AS price,
      CASE o.o_orderkey % 3 WHEN 0 THEN 'Stone' WHEN 1 THEN 'Panels' ELSE 'Monolith' END AS construction_type,
      CASE WHEN o.o_orderkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS new_construction,
      CASE WHEN o.o_orderkey % 7 < 4 THEN 'Available' ELSE 'Not Available' END AS elevator,
      CAST(CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE 1 + o.o_orderkey % 20 END AS INTEGER) AS floors_in_building,
      CAST(30 + o.o_custkey % 170 AS INTEGER) AS floor_area,
      CASE WHEN o.o_orderkey % 9 = 8 THEN '6+' ELSE CAST(1 + o.o_orderkey % 9 AS VARCHAR) END AS rooms,
      CASE WHEN o.o_custkey % 4 = 3 THEN '3+' ELSE CAST(1 + o.o_custkey % 4 AS VARCHAR) END AS bathrooms,
      concat(CAST(2 + o.o_custkey % 2 AS VARCHAR), '.', CAST(o.o_orderkey % 10 AS VARCHAR), ' m') AS ceiling_height,
      CAST(CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE 1 + o.o_custkey % (1 + o.o_orderkey % 20) END AS INTEGER) AS floor,
      CASE o.o_custkey % 5 WHEN 1 THEN 'Open balcony' WHEN 2 THEN 'Multiple balconies'
                           WHEN 4 THEN NULL ELSE 'No balcony' END AS balcony,
      CASE o.o_custkey % 4 WHEN 0 THEN 'Available' WHEN 1 THEN 'Partial Furniture'
                           WHEN 2 THEN 'Not Available' ELSE 'By Agreement' END AS furniture,
      concat(CASE o.o_orderkey % 6 WHEN 0 THEN 'No' WHEN 1 THEN 'Old' WHEN 2 THEN 'Euro'
                                   WHEN 3 THEN 'Cosmetic' WHEN 4 THEN 'Major' ELSE 'Designer' END,
             ' Renovation') AS renovation
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    {where}
"""

LISTINGS_SQL = ("(" + _LISTING_PROJECTION.format(where="")
                + " UNION ALL "
                + _LISTING_PROJECTION.format(where="WHERE o.o_orderkey % 50 = 0") + ")")


def with_listings(sql_body: str, extra_ctes: str = "") -> str:
    """Prefix an oracle statement with the ``listings`` CTE."""
    ctes = f"listings AS {LISTINGS_SQL}"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{sql_body}"
