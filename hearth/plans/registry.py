"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their oracle SQL.

Each query reads the driver tables (directly or through the derived
``listings`` table), runs over all of their rows, and aliases every
computed column the same way as its SQL twin in ``ORACLE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.flags import listing_flags, floor_bands
from hearth.functions.parse import price_usd
from hearth.operators import clean, outliers, profile
from hearth.session import stage
from hearth.plans.oracle_sql import (
    price_as_written_sql, price_intended_sql, typed_listings_sql,
)
from hearth.sources.listings import RAW_COLUMNS, listings, with_listings
from hearth.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _prices(spark: SparkSession, sf_dir: str, mode: str = "intended", *keys: str) -> DataFrame:
    return listings(spark, sf_dir).select(*(keys or ("province",)), price_usd("price", mode).alias("price"))


def _priced(spark: SparkSession, sf_dir: str, mode: str = "intended", *keys: str) -> DataFrame:
    """(keys, price), written once: the join and the parse run once for the
    quartiles and the result, and the cut is pushed into the scan of this stage."""
    return stage(_prices(spark, sf_dir, mode, *keys), "priced")


# --------------------------------------------------------------------------
# Flagship: listings -> price in USD -> exact IQR cut -> per-province summary
# --------------------------------------------------------------------------

def province_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _priced(spark, sf_dir)
    kept, _, _ = outliers.split_outliers(priced, "price", relative_error=None)
    return kept.groupBy("province").agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.round(F.avg("price"), 4).alias("mean_price"),
        F.round(F.min("price"), 4).alias("min_price"),
        F.round(F.max("price"), 4).alias("max_price"),
    )


_PRICED_CTE = f"p AS (SELECT province, {price_intended_sql()} AS price FROM listings)"
_BOUNDS_CTE = ("b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM p), "
               "f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)")

register("province_price_summary", with_listings(
    """SELECT province, COUNT(*) AS n_listings, ROUND(AVG(price), 4) AS mean_price,
              ROUND(MIN(price), 4) AS min_price, ROUND(MAX(price), 4) AS max_price
       FROM p, f WHERE p.price >= f.lo AND p.price <= f.hi GROUP BY province""",
    _PRICED_CTE + ", " + _BOUNDS_CTE))(province_price_summary)


# --------------------------------------------------------------------------
# Sources, views, previews (S1-S5, S7)
# --------------------------------------------------------------------------

@register("view_count_sql", with_listings("SELECT COUNT(*) AS n_rows FROM listings"))
def view_count_sql(spark, sf_dir):
    return profile.row_count_sql(listings(spark, sf_dir), "listings")


@register("preview_first_n",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
          "CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority "
          "FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_first_n(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return (o.orderBy("o_orderkey").limit(20)
             .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                     F.col("o_orderdate").cast("string").alias("o_orderdate"),
                     "o_orderpriority"))


@register("listings_raw", with_listings("SELECT * FROM listings"))
def listings_raw(spark, sf_dir):
    return listings(spark, sf_dir)


# --------------------------------------------------------------------------
# Profiling (A1-A7, A11)
# --------------------------------------------------------------------------

register("missing_counts_long", with_listings(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS missing_count FROM listings" for c in RAW_COLUMNS)))(
    lambda spark, sf_dir: profile.missing_counts_long(listings(spark, sf_dir)))


def _missing_profile(spark, sf_dir):
    df = listings(spark, sf_dir)
    parsed = {"price": price_usd("price"), "rooms": F.col("rooms").try_cast("int"),
              "bathrooms": F.col("bathrooms").try_cast("int")}
    return profile.missing_profile(df, parsed)


def _missing_profile_sql() -> str:
    parts = []
    for c in RAW_COLUMNS:
        if c == "price":
            unp = f"SUM(CASE WHEN price IS NOT NULL AND trim(price) <> '' AND ({price_intended_sql()}) IS NULL THEN 1 ELSE 0 END)"
        elif c in ("rooms", "bathrooms"):
            unp = f"SUM(CASE WHEN {c} IS NOT NULL AND trim({c}) <> '' AND TRY_CAST({c} AS INTEGER) IS NULL THEN 1 ELSE 0 END)"
        else:
            unp = "0"
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
            f"CAST(0 AS BIGINT) AS nan_count, CAST({unp} AS BIGINT) AS unparseable_count FROM listings")
    return with_listings(" UNION ALL ".join(parts))


register("missing_profile", _missing_profile_sql())(_missing_profile)


@register("duplicate_report", with_listings(
    """SELECT CAST(t.n AS BIGINT) AS total_rows, CAST(u.n AS BIGINT) AS unique_rows,
              CAST(t.n - u.n AS BIGINT) AS duplicate_rows
       FROM (SELECT COUNT(*) AS n FROM listings) t,
            (SELECT COUNT(*) AS n FROM (SELECT DISTINCT * FROM listings)) u"""))
def duplicate_report(spark, sf_dir):
    return profile.duplicate_report(listings(spark, sf_dir))


@register("dedup_rows", with_listings("SELECT DISTINCT * FROM listings"))
def dedup_rows(spark, sf_dir):
    return profile.dedup_rows(listings(spark, sf_dir))


@register("group_count_province", with_listings(
    "SELECT province, COUNT(*) AS count FROM listings GROUP BY province"))
def group_count_province(spark, sf_dir):
    return profile.group_count(listings(spark, sf_dir), "province")


@register("group_count_rooms", with_listings(
    "SELECT rooms, COUNT(*) AS count FROM listings GROUP BY rooms"))
def group_count_rooms(spark, sf_dir):
    return profile.group_count(listings(spark, sf_dir), "rooms")


_LINEITEM_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("summary_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, "
    f"ROUND(STDDEV_SAMP({c}), 4) AS stddev, CAST(MIN({c}) AS DOUBLE) AS min, "
    f"CAST(MAX({c}) AS DOUBLE) AS max FROM lineitem" for c in _LINEITEM_STATS))
def summary_stats(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", _LINEITEM_STATS)
    return profile.summary_stats(li, _LINEITEM_STATS)


# --------------------------------------------------------------------------
# Cleaning (P1-P19)
# --------------------------------------------------------------------------

@register("price_usd_intended", with_listings(
    f"SELECT address, price AS price_raw, ROUND({price_intended_sql()}, 4) AS price_usd FROM listings"))
def price_usd_intended(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "address", F.col("price").alias("price_raw"),
        F.round(price_usd("price", "intended"), 4).alias("price_usd"))


@register("price_usd_as_written", with_listings(
    f"SELECT address, price AS price_raw, ROUND({price_as_written_sql()}, 4) AS price_usd FROM listings"))
def price_usd_as_written(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "address", F.col("price").alias("price_raw"),
        F.round(price_usd("price", "as_written"), 4).alias("price_usd"))


@register("binary_flags", with_listings(
    """SELECT address,
         CASE WHEN new_construction = 'Yes' THEN 1 ELSE 0 END AS new_construction_flag,
         CASE WHEN elevator = 'Available' THEN 1 ELSE 0 END AS elevator_flag,
         CASE WHEN floors_in_building <= 5 THEN 0 ELSE 1 END AS skyscraper,
         CASE WHEN TRY_CAST(regexp_replace(ceiling_height, '[^0-9.]', '', 'g') AS DOUBLE) <= 2.75
              THEN 0 ELSE 1 END AS high_ceiling,
         CASE WHEN balcony IN ('Open balcony', 'Multiple balconies') THEN 1 ELSE 0 END AS balcony_binary,
         CASE WHEN renovation IN ('Major Renovation', 'Euro Renovation', 'Designer Renovation',
                                  'Cosmetic Renovation') THEN 1 ELSE 0 END AS renovation_flag,
         CASE WHEN furniture IN ('Available', 'Partial Furniture') THEN 1 ELSE 0 END AS furniture_binary
       FROM listings"""))
def binary_flags(spark, sf_dir):
    flags = listing_flags("intended")
    return listings(spark, sf_dir).select("address", *[e.alias(k) for k, e in flags.items()])


@register("floor_bands", with_listings(
    """SELECT address, floor,
         CAST(floor <= 6 AS INTEGER) AS floors_le_6,
         CAST(floor >= 7 AND floor <= 13 AS INTEGER) AS floors_7_to_13,
         CAST(floor > 13 AS INTEGER) AS floors_gt_13
       FROM listings"""))
def floor_bands_query(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "address", "floor", *[e.alias(k) for k, e in floor_bands("floor").items()])


def _typed(spark, sf_dir, mode="intended"):
    return clean.typed_listings(listings(spark, sf_dir), mode, keep_address=True)


@register("typed_listings", with_listings(
    f"SELECT * REPLACE (ROUND(price, 4) AS price, ROUND(ceiling_height, 4) AS ceiling_height) "
    f"FROM (SELECT {typed_listings_sql(keep_address=True)} FROM listings)"))
def typed_listings(spark, sf_dir):
    t = _typed(spark, sf_dir)
    return t.withColumns({"price": F.round("price", 4), "ceiling_height": F.round("ceiling_height", 4)})


@register("typed_listings_as_written", with_listings(
    f"SELECT * REPLACE (ROUND(price, 4) AS price, ROUND(ceiling_height, 4) AS ceiling_height) "
    f"FROM (SELECT {typed_listings_sql('as_written', keep_address=True)} FROM listings)"))
def typed_listings_as_written(spark, sf_dir):
    t = _typed(spark, sf_dir, "as_written")
    return t.withColumns({"price": F.round("price", 4), "ceiling_height": F.round("ceiling_height", 4)})


_FILL_COLS = ["price", "floors_in_building", "floor", "rooms", "bathrooms", "ceiling_height"]


@register("filled_listings", with_listings(
    "SELECT * REPLACE (ROUND(COALESCE(price, 0), 4) AS price, "
    "ROUND(COALESCE(ceiling_height, 0), 4) AS ceiling_height, "
    "COALESCE(floors_in_building, 0) AS floors_in_building, COALESCE(floor, 0) AS floor, "
    "COALESCE(rooms, 0) AS rooms, COALESCE(bathrooms, 0) AS bathrooms) "
    f"FROM (SELECT {typed_listings_sql(keep_address=True)} FROM listings)"))
def filled_listings(spark, sf_dir):
    t = clean.fill_zero(_typed(spark, sf_dir), _FILL_COLS)
    return t.withColumns({"price": F.round("price", 4), "ceiling_height": F.round("ceiling_height", 4)})


@register("complete_rows", with_listings(
    "SELECT * FROM listings WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in RAW_COLUMNS)))
def complete_rows(spark, sf_dir):
    return clean.complete_rows(listings(spark, sf_dir))


@register("min_price_filter", with_listings(
    f"SELECT address, province, ROUND(p, 4) AS price_usd FROM "
    f"(SELECT address, province, {price_intended_sql()} AS p FROM listings) WHERE p >= 10000"))
def min_price_filter(spark, sf_dir, min_price: float = 10000.0):
    df = _priced(spark, sf_dir, "intended", "address", "province")
    return df.where(F.col("price") >= min_price).select(
        "address", "province", F.round("price", 4).alias("price_usd"))


@register("drop_address", with_listings("SELECT * EXCLUDE (address) FROM listings"))
def drop_address(spark, sf_dir):
    return listings(spark, sf_dir).drop("address")


# --------------------------------------------------------------------------
# Quantiles, central tendency, histograms, box plots, IQR cut (A8-A17)
# --------------------------------------------------------------------------

@register("quartiles_exact",
          "SELECT ROUND(quantile_cont(o_totalprice, 0.25), 4) AS q1, "
          "ROUND(quantile_cont(o_totalprice, 0.5), 4) AS q2, "
          "ROUND(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders")
def quartiles_exact(spark, sf_dir):
    from hearth.operators.quantiles import exact_quantiles
    o = read_table(spark, sf_dir, "orders", ["o_totalprice"])
    q1, q2, q3 = exact_quantiles(o, "o_totalprice", [0.25, 0.5, 0.75])
    return spark.createDataFrame([(q1, q2, q3)], "q1 double, q2 double, q3 double").select(
        *[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")])


@register("quartiles_approx", with_listings(
    """SELECT q.probability, COUNT(price) AS n, TRUE AS within_error FROM p, (SELECT unnest([0.25, 0.75]::DOUBLE[]) AS probability) q
       GROUP BY q.probability""", _PRICED_CTE))
def quartiles_approx(spark, sf_dir):
    """The notebook's sketch quartiles (error 0.05) of the listing price: is the
    share of prices below each within the error of its probability?"""
    from hearth.operators.quantiles import approx_quantiles
    prices = _priced(spark, sf_dir).select("price")
    asked, error = [0.25, 0.75], 0.05
    found = approx_quantiles(prices, "price", asked, error)
    x, n = F.col("price"), F.count("price")
    cells = []
    for p, q in zip(asked, found):
        # a value's copies span ranks; one of them must lie within the error
        near = (F.count_if(x < q) / n <= p + error) & (F.count_if(x <= q) / n >= p - error)
        cells.append(F.struct(F.lit(p).alias("probability"), n.alias("n"), near.alias("within_error")))
    return prices.agg(F.array(*cells).alias("a")).select(F.inline("a"))


@register("central_tendency_part",
          """SELECT ROUND(AVG(p_retailprice), 4) AS mean,
                    ROUND(quantile_cont(p_retailprice, 0.5), 4) AS median,
                    ROUND((SELECT p_retailprice FROM part GROUP BY p_retailprice
                           ORDER BY COUNT(*) DESC, p_retailprice ASC LIMIT 1), 4) AS mode
             FROM part""")
def central_tendency_part(spark, sf_dir):
    return profile.central_tendency(read_table(spark, sf_dir, "part", ["p_retailprice"]),
                                    "p_retailprice")


@register("central_tendency_listings", with_listings(
    """SELECT ROUND(AVG(price), 4) AS mean, ROUND(quantile_cont(price, 0.5), 4) AS median,
              ROUND((SELECT price FROM k GROUP BY price ORDER BY COUNT(*) DESC, price ASC LIMIT 1), 4) AS mode
       FROM k""",
    _PRICED_CTE + ", " + _BOUNDS_CTE
    + ", k AS (SELECT p.price FROM p, f WHERE p.price >= f.lo AND p.price <= f.hi)"))
def central_tendency_listings(spark, sf_dir):
    """Mean, median and mode of the price after the IQR cut (the notebook's histogram lines)."""
    from hearth.operators.quantiles import cached_values, exact_quantiles
    with cached_values(_prices(spark, sf_dir), "price") as x:
        b = outliers.IqrBounds(*exact_quantiles(x, "x", [0.25, 0.75], persist=False))
        return profile.central_tendency(x.where(outliers.keep_condition("x", b)), "x")


def _histogram_sql(source: str, col: str, bins: int = 50) -> str:
    return f"""
      t AS (SELECT CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL),
      r AS (SELECT MIN(x) AS mn, MAX(x) AS mx FROM t),
      c AS (SELECT CAST(LEAST(FLOOR((x - mn) / (mx - mn) * {bins}), {bins - 1}) + 1 AS INTEGER) AS bin,
                   COUNT(*) AS n FROM t, r GROUP BY 1),
      ax AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1}))
    """, f"""
      SELECT ax.bin, ROUND(mn + (ax.bin - 1) * ((mx - mn) / {bins}), 6) AS bin_lower,
             ROUND(mn + ax.bin * ((mx - mn) / {bins}), 6) AS bin_upper,
             COALESCE(c.n, 0) AS n
      FROM ax CROSS JOIN r LEFT JOIN c ON ax.bin = c.bin
    """


_h_ctes, _h_body = _histogram_sql("listings", "floor_area")
register("histogram_floor_area", with_listings(_h_body, _h_ctes))(
    lambda spark, sf_dir: profile.histogram(listings(spark, sf_dir), "floor_area", 50))
_h_ctes, _h_body = _histogram_sql("orders", "o_totalprice")
register("histogram_order_price", f"WITH {_h_ctes} {_h_body}")(
    lambda spark, sf_dir: profile.histogram(read_table(spark, sf_dir, "orders", ["o_totalprice"]),
                                            "o_totalprice", 50, persist=False))


_BOX_SQL = with_listings(
    """SELECT q.series, q.n, ROUND(q.q1, 4) AS q1, ROUND(q.med, 4) AS median, ROUND(q.q3, 4) AS q3,
              ROUND(q.q3 - q.q1, 4) AS iqr,
              ROUND(MIN(s.price) FILTER (WHERE s.price >= q.q1 - 1.5 * (q.q3 - q.q1)), 4) AS whisker_low,
              ROUND(MAX(s.price) FILTER (WHERE s.price <= q.q3 + 1.5 * (q.q3 - q.q1)), 4) AS whisker_high,
              CAST(SUM(CASE WHEN s.price < q.q1 - 1.5 * (q.q3 - q.q1)
                              OR s.price > q.q3 + 1.5 * (q.q3 - q.q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_fliers
       FROM q JOIN s ON q.series = s.series
       GROUP BY q.series, q.n, q.q1, q.med, q.q3""",
    _PRICED_CTE + ", " + _BOUNDS_CTE + """,
       k AS (SELECT p.price FROM p, f WHERE p.price >= f.lo AND p.price <= f.hi),
       s AS (SELECT 'with_outliers' AS series, price FROM p WHERE price IS NOT NULL
             UNION ALL SELECT 'without_outliers' AS series, price FROM k),
       q AS (SELECT series, COUNT(*) AS n, quantile_cont(price, 0.25) AS q1,
                    quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.75) AS q3
             FROM s GROUP BY series)""")


@register("boxplot_stats", _BOX_SQL)
def boxplot_stats(spark, sf_dir):
    return profile.boxplot_with_and_without_outliers(_prices(spark, sf_dir), "price")


@register("iqr_bounds", with_listings(
    """SELECT ROUND(q1, 4) AS q1, ROUND(q3, 4) AS q3, ROUND(q3 - q1, 4) AS iqr,
              ROUND(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, ROUND(q3 + 1.5 * (q3 - q1), 4) AS upper_bound
       FROM b""", _PRICED_CTE + ", " + _BOUNDS_CTE))
def iqr_bounds(spark, sf_dir):
    b = outliers.bounds_frame(_prices(spark, sf_dir), "price", relative_error=None)
    return b.select(*[F.round(c, 4).alias(c) for c in b.columns])


_ADDR_PRICED_CTE = f"p AS (SELECT address, province, {price_intended_sql()} AS price FROM listings)"


def _addr_priced(spark, sf_dir, mode: str = "intended"):
    return _priced(spark, sf_dir, mode, "address", "province")


@register("iqr_outliers", with_listings(
    "SELECT address, province, ROUND(price, 4) AS price FROM p, f WHERE p.price < f.lo OR p.price > f.hi",
    _ADDR_PRICED_CTE + ", " + _BOUNDS_CTE))
def iqr_outliers(spark, sf_dir):
    _, out, _ = outliers.split_outliers(_addr_priced(spark, sf_dir), "price", relative_error=None)
    return out.withColumn("price", F.round("price", 4))


@register("iqr_kept", with_listings(
    "SELECT address, province, ROUND(price, 4) AS price FROM p, f WHERE p.price >= f.lo AND p.price <= f.hi",
    _ADDR_PRICED_CTE + ", " + _BOUNDS_CTE))
def iqr_kept(spark, sf_dir):
    kept, _, _ = outliers.split_outliers(_addr_priced(spark, sf_dir), "price", relative_error=None)
    return kept.withColumn("price", F.round("price", 4))


@register("iqr_outliers_orders",
          """WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3
                       FROM orders)
             SELECT o_orderkey, o_totalprice FROM orders, b
             WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    _, out, _ = outliers.split_outliers(o, "o_totalprice", relative_error=None)
    return out


# Evenly spread prices: with quartiles anywhere within the error, the fences lie beyond all of them.
@register("iqr_kept_approx", with_listings("SELECT address, province, price FROM p WHERE price IS NOT NULL",
                                           f"p AS (SELECT address, province, {price_intended_sql()} AS price FROM listings)"))
def iqr_kept_approx(spark, sf_dir):
    """The notebook's cut: sketch quartiles at error 0.05."""
    kept, _, _ = outliers.split_outliers(_addr_priced(spark, sf_dir), "price", relative_error=0.05)
    return kept


# The price as the notebook's code parses it has outliers on both kinds of sign,
# so here the cut removes rows.
_WRITTEN_CTE = f"p AS (SELECT address, province, {price_as_written_sql()} AS price FROM listings)"


@register("iqr_outliers_as_written", with_listings(
    "SELECT address, province, ROUND(price, 4) AS price FROM p, f WHERE p.price < f.lo OR p.price > f.hi",
    _WRITTEN_CTE + ", " + _BOUNDS_CTE))
def iqr_outliers_as_written(spark, sf_dir):
    _, out, _ = outliers.split_outliers(_addr_priced(spark, sf_dir, "as_written"), "price", relative_error=None)
    return out.withColumn("price", F.round("price", 4))


@register("iqr_kept_as_written", with_listings(
    "SELECT address, province, ROUND(price, 4) AS price FROM p, f WHERE p.price >= f.lo AND p.price <= f.hi",
    _WRITTEN_CTE + ", " + _BOUNDS_CTE))
def iqr_kept_as_written(spark, sf_dir):
    kept, _, _ = outliers.split_outliers(_addr_priced(spark, sf_dir, "as_written"), "price", relative_error=None)
    return kept.withColumn("price", F.round("price", 4))


@register("province_price_summary_as_written", with_listings(
    """SELECT province, COUNT(*) AS n_listings, ROUND(AVG(price), 4) AS mean_price,
              ROUND(MIN(price), 4) AS min_price, ROUND(MAX(price), 4) AS max_price
       FROM p, f WHERE p.price >= f.lo AND p.price <= f.hi GROUP BY province""",
    _WRITTEN_CTE + ", " + _BOUNDS_CTE))
def province_price_summary_as_written(spark, sf_dir):
    kept, _, _ = outliers.split_outliers(_priced(spark, sf_dir, "as_written"), "price", relative_error=None)
    return kept.groupBy("province").agg(
        F.count(F.lit(1)).alias("n_listings"), F.round(F.avg("price"), 4).alias("mean_price"),
        F.round(F.min("price"), 4).alias("min_price"), F.round(F.max("price"), 4).alias("max_price"))


# --------------------------------------------------------------------------
# Listing extraction from pages (X1-X10)
# --------------------------------------------------------------------------

_DETAIL_RE_SQL = "'<li><a href=\"([^\"]*)\">(.*?)</a></li>'"
_AD_SQL = "nullif(regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1), '')"
# Declared wide columns: detail labels that become columns (absent -> null).
WIDE_LABELS = ["/de", "/the", "/in", "/was", "/is", "/The"]
WIDE_NAMES = ["detail_de", "detail_the", "detail_in", "detail_was", "detail_is", "detail_The_cap"]

_DETAILS_CTE = f"""
  raw AS (SELECT page_id,
                 unnest(regexp_extract_all(html, {_DETAIL_RE_SQL}, 1)) AS label,
                 unnest(regexp_extract_all(html, {_DETAIL_RE_SQL}, 2)) AS value,
                 unnest(range(1, len(regexp_extract_all(html, {_DETAIL_RE_SQL}, 1)) + 1)) AS pos
          FROM pages),
  d AS (SELECT page_id, label,
               CASE WHEN label = 'Floor Area' THEN split_part(value, ' ', 1) ELSE value END AS value
        FROM raw
        QUALIFY row_number() OVER (PARTITION BY page_id, label ORDER BY pos DESC) = 1)
"""


@register("page_fields", f"""
    SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title,
           nullif(regexp_extract(html, '<h1>(.*?)</h1>', 1), '') AS heading,
           {_AD_SQL} AS ad_text, nullif(split_part({_AD_SQL}, ',', 1), '') AS province
    FROM pages""")
def page_fields(spark, sf_dir):
    from hearth.operators import extract
    return extract.page_fields(read_table(spark, sf_dir, "pages", ["page_id", "html"]))


@register("page_details_long", f"WITH {_DETAILS_CTE} SELECT page_id, label, value FROM d")
def page_details_long(spark, sf_dir):
    from hearth.operators import extract
    return extract.page_details_long(read_table(spark, sf_dir, "pages", ["page_id", "html"]))


@register("page_details_wide", f"WITH {_DETAILS_CTE} SELECT p.page_id, " + ", ".join(
    f"MAX(d.value) FILTER (WHERE d.label = '{lab}') AS {name}"
    for lab, name in zip(WIDE_LABELS, WIDE_NAMES))
    + " FROM pages p LEFT JOIN d ON p.page_id = d.page_id GROUP BY p.page_id")
def page_details_wide(spark, sf_dir):
    from hearth.operators import extract
    return extract.page_details_wide(read_table(spark, sf_dir, "pages", ["page_id", "html"]),
                                     WIDE_LABELS, WIDE_NAMES)


@register("page_details_all", f"""WITH {_DETAILS_CTE}
    SELECT page_id, COUNT(*) AS n_labels, string_agg(label || '=' || value, ';' ORDER BY label) AS details
    FROM d GROUP BY page_id""")
def page_details_all(spark, sf_dir):
    """Every label of a page, as one map (printed in label order)."""
    from hearth.operators import extract
    m = extract.page_details_map(read_table(spark, sf_dir, "pages", ["page_id", "html"]))
    pairs = F.sort_array(F.map_entries("details"))
    return m.where(F.size("details") > 0).select(
        "page_id", F.size("details").cast("long").alias("n_labels"),
        F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("details"))


@register("page_fields_merged", f"""WITH {_DETAILS_CTE},
    own AS (SELECT page_id, 'title' AS label, nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS value FROM pages
            UNION ALL SELECT page_id, 'heading', nullif(regexp_extract(html, '<h1>(.*?)</h1>', 1), '') FROM pages
            UNION ALL SELECT page_id, 'ad_text', {_AD_SQL} FROM pages)
    SELECT page_id, label, value FROM d
    UNION ALL
    SELECT page_id, label, value FROM own WHERE value IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM d WHERE d.page_id = own.page_id AND d.label = own.label)""")
def page_fields_merged(spark, sf_dir):
    """Listing-level fields overlaid with page-level ones (the right side wins)."""
    from hearth.operators import extract
    m = extract.merged_page_fields(read_table(spark, sf_dir, "pages", ["page_id", "html"]))
    return m.select("page_id", F.explode_outer("fields").alias("label", "value")).where(F.col("label").isNotNull())


@register("union_sources", with_listings(f"""
    SELECT page_id, nullif(split_part({_AD_SQL}, ',', 1), '') AS province,
           nullif(regexp_extract(html, '<h1>(.*?)</h1>', 1), '') AS address FROM pages
    UNION ALL BY NAME
    SELECT * FROM listings"""))
def union_sources(spark, sf_dir):
    from hearth.operators import extract
    pages = extract.page_records(read_table(spark, sf_dir, "pages", ["page_id", "html"]))
    return extract.append_sources(pages, listings(spark, sf_dir))


@register("province_from_address", with_listings(
    "SELECT address, split_part(address, ',', 1) AS address_head FROM listings"))
def province_from_address(spark, sf_dir):
    from hearth.operators.extract import text_before
    return listings(spark, sf_dir).select("address", text_before("address").alias("address_head"))


# --------------------------------------------------------------------------
# Features (F1-F9)
# --------------------------------------------------------------------------

_CATS = ["province", "construction_type", "balcony", "furniture"]


def _rank_cte(col: str, source: str = "listings") -> str:
    return (f"r_{col} AS (SELECT {col} AS label, CAST(row_number() OVER (ORDER BY n DESC, {col} ASC) - 1 "
            f"AS DOUBLE) AS idx FROM (SELECT {col}, COUNT(*) AS n FROM {source} WHERE {col} IS NOT NULL "
            f"GROUP BY {col})), n_{col} AS (SELECT CAST(COUNT(*) AS DOUBLE) AS k FROM r_{col})")


def _index_sql(cols: list[str], extra: list[str] | None = None) -> str:
    extra = extra or []
    sel = ", ".join(extra + [f"COALESCE(r_{c}.idx, n_{c}.k) AS {c}_indexed" for c in cols])
    joins = " ".join(f"LEFT JOIN r_{c} ON l.{c} = r_{c}.label CROSS JOIN n_{c}" for c in cols)
    return with_listings(f"SELECT {sel} FROM listings l {joins}", ", ".join(_rank_cte(c) for c in cols))


@register("category_index_keep", _index_sql(_CATS, ["l.address"]))
def category_index_keep(spark, sf_dir):
    from hearth.operators.features import string_indexer
    df = listings(spark, sf_dir)
    model = string_indexer(_CATS, "_indexed", "keep").fit(df)
    return model.transform(df).select("address", *[c + "_indexed" for c in _CATS])


@register("category_index_strict", _index_sql(["province", "construction_type"], ["l.address"]))
def category_index_strict(spark, sf_dir):
    from hearth.operators.features import string_indexer
    df = listings(spark, sf_dir)
    cols = ["province", "construction_type"]
    model = string_indexer(cols, "_indexed", "error").fit(df)
    return model.transform(df).select("address", *[c + "_indexed" for c in cols])


@register("address_index", with_listings(
    "SELECT l.address, COALESCE(r_address.idx, n_address.k) AS address_index "
    "FROM listings l LEFT JOIN r_address ON l.address = r_address.label CROSS JOIN n_address",
    _rank_cte("address")))
def address_index(spark, sf_dir):
    """Distributed frequency index of a near-unique column (no label list on the driver)."""
    from hearth.operators.features import frequency_index
    df = listings(spark, sf_dir).select("address")
    return frequency_index(df, "address", "address_index", "keep")


def _assembled_sql() -> str:
    feats = list(clean.NUMERIC_FEATURES_A)
    nan = "CAST('NaN' AS DOUBLE)"
    body = ", ".join(
        [f"ROUND(COALESCE(CAST(t.{c} AS DOUBLE), {nan}), 6) AS f{i}" for i, c in enumerate(feats)]
        + [f"ROUND(COALESCE(r_{c}.idx, n_{c}.k), 6) AS f{len(feats) + j}" for j, c in enumerate(_CATS)])
    joins = " ".join(f"LEFT JOIN r_{c} ON t.{c} = r_{c}.label CROSS JOIN n_{c}" for c in _CATS)
    ctes = (f"t AS (SELECT {typed_listings_sql(keep_address=True)} FROM listings), "
            + ", ".join(_rank_cte(c, "t") for c in _CATS))
    return with_listings(f"SELECT t.address, {body} FROM t {joins}", ctes)


@register("assembled_features", _assembled_sql())
def assembled_features(spark, sf_dir):
    """19 features assembled with handleInvalid='keep' (null -> NaN), unpacked."""
    from hearth.operators import features as fe
    t = clean.typed_listings(listings(spark, sf_dir), keep_address=True)
    t = fe.cast_double(t, clean.NUMERIC_FEATURES_A)
    cols = list(clean.NUMERIC_FEATURES_A) + [c + "_indexed" for c in _CATS]
    model = fe.pipeline(fe.string_indexer(_CATS, "_indexed", "keep"),
                        fe.assembler(cols, "features", "keep")).fit(t)
    return fe.unpack_vector(model.transform(t), ["address"], "features", len(cols), "f", 6)


_POLY_IN = ["l_quantity", "l_discount", "l_tax"]


@register("poly2_features", """
    SELECT l_orderkey, l_linenumber,
           ROUND(l_quantity, 6) AS p0, ROUND(l_quantity * l_quantity, 6) AS p1,
           ROUND(l_discount, 6) AS p2, ROUND(l_quantity * l_discount, 6) AS p3,
           ROUND(l_discount * l_discount, 6) AS p4, ROUND(l_tax, 6) AS p5,
           ROUND(l_quantity * l_tax, 6) AS p6, ROUND(l_discount * l_tax, 6) AS p7,
           ROUND(l_tax * l_tax, 6) AS p8
    FROM lineitem""")
def poly2_features(spark, sf_dir):
    from hearth.operators import features as fe
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"] + _POLY_IN)
    v = fe.assembler(_POLY_IN, "features", "error").transform(li)
    p = fe.poly_expansion("features", "poly", 2).transform(v)
    return fe.unpack_vector(p, ["l_orderkey", "l_linenumber"], "poly", 9, "p", 6)


_SCALE_IN = ["l_quantity", "l_extendedprice", "l_discount"]


@register("scaled_features", """
    WITH s AS (SELECT STDDEV_SAMP(l_quantity) AS s0, STDDEV_SAMP(l_extendedprice) AS s1,
                      STDDEV_SAMP(l_discount) AS s2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, ROUND(l_quantity / s0, 6) AS s0, ROUND(l_extendedprice / s1, 6) AS s1,
           ROUND(l_discount / s2, 6) AS s2
    FROM lineitem, s""")
def scaled_features(spark, sf_dir):
    from hearth.operators import features as fe
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"] + _SCALE_IN)
    v = fe.assembler(_SCALE_IN, "features", "error").transform(li)
    sc = fe.scaler("features", "scaled").fit(v).transform(v)
    return fe.unpack_vector(sc, ["l_orderkey", "l_linenumber"], "scaled", 3, "s", 6)


@register("stable_split", with_listings(
    "SELECT address, price, CASE WHEN CAST(('0x' || substr(md5(address), 1, 8)) AS BIGINT) % 100 < 80 "
    "THEN 'train' ELSE 'test' END AS split FROM listings"))
def stable_split(spark, sf_dir):
    from hearth.operators.features import hash_bucket
    df = listings(spark, sf_dir)
    return df.select("address", "price",
                     F.when(hash_bucket("address") < 80, "train").otherwise("test").alias("split"))


@register("random_split_counts")
def random_split_counts(spark, sf_dir):
    """The notebook's randomSplit([0.8, 0.2], 1234); partition-dependent, rows-only."""
    from hearth.operators.features import random_split
    train, test = random_split(listings(spark, sf_dir), (0.8, 0.2), 1234)
    return (train.select(F.lit("train").alias("split")).unionByName(test.select(F.lit("test").alias("split")))
                 .groupBy("split").agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------
# Models and evaluation (M1-M13)
# --------------------------------------------------------------------------

@register("ols_one_feature", """
    SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           ROUND(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
           COUNT(*) AS n
    FROM lineitem""")
def ols_one_feature(spark, sf_dir):
    from hearth.operators import features as fe
    from hearth.operators import models as mo
    li = read_table(spark, sf_dir, "lineitem", ["l_quantity", "l_extendedprice"])
    v = fe.assembler(["l_quantity"], "features", "error").transform(li)
    m = mo.linear_regression("features", "l_extendedprice", solver="normal").fit(v)
    s = m.summary
    return spark.createDataFrame(
        [(float(m.coefficients[0]), float(m.intercept), float(s.r2), int(s.numInstances))],
        "slope double, intercept double, r2 double, n bigint").select(
        F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.round("r2", 6).alias("r2"), "n")


_LI_KEY_SQL = "CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) % 100"


@register("ols_predictions_metrics", f"""
    WITH s AS (SELECT *, {_LI_KEY_SQL} AS b FROM lineitem),
         fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS c
                 FROM s WHERE b < 80),
         p AS (SELECT l_extendedprice AS y, fit.c + fit.a * l_quantity AS yhat FROM s, fit WHERE b >= 80),
         m AS (SELECT AVG(y) AS ybar FROM p)
    SELECT COUNT(*) AS n, ROUND(AVG(ABS(y - yhat)), 4) AS mae, ROUND(AVG((y - yhat) * (y - yhat)), 4) AS mse,
           ROUND(SQRT(AVG((y - yhat) * (y - yhat))), 4) AS rmse,
           ROUND(1 - SUM((y - yhat) * (y - yhat)) / SUM((y - ybar) * (y - ybar)), 4) AS r2
    FROM p, m""")
def ols_predictions_metrics(spark, sf_dir):
    from hearth.operators import features as fe
    from hearth.operators import models as mo
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    train, test = fe.hash_split(li, key, 80)
    asm = fe.assembler(["l_quantity"], "features", "error")
    m = mo.linear_regression("features", "l_extendedprice", solver="normal").fit(asm.transform(train))
    return mo.regression_metrics(m.transform(asm.transform(test)), "l_extendedprice", "prediction")


@register("regression_metrics", """
    WITH p AS (SELECT l.l_extendedprice AS y, l.l_quantity * pt.p_retailprice AS yhat
               FROM lineitem l JOIN part pt ON l.l_partkey = pt.p_partkey),
         m AS (SELECT AVG(y) AS ybar FROM p)
    SELECT COUNT(*) AS n, ROUND(AVG(ABS(y - yhat)), 4) AS mae, ROUND(AVG((y - yhat) * (y - yhat)), 4) AS mse,
           ROUND(SQRT(AVG((y - yhat) * (y - yhat))), 4) AS rmse,
           ROUND(1 - SUM((y - yhat) * (y - yhat)) / SUM((y - ybar) * (y - ybar)), 4) AS r2
    FROM p, m""")
def regression_metrics_query(spark, sf_dir):
    """Metrics of a formula prediction (quantity x list price) in one pass."""
    from hearth.operators import models as mo
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity", "l_extendedprice"])
    pt = read_table(spark, sf_dir, "part", ["p_partkey", "p_retailprice"])
    pred = li.join(pt, li.l_partkey == pt.p_partkey).select(
        "l_extendedprice", (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    return mo.regression_metrics(pred, "l_extendedprice", "prediction")


_KM_COLS = ["l_quantity", "l_discount"]


@register("kmeans_assign_given_centres", """
    WITH c AS (SELECT CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS id,
                      AVG(l_quantity) AS cq, AVG(l_discount) AS cd
               FROM lineitem GROUP BY l_returnflag),
         li AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM lineitem),
         d AS (SELECT l.rid, l.l_orderkey, l.l_linenumber, c.id,
                      (l.l_quantity - c.cq) * (l.l_quantity - c.cq) + (l.l_discount - c.cd) * (l.l_discount - c.cd) AS dist
               FROM li l CROSS JOIN c)
    SELECT l_orderkey, l_linenumber, id AS cluster FROM d
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, id) = 1""")
def kmeans_assign_given_centres(spark, sf_dir):
    """Assign every line item to the nearest of data-derived centres (per-return-flag means)."""
    from hearth.operators import models as mo
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"] + _KM_COLS)
    centres = (li.groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in _KM_COLS])
                 .orderBy("l_returnflag").collect())          # one row per flag value
    pts = [[r[c] for c in _KM_COLS] for r in centres]
    return mo.assign_to_centres(li, _KM_COLS, pts).select("l_orderkey", "l_linenumber", "cluster")


_SWEEP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# One feature, a label of about unit spread, five hash folds: the tuned model has a
# closed form (soft threshold on the standardised scale).
_TUNED_GRID = (0.01, 0.1, 1.0)
_FOLD_SQL = ("CAST(('0x' || substr(md5('fold:' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) % 5")


def _shrunk_sql(group: str) -> str:
    """Slope and intercept of the elastic net (half L1, half L2) from moments."""
    return f"""SELECT {group}, ax, ay, sx, sy,
             greatest(abs(r) - 0.5 * reg / sy, 0) * sign(r) / (1 + 0.5 * reg / sy) * sy / sx AS slope"""


def _line_prices(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return li.select(key.alias("key"), F.col("l_quantity").cast("double").alias("l_quantity"),
                     (F.col("l_extendedprice") / 10000 + F.col("l_quantity") / 10).cast("double").alias("price"))


@register("elastic_net_cv", f"""
    WITH s AS (SELECT {_FOLD_SQL} AS fold, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 10000.0 + l_quantity / 10.0 AS y FROM lineitem),
         g AS (SELECT unnest({list(_TUNED_GRID)}) AS reg), k AS (SELECT unnest(range(5)) AS held),
         m AS (SELECT held, reg, AVG(x) AS ax, AVG(y) AS ay, STDDEV_POP(x) AS sx, STDDEV_POP(y) AS sy, CORR(x, y) AS r
               FROM s, g, k WHERE fold <> held GROUP BY held, reg),
         c AS ({_shrunk_sql("held, reg")} FROM m),
         e AS (SELECT held, reg, SQRT(AVG((y - ay - slope * (x - ax)) * (y - ay - slope * (x - ax)))) AS rmse
               FROM s JOIN c ON s.fold = c.held GROUP BY held, reg),
         a AS (SELECT reg, AVG(rmse) AS mean_rmse FROM e GROUP BY reg),
         f AS (SELECT reg, ax, ay, slope FROM ({_shrunk_sql("reg")}
               FROM (SELECT reg, AVG(x) AS ax, AVG(y) AS ay, STDDEV_POP(x) AS sx, STDDEV_POP(y) AS sy, CORR(x, y) AS r
                     FROM s, g GROUP BY reg)))
    SELECT CAST(a.reg AS DOUBLE) AS reg_param, ROUND(mean_rmse, 4) AS mean_rmse, mean_rmse = MIN(mean_rmse) OVER () AS chosen,
           CASE WHEN mean_rmse = MIN(mean_rmse) OVER () THEN ROUND(slope, 4) END AS slope,
           CASE WHEN mean_rmse = MIN(mean_rmse) OVER () THEN ROUND(ay - slope * ax, 4) END AS intercept
    FROM a JOIN f ON a.reg = f.reg""")
def elastic_net_cv(spark, sf_dir):
    """Elastic net tuned over regParam by 5-fold cross-validation on hash folds:
    mean RMSE per grid point, and the refitted best model."""
    from hearth.operators import features as fe
    from hearth.operators import models as mo
    rows = fe.assembler(["l_quantity"], "features", "error").transform(fe.hash_folds(_line_prices(spark, sf_dir), "key", 5))
    rows = rows.select("features", "price", "fold").persist()
    try:
        net = mo.linear_regression("features", "price", elastic_net=mo.ELASTIC_NET_AS_WRITTEN)
        cv = mo.cross_validated(net, "price", _TUNED_GRID, 5, fold_col="fold").fit(rows)
    finally:
        rows.unpersist()
    best = min(range(len(_TUNED_GRID)), key=lambda k: cv.avgMetrics[k])
    table = [(reg, float(cv.avgMetrics[k]), k == best, float(cv.bestModel.coefficients[0]) if k == best else None,
              float(cv.bestModel.intercept) if k == best else None) for k, reg in enumerate(_TUNED_GRID)]
    return spark.createDataFrame(table, "reg_param double, mean_rmse double, chosen boolean, slope double, intercept double").select(
        "reg_param", F.round("mean_rmse", 4).alias("mean_rmse"), "chosen", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


# Line items of the three return flags, set 1000 apart: the best clusters are the flags.
_APART_SQL = """s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
                         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1000 ELSE 2000 END + l_quantity AS x,
                         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g FROM lineitem)"""


def _apart(spark, sf_dir):
    from hearth.operators import features as fe
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"])
    step = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1000).otherwise(2000)
    return fe.assembler(["x"], "features", "error").transform(li.withColumn("x", (step + F.col("l_quantity")).cast("double")))


def _silhouette_sql(rows: str, by: str) -> str:
    """Mean silhouette (squared distances) of the clusters g, per ``by``, from their sums."""
    return f"""SELECT {by}, AVG(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
        SELECT r.{by}, c.n, c.n * (r.x * r.x - 2 * r.x * c.m + c.q) / greatest(c.n - 1, 1) AS a,
               (SELECT MIN(r.x * r.x - 2 * r.x * o.m + o.q) FROM z o WHERE o.{by} = r.{by} AND o.g <> r.g) AS b
        FROM {rows} r JOIN z c ON c.{by} = r.{by} AND c.g = r.g) GROUP BY {by}"""


@register("kmeans_separated", f"""
    WITH {_APART_SQL},
         c AS (SELECT g, AVG(x) AS centre, COUNT(*) AS n, SUM(x * x) - SUM(x) * SUM(x) / COUNT(*) AS cost FROM s GROUP BY g),
         z AS (SELECT 1 AS one, g, COUNT(*) AS n, AVG(x) AS m, AVG(x * x) AS q FROM s GROUP BY g),
         t AS (SELECT *, 1 AS one FROM s)
    SELECT CAST(g AS INTEGER) AS cluster, ROUND(centre, 4) AS centre, n,
           ROUND((SELECT SUM(cost) FROM c), 1) AS wssse, ROUND((SELECT silhouette FROM ({_silhouette_sql('t', 'one')})), 6) AS silhouette
    FROM c""")
def kmeans_separated(spark, sf_dir):
    """k chosen by silhouette over a sweep, then the fit: centres, sizes, cost."""
    from hearth.operators import models as mo
    rows = _apart(spark, sf_dir).select("features").persist()
    try:
        sweep = mo.kmeans_sweep(rows, "features", (2, 3, 4)).collect()
        best = max(sweep, key=lambda r: r["silhouette"])
        model = mo.kmeans(best["k"], "features", "cluster").fit(rows)
        centres = [float(c[0]) for c in model.clusterCenters()]
        sizes = model.summary.clusterSizes
    finally:
        rows.unpersist()
    order = sorted(range(len(centres)), key=lambda k: centres[k])
    table = [(rank, centres[k], int(sizes[k]), best["wssse"], best["silhouette"]) for rank, k in enumerate(order)]
    return spark.createDataFrame(table, "cluster int, centre double, n bigint, wssse double, silhouette double").select(
        "cluster", F.round("centre", 4).alias("centre"), "n", F.round("wssse", 1).alias("wssse"), F.round("silhouette", 6).alias("silhouette"))


@register("silhouette_split", f"""
    WITH {_APART_SQL},
         t AS (SELECT *, CASE WHEN {_LI_KEY_SQL} < 80 THEN 'train' ELSE 'test' END AS split FROM s),
         z AS (SELECT split, g, COUNT(*) AS n, AVG(x) AS m, AVG(x * x) AS q FROM t GROUP BY split, g)
    SELECT split, ROUND(silhouette, 6) AS silhouette FROM ({_silhouette_sql('t', 'split')})""")
def silhouette_split(spark, sf_dir):
    """Clusters fitted on the training part; silhouette of either part."""
    from hearth.operators import features as fe
    from hearth.operators import models as mo
    rows = _apart(spark, sf_dir)
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    parts = dict(zip(("train", "test"), fe.hash_split(rows, key, 80)))
    model = mo.kmeans(3, "features", "cluster").fit(parts["train"])
    table = [(name, mo.silhouette(model.transform(part))) for name, part in parts.items()]
    return spark.createDataFrame(table, "split string, silhouette double").select("split", F.round("silhouette", 6).alias("silhouette"))


@register("cluster_feature_regression", f"""
    WITH {_APART_SQL},
         m AS (SELECT COUNT(*) AS n, VAR_POP(l_quantity) AS aa, VAR_POP(g) AS bb, COVAR_POP(l_quantity, g) AS ab,
                      COVAR_POP(l_quantity, l_extendedprice) AS ay, COVAR_POP(g, l_extendedprice) AS by_,
                      AVG(l_quantity) AS ma, AVG(g) AS mb, AVG(l_extendedprice) AS my, VAR_POP(l_extendedprice) AS yy FROM s),
         c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m),
         e AS (SELECT AVG(ABS(d)) AS mae, AVG(d * d) AS mse FROM
               (SELECT l_extendedprice - my - ca * (l_quantity - ma) - cb * (g - mb) AS d FROM s, c)),
         r AS (SELECT *, 1 - mse / yy AS r2 FROM c, e)
    SELECT u.metric, ROUND(u.value, 4) AS value FROM r, LATERAL (VALUES
      ('intercept', my - ca * ma - cb * mb), ('coef:l_quantity', ca), ('coef:cluster', cb), ('r2', r2),
      ('r2adj', 1 - (1 - r2) * (n - 1) / (n - 3)), ('rmse', SQRT(mse)), ('mse', mse), ('mae', mae)) u(metric, value)""")
def cluster_feature_regression(spark, sf_dir):
    """The fitted cluster (numbered by its centre) as a feature of a regression,
    and the regression's training summary."""
    from hearth.operators import features as fe
    from hearth.operators import models as mo
    rows = _apart(spark, sf_dir)
    model = mo.kmeans(3, "features", "raw_cluster").fit(rows)
    centres = [float(c[0]) for c in model.clusterCenters()]
    rank = F.array(*[F.lit(float(sorted(centres).index(c))) for c in centres])
    rows = model.transform(rows).withColumn("cluster", F.get(rank, F.col("raw_cluster")))
    names = ["l_quantity", "cluster"]
    rows = fe.assembler(names, "both", "error").transform(rows).select("both", "l_extendedprice")
    fit = mo.linear_regression("both", "l_extendedprice", solver="normal").fit(rows)
    return mo.training_summary(spark, fit, names).select("metric", F.round("value", 4).alias("value"))


@register("text_summary", with_listings(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, MIN({c}) AS min, MAX({c}) AS max FROM listings"
    for c in ("province", "construction_type", "address"))))
def text_summary(spark, sf_dir):
    return profile.text_summary(listings(spark, sf_dir), ["province", "construction_type", "address"])


@register("index_fit_apply", with_listings("""
    SELECT l.address, COALESCE(r.idx, (SELECT COUNT(*) FROM r)) AS address_index FROM listings l LEFT JOIN r ON l.address = r.address
    WHERE CAST(('0x' || substr(md5(coalesce(l.address, '')), 1, 8)) AS BIGINT) % 100 >= 50 OR l.address LIKE '%1%'""",
    """r AS (SELECT address, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, address) - 1 AS DOUBLE) AS idx FROM listings
            WHERE CAST(('0x' || substr(md5(coalesce(address, '')), 1, 8)) AS BIGINT) % 100 < 50 GROUP BY address)"""))
def index_fit_apply(spark, sf_dir):
    """The index fitted on one batch of listings and applied to another (unseen addresses among them)."""
    from hearth.operators.features import fit_index, hash_bucket
    df = listings(spark, sf_dir).select("address")
    half = hash_bucket(F.coalesce(F.col("address"), F.lit("")))
    model = fit_index(df.where(half < 50), ["address"])
    return model.transform(df.where((half >= 50) | F.col("address").like("%1%")))


@register("random_split_whole", with_listings("SELECT COUNT(*) AS n, COUNT(DISTINCT address) AS n_addresses FROM listings"))
def random_split_whole(spark, sf_dir):
    """Both parts of a random split together are the table."""
    from hearth.operators.features import random_split
    train, test = random_split(listings(spark, sf_dir), (0.8, 0.2), 1234)
    return train.unionByName(test).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("address").alias("n_addresses"))


@register("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    """(k, wssse, silhouette) for k = 2..10 over line-item measures (rows-only)."""
    from hearth.operators import features as fe
    from hearth.operators import models as mo
    li = read_table(spark, sf_dir, "lineitem", _SWEEP_COLS)
    v = fe.assembler(_SWEEP_COLS, "raw", "error").transform(li)
    v = fe.scaler("raw", "features").fit(v).transform(v)
    return mo.kmeans_sweep(v, "features")


@register("ridge_price_model")
def ridge_price_model(spark, sf_dir):
    """Workflow A end to end: test metrics of the CV-tuned elastic-net model (rows-only)."""
    from hearth.plans import ridge_price
    return ridge_price.metrics_table(listings(spark, sf_dir))


@register("cluster_price_model")
def cluster_price_model(spark, sf_dir):
    """Workflow B end to end: sweep, clusters, regression with cluster (rows-only)."""
    from hearth.plans import cluster_price
    return cluster_price.run(listings(spark, sf_dir))


# --------------------------------------------------------------------------
# File round trip and streaming ingestion (S1, S7; incremental path)
# --------------------------------------------------------------------------

@register("listings_csv_roundtrip", with_listings("SELECT * FROM listings"))
def listings_csv_roundtrip(spark, sf_dir):
    """Write the listing table as CSV to the shared folder and read it back schema-first."""
    from hearth.session import scratch_path
    from hearth.sources.files import read_csv, write_csv
    path = scratch_path(spark, "listings-csv")
    write_csv(listings(spark, sf_dir), path)
    return read_csv(spark, path)


@register("streaming_province_price", with_listings(
    "SELECT province, COUNT(*) AS n_listings, ROUND(AVG(price), 4) AS mean_price FROM p GROUP BY province",
    _PRICED_CTE))
def streaming_province_price(spark, sf_dir):
    """Listing drops streamed through the price parser into a running per-province state."""
    from hearth.session import scratch_path
    from hearth.sources.files import write_parquet
    from hearth.streaming import listing_stream as ls
    src = scratch_path(spark, "listing-drops")
    write_parquet(listings(spark, sf_dir), src)
    agg = ls.province_price_state(ls.listing_stream(spark, src, "parquet"))
    last = ls.run_available(agg, scratch_path(spark, "province-state"),
                            scratch_path(spark, "province-state-ckpt"))
    return ls.province_price_from_state(spark, last)


@register("actual_vs_predicted_bins", """
    WITH p AS (SELECT CAST(l.l_extendedprice AS DOUBLE) AS y, l.l_quantity * pt.p_retailprice AS yhat
               FROM lineitem l JOIN part pt ON l.l_partkey = pt.p_partkey),
         r AS (SELECT MIN(y) AS y0, MAX(y) AS y1, MIN(yhat) AS p0, MAX(yhat) AS p1 FROM p)
    SELECT CAST(LEAST(FLOOR((y - y0) / (y1 - y0) * 20), 19) + 1 AS INTEGER) AS x_bin,
           CAST(LEAST(FLOOR((yhat - p0) / (p1 - p0) * 20), 19) + 1 AS INTEGER) AS y_bin,
           COUNT(*) AS n
    FROM p, r GROUP BY 1, 2""")
def actual_vs_predicted_bins(spark, sf_dir):
    """(actual, predicted) pairs as 20x20 bin counts (the scatter's data, bounded)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity", "l_extendedprice"])
    pt = read_table(spark, sf_dir, "part", ["p_partkey", "p_retailprice"])
    pred = li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("predicted"))
    return profile.binned_pairs(pred, "actual", "predicted", 20)


@register("iqr_outliers_events",
          """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
             SELECT event_id, value FROM events, b
             WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers_events(spark, sf_dir):
    """IQR outliers of event values (a heavy-tailed column with real outliers)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "value"])
    _, out, _ = outliers.split_outliers(ev, "value", relative_error=None)
    return out


@register("boxplot_events_value", """
    WITH p AS (SELECT value AS price FROM events),
         b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM p),
         f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b),
         k AS (SELECT p.price FROM p, f WHERE p.price >= f.lo AND p.price <= f.hi),
         s AS (SELECT 'with_outliers' AS series, price FROM p WHERE price IS NOT NULL
               UNION ALL SELECT 'without_outliers' AS series, price FROM k),
         q AS (SELECT series, COUNT(*) AS n, quantile_cont(price, 0.25) AS q1,
                      quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.75) AS q3
               FROM s GROUP BY series)
    SELECT q.series, q.n, ROUND(q.q1, 4) AS q1, ROUND(q.med, 4) AS median, ROUND(q.q3, 4) AS q3,
           ROUND(q.q3 - q.q1, 4) AS iqr,
           ROUND(MIN(s.price) FILTER (WHERE s.price >= q.q1 - 1.5 * (q.q3 - q.q1)), 4) AS whisker_low,
           ROUND(MAX(s.price) FILTER (WHERE s.price <= q.q3 + 1.5 * (q.q3 - q.q1)), 4) AS whisker_high,
           CAST(SUM(CASE WHEN s.price < q.q1 - 1.5 * (q.q3 - q.q1)
                           OR s.price > q.q3 + 1.5 * (q.q3 - q.q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_fliers
    FROM q JOIN s ON q.series = s.series
    GROUP BY q.series, q.n, q.q1, q.med, q.q3""")
def boxplot_events_value(spark, sf_dir):
    """Box-plot statistics of event values before and after the IQR cut."""
    ev = read_table(spark, sf_dir, "events", ["value"])
    return profile.boxplot_with_and_without_outliers(ev, "value")
