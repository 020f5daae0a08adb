"""Listing extraction from raw HTML pages, as a Spark job over a ``pages`` table.

The source workflow drives a browser over a listings site and turns each
page into a dict.  Here the pages are rows (``page_id, url, html``) and the
extraction is SQL regex and higher-order functions, all JVM-side and
row-local (no shuffle):

* one text per locator (``regexp_extract``),
* detail (label, value) pairs from ``<li><a href="label">value</a></li>``:
  where a page marks a ``building`` and an ``apartment`` list, the first 4 of
  the one and the first 8 of the other, concatenated; else all of the page's,
* later labels win over earlier ones (the dict update in the source),
* ``Floor Area`` keeps only the text before the first space,
* province = text before the first comma,
* an absent field is null,
* listing-level and page-level fields merged, the page's winning,
* page records and listing records appended by column name.

Each regex runs once per page: its result is a column of its own projection,
and everything after works on that column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the source: how many details each block contributes, the
# label whose unit is stripped, and the province separator.
BUILDING_DETAILS = 4
APARTMENT_DETAILS = 8
UNIT_STRIPPED_LABEL = "Floor Area"
PROVINCE_SEPARATOR = ","

# Locators in our page layout.
TITLE_RE = r"<title>(.*?)</title>"
HEADING_RE = r"<h1>(.*?)</h1>"
AD_RE = r'<div class="ad">(.*?)</div>'
DETAIL_RE = r'<li><a href="([^"]*)">(.*?)</a></li>'
BUILDING_RE = r'(?s)<ul class="building">(.*?)</ul>'
APARTMENT_RE = r'(?s)<ul class="apartment">(.*?)</ul>'


def text_before(c: Column | str, sep: str = PROVINCE_SEPARATOR) -> Column:
    """Text before the first ``sep`` (the whole text if absent)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring_index(c, sep, 1)


def _field(html: Column, pattern: str) -> Column:
    """The first group of the first match; null if there is none (or it is empty)."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, ad_text, province) -- one text per locator."""
    html = F.col("html")
    fields = pages.select("page_id", _field(html, TITLE_RE).alias("title"), _field(html, HEADING_RE).alias("heading"),
                          _field(html, AD_RE).alias("ad_text"))
    return fields.withColumn("province", F.nullif(text_before("ad_text"), F.lit("")))


def _pairs(df: DataFrame, block: str, out: str, most: int | None = None) -> DataFrame:
    """Adds ``out``: array<struct<label, value>> of a text column's details."""
    labels, values = f"_l_{out}", f"_v_{out}"
    df = df.withColumns({labels: F.regexp_extract_all(F.col(block), F.lit(DETAIL_RE), 1),
                         values: F.regexp_extract_all(F.col(block), F.lit(DETAIL_RE), 2)})
    pairs = F.arrays_zip(F.col(labels).alias("label"), F.col(values).alias("value"))
    pairs = pairs if most is None else F.slice(pairs, 1, most)
    return df.withColumn(out, F.coalesce(pairs, F.array().cast("array<struct<label:string,value:string>>"))).drop(labels, values)


def with_details(pages: DataFrame, out: str = "details") -> DataFrame:
    """``page_id`` and the page's details, in order, each label once: the later
    one wins; the unit is stripped from ``Floor Area``."""
    blocks = pages.select("page_id", "html", _field(F.col("html"), BUILDING_RE).alias("_building"),
                          _field(F.col("html"), APARTMENT_RE).alias("_apartment"))
    marked = F.col("_building").isNotNull() | F.col("_apartment").isNotNull()
    df = blocks.select("page_id", "_building", "_apartment", F.when(~marked, F.col("html")).alias("_page"))
    df = _pairs(df, "_building", "_b", BUILDING_DETAILS)
    df = _pairs(df, "_apartment", "_a", APARTMENT_DETAILS)
    df = _pairs(df, "_page", "_p")
    # By label and position; a label's last position is followed by another label.
    placed = F.transform(F.concat("_b", "_a", "_p"), lambda p, i: F.struct(p["label"].alias("label"), i.alias("pos"), p["value"].alias("value")))
    df = df.select("page_id", F.sort_array(placed).alias("_sorted"))
    last = F.filter("_sorted", lambda p, i: ~F.get(F.col("_sorted"), i + 1)["label"].eqNullSafe(p["label"]))
    df = df.select("page_id", F.sort_array(F.transform(last, lambda p: F.struct(p["pos"], p["label"], p["value"]))).alias("_last"))
    cleaned = F.transform("_last", lambda p: F.struct(
        p["label"].alias("label"),
        F.when(p["label"] == UNIT_STRIPPED_LABEL, F.substring_index(p["value"], " ", 1)).otherwise(p["value"]).alias("value")))
    return df.select("page_id", cleaned.alias(out))


def page_details_long(pages: DataFrame) -> DataFrame:
    """(page_id, label, value) rows, one per surviving detail.

    The outer generator keeps the optimizer from inferring a filter on the
    array's size and evaluating the whole extraction a second time for it.
    """
    return with_details(pages).select("page_id", F.inline_outer("details")).where(F.col("label").isNotNull())


def page_details_map(pages: DataFrame) -> DataFrame:
    """(page_id, details map<label, value>) with every label of the page."""
    return with_details(pages).select("page_id", F.map_from_entries("details").alias("details"))


def page_details_wide(pages: DataFrame, labels: list[str], names: list[str] | None = None) -> DataFrame:
    """One column per declared label (absent -> null), like dict keys -> columns."""
    names = names or labels
    m = page_details_map(pages)
    return m.select("page_id", *[F.col("details")[lab].alias(n) for lab, n in zip(labels, names)])


def frequent_labels(details: DataFrame, most: int) -> list[str]:
    """The ``most`` labels that the most pages have (ties by label), from
    ``page_details_long``: at most ``most`` rows reach the driver."""
    counts = details.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return [r["label"] for r in counts.orderBy(F.col("n").desc(), "label").limit(most).collect()]


def page_details_columns(pages: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """(page_id, detail_1 .. detail_most, rest) and the labels of the columns.

    The columns are declared from the data: a grouped count names the most
    frequent labels, all other pairs stay in the map ``rest``, so every pair of
    a page is in its row."""
    details = with_details(pages)
    labels = frequent_labels(details.select(F.inline_outer("details")).where(F.col("label").isNotNull()), most)
    m = details.select("page_id", F.map_from_entries("details").alias("m"))
    own = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    cols = [F.try_element_at("m", F.lit(labels[k])) if k < len(labels) else F.lit(None).cast("string") for k in range(most)]
    rest = F.map_filter("m", lambda key, _: ~F.array_contains(own, key))
    return m.select("page_id", *[c.alias(f"detail_{k + 1}") for k, c in enumerate(cols)], rest.alias("rest")), labels


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key, the right one's value wins (null too)."""
    return F.map_zip_with(left, right, lambda k, a, b: F.when(F.map_contains_key(right, k), b).otherwise(a))


def merged_page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, fields): the listing-level fields of a page (those that it has),
    overlaid with its details."""
    own = page_fields(pages).select("page_id", F.map_filter(
        F.create_map(*[x for c in ("title", "heading", "ad_text") for x in (F.lit(c), F.col(c))]),
        lambda _, v: v.isNotNull()).alias("_own"))
    rows = own.join(page_details_map(pages), "page_id")
    return rows.select("page_id", merged(F.col("_own"), F.col("details")).alias("fields"))


def page_records(pages: DataFrame) -> DataFrame:
    """Listing-shaped records from pages: (page_id, province, address)."""
    f = page_fields(pages)
    return f.select("page_id", "province", F.col("heading").alias("address"))


def append_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column missing from a source is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
