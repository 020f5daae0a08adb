"""Registered queries of saved workflows, drops, stored sketches and checked files."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.parse import price_usd
from hearth.operators import extract, features, models, profile, sketches
from hearth.operators.stages import ClusterColumns, Doubles, FrequencyIndexer
from hearth.plans.oracle_sql import price_intended_sql
from hearth.plans.registry import _APART_SQL, _DETAILS_CTE, _apart, register
from hearth.session import scratch_path
from hearth.sources import files
from hearth.sources.listings import RAW_COLUMNS, listings, with_listings
from hearth.sources.tables import read_table
from hearth.streaming import drops, listing_stream

# ---- saved workflow (F9, M5) ---------------------------------------------

TRAIN_PCT = 80
_KEY_SQL = "CAST(('0x' || substr(md5(address), 1, 8)) AS BIGINT) % 100"
#: Frequency index of the province on the training rows, and the regression of
#: the price on floor area and that index by its normal equations.
_FITTED_SQL = f"""
  u AS (SELECT address, province, CAST(floor_area AS DOUBLE) AS a, {price_intended_sql()} AS y, {_KEY_SQL} < {TRAIN_PCT} AS train FROM listings),
  t AS (SELECT * FROM u WHERE train AND y IS NOT NULL),
  r AS (SELECT province, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, province) - 1 AS DOUBLE) AS i FROM t GROUP BY province),
  f AS (SELECT u.*, COALESCE(r.i, (SELECT COUNT(*) FROM r)) AS i FROM u LEFT JOIN r USING (province)),
  m AS (SELECT VAR_POP(a) AS aa, VAR_POP(i) AS ii, COVAR_POP(a, i) AS ai, COVAR_POP(a, y) AS ay, COVAR_POP(i, y) AS iy,
               AVG(a) AS ma, AVG(i) AS mi, AVG(y) AS my FROM f WHERE train AND y IS NOT NULL),
  c AS (SELECT *, (ay * ii - iy * ai) / (aa * ii - ai * ai) AS ca, (iy * aa - ay * ai) / (aa * ii - ai * ai) AS ci FROM m)"""
_SCORES_SQL = "SELECT f.address, ROUND(my + ca * (f.a - ma) + ci * (f.i - mi), 1) AS prediction FROM f, c"


def _price_workflow() -> Pipeline:
    """Raw listings -> typed columns -> province index -> regression, as one pipeline."""
    return features.pipeline(
        ClusterColumns("intended"), FrequencyIndexer(inputCols=["province"], outputCols=["province_at"], handleInvalid="keep"),
        Doubles(inputCols=["floor_area"]), features.assembler(["floor_area", "province_at"], "features", "keep"),
        models.linear_regression("features", "price", solver="normal"))


def _trained(spark, sf_dir) -> str:
    """Fits the workflow on the training listings and saves it; the folder."""
    raw = listings(spark, sf_dir)
    train = raw.where((features.hash_bucket("address") < TRAIN_PCT) & price_usd("price").isNotNull())
    path = scratch_path(spark, "price-workflow")
    _price_workflow().fit(train).write().save(path)
    return path


@register("saved_workflow_scores", with_listings(_SCORES_SQL + " WHERE NOT f.train", _FITTED_SQL.strip()))
def saved_workflow_scores(spark, sf_dir):
    """A workflow fitted, saved, loaded again and applied to the held-out listings."""
    model = PipelineModel.load(_trained(spark, sf_dir))
    held_out = listings(spark, sf_dir).where(features.hash_bucket("address") >= TRAIN_PCT)
    return model.transform(held_out).select("address", F.round("prediction", 1).alias("prediction"))


# ---- drops (M5, A5, A6) --------------------------------------------------

N_DROPS = 3


def _drop_of(df: DataFrame) -> DataFrame:
    """The listings dealt to drops, some rows to two of them."""
    k = features.hash_bucket("address", N_DROPS)
    return df.withColumn("_drops", F.array_distinct(F.array(k, F.pmod(k + F.when(F.col("floor_area") % 4 == 0, 1).otherwise(0), F.lit(N_DROPS)))))


def _arrive(spark, sf_dir, folder: str, drop: int) -> None:
    """Files of one drop arrive."""
    rows = _drop_of(listings(spark, sf_dir)).where(F.array_contains("_drops", drop))
    rows.drop("_drops").write.mode("append").parquet(folder)


@register("streaming_scores", with_listings(f"""{_SCORES_SQL}
    UNION ALL {_SCORES_SQL} WHERE f.a % 4 = 0""", _FITTED_SQL.strip()))
def streaming_scores(spark, sf_dir):
    """Listings scored by the loaded workflow as their drops arrive, the query started anew for each."""
    model = PipelineModel.load(_trained(spark, sf_dir))
    source, out, ckpt = (scratch_path(spark, n) for n in ("scored-drops", "scores", "scores-ckpt"))
    for drop in range(N_DROPS):
        _arrive(spark, sf_dir, source, drop)
        drops.append_available(drops.scored(listing_stream.listing_stream(spark, source), model, ["address"]), out, ckpt)
    return spark.read.parquet(out).select("address", F.round("prediction", 1).alias("prediction"))


def _deduplicated(spark, sf_dir) -> tuple[str, str]:
    """All drops through the row state and the counter: folders of the new rows and the last count."""
    source, out, ckpt = (scratch_path(spark, n) for n in ("dedup-drops", "new-rows", "new-rows-ckpt"))
    counts, counts_ckpt, last = scratch_path(spark, "row-counts"), scratch_path(spark, "row-counts-ckpt"), None
    for drop in range(N_DROPS):
        _arrive(spark, sf_dir, source, drop)
        drops.append_available(drops.new_rows(listing_stream.listing_stream(spark, source)), out, ckpt)
        last = listing_stream.run_available(drops.row_counter(listing_stream.listing_stream(spark, source)), counts, counts_ckpt) or last
    return out, last


@register("streaming_dedup_rows", with_listings("SELECT DISTINCT * FROM listings"))
def streaming_dedup_rows(spark, sf_dir):
    """Rows new to their drop and all earlier ones, over drops that repeat rows."""
    return spark.read.parquet(_deduplicated(spark, sf_dir)[0]).select(*RAW_COLUMNS)


@register("streaming_duplicate_report", with_listings("""
    SELECT n AS total_rows, u AS unique_rows, n - u AS duplicate_rows FROM
      (SELECT CAST(COUNT(*) + COUNT(*) FILTER (floor_area % 4 = 0) AS BIGINT) AS n FROM listings),
      (SELECT COUNT(*) AS u FROM (SELECT DISTINCT * FROM listings))"""))
def streaming_duplicate_report(spark, sf_dir):
    """The running duplicate report after the last drop."""
    unique, counted = _deduplicated(spark, sf_dir)
    return drops.duplicate_report(spark, counted, unique)


# ---- stored sketches (A9) ------------------------------------------------

_PROBABILITIES = [0.05, 0.25, 0.5, 0.75, 0.95]


@register("stored_sketch_quantiles", with_listings(
    f"""SELECT province, p.probability, COUNT(price) AS n, TRUE AS within_error
        FROM (SELECT province, {price_intended_sql()} AS price FROM listings),
             (SELECT unnest({_PROBABILITIES}::DOUBLE[]) AS probability) p
        GROUP BY province, p.probability"""))
def stored_sketch_quantiles(spark, sf_dir):
    """Price quantiles per province from sketches stored drop by drop (one drop
    written twice), each estimate's true rank checked against its error bound."""
    priced = listings(spark, sf_dir).select("province", features.hash_bucket("address", N_DROPS).alias("drop"), price_usd("price").alias("price"))
    store = scratch_path(spark, "price-sketches")
    for drop in [*range(N_DROPS), 0]:
        sketches.add_drop(priced.where(F.col("drop") == drop), drop, ["province"], "price", store)
    found = sketches.quantiles(sketches.stored(spark, store), ["province"], _PROBABILITIES)
    errors = sketches.rank_errors(priced, ["province"], "price", found)
    return errors.select("province", "probability", "n", (F.col("rank_error") <= sketches.RANK_ERROR).alias("within_error"))


@register("stored_sketch_moments", with_listings(
    f"""SELECT province, COUNT(*) AS n_rows, COUNT(price) AS n, ROUND(AVG(price), 4) AS mean, MIN(price) AS min, MAX(price) AS max
        FROM (SELECT province, {price_intended_sql()} AS price FROM listings WHERE {_KEY_SQL.replace('100', str(N_DROPS))} <> 1) GROUP BY province"""))
def stored_sketch_moments(spark, sf_dir):
    """Counts, means and ranges of two of the stored drops, no listing read again."""
    priced = listings(spark, sf_dir).select("province", features.hash_bucket("address", N_DROPS).alias("drop"), price_usd("price").alias("price"))
    store = scratch_path(spark, "price-sketches")
    for drop in range(N_DROPS):
        sketches.add_drop(priced.where(F.col("drop") == drop), drop, ["province"], "price", store)
    m = sketches.merged(sketches.stored(spark, store, [0, 2]), ["province"])
    return m.select("province", "n_rows", "n", F.round(F.col("total") / F.col("n"), 4).alias("mean"), F.col("least").alias("min"), F.col("most").alias("max"))


# ---- profile with the write (A1, A3, A11, A14) ---------------------------

_PROFILED = ("floors_in_building", "floor_area", "floor")


def _profile_sql() -> str:
    parts = []
    for c in RAW_COLUMNS:
        x = f"CAST({c} AS DOUBLE)" if c in _PROFILED else "CAST(NULL AS DOUBLE)"
        count = f"COUNT({c})" if c in _PROFILED else "CAST(NULL AS BIGINT)"
        parts.append(f"""SELECT '{c}' AS "column", COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS missing_count, {count} AS count,
            ROUND(AVG({x}), 4) AS mean, ROUND(STDDEV_SAMP({x}), 4) AS stddev, MIN({x}) AS min, MAX({x}) AS max FROM listings""")
    return " UNION ALL ".join(parts)


@register("profile_while_staging", with_listings(_profile_sql()))
def profile_while_staging(spark, sf_dir):
    """Missing counts and summary of all columns, collected by the write of the listings."""
    _, report = profile.profile_while_staging(listings(spark, sf_dir), "profiled", list(_PROFILED))
    return report.select("column", "n_rows", "missing_count", "count", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max")


# ---- malformed lines (S1) ------------------------------------------------

_SHORT, _LONG = "floor_area % 17 = 3", "floor_area % 17 = 5"


def _dirty_csv(spark, sf_dir) -> str:
    """The listings as CSV lines, some cut off after five fields, some with two fields too many."""
    rows = listings(spark, sf_dir)
    options = {"quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    whole = F.to_csv(F.struct(*RAW_COLUMNS), options)
    line = F.when(F.expr(_SHORT), F.to_csv(F.struct(*RAW_COLUMNS[:5]), options)).when(F.expr(_LONG), F.concat(whole, F.lit(",x,y"))).otherwise(whole)
    path = scratch_path(spark, "dirty-csv")
    rows.select(line.alias("value")).write.text(path)
    return path


@register("csv_malformed_lines", with_listings(f"""
    SELECT CASE WHEN {_SHORT} THEN 'short' WHEN {_LONG} THEN 'long' ELSE 'sound' END AS fault, COUNT(*) AS n_lines FROM listings GROUP BY 1"""))
def csv_malformed_lines(spark, sf_dir):
    """Lines of a CSV by what is wrong with them; none is lost."""
    return files.malformed_report(files.read_csv_checked(spark, _dirty_csv(spark, sf_dir), RAW_COLUMNS), len(RAW_COLUMNS))


@register("csv_sound_rows", with_listings(
    f"SELECT province, address, price, CAST(floor AS VARCHAR) AS floor FROM listings WHERE NOT ({_SHORT}) AND NOT ({_LONG})"))
def csv_sound_rows(spark, sf_dir):
    """The rows of the sound lines, as they were written."""
    rows = files.read_csv_checked(spark, _dirty_csv(spark, sf_dir), RAW_COLUMNS)
    return rows.where(F.col(files.MALFORMED).isNull()).select("province", "address", "price", "floor")


# ---- label columns from the data (X8), marked lists (X3, X6) -------------

_N_LABELS = 6


@register("page_details_columns", f"""WITH {_DETAILS_CTE},
    top AS (SELECT label, row_number() OVER (ORDER BY COUNT(*) DESC, label) AS k FROM d GROUP BY label QUALIFY k <= {_N_LABELS})
    SELECT p.page_id, {', '.join(f"MAX(d.value) FILTER (WHERE top.k = {k}) AS detail_{k}" for k in range(1, _N_LABELS + 1))},
           COALESCE(string_agg(d.label || '=' || d.value, ';' ORDER BY d.label) FILTER (WHERE top.k IS NULL AND d.label IS NOT NULL), '') AS rest
    FROM pages p LEFT JOIN d ON p.page_id = d.page_id LEFT JOIN top ON top.label = d.label GROUP BY p.page_id""")
def page_details_columns(spark, sf_dir):
    """The most frequent labels as columns, every other pair in the rest."""
    wide, _ = extract.page_details_columns(read_table(spark, sf_dir, "pages", ["page_id", "html"]), _N_LABELS)
    rest = F.array_join(F.transform(F.sort_array(F.map_entries("rest")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return wide.withColumn("rest", rest)



@register("page_marked_lists", r"""
    WITH p AS (SELECT page_id, page_id % 7 AS nb, page_id % 11 AS na FROM pages),
    b AS (SELECT page_id, unnest(range(1, least(nb, 4) + 1)) AS k FROM p),
    a AS (SELECT page_id, unnest(range(1, least(na, 8) + 1)) AS k FROM p)
    SELECT page_id, 'building ' || k AS label, 'b' || k || ' of ' || page_id AS value FROM b
    UNION ALL SELECT page_id, 'apartment ' || k, 'a' || k || ' of ' || page_id FROM a
    UNION ALL SELECT page_id, 'Floor Area', CAST(30 + page_id % 90 AS VARCHAR) FROM p WHERE nb > 0 AND nb < 4""")
def page_marked_lists(spark, sf_dir):
    """Pages rewritten to hold marked lists and a unit: the first 4 and 8 details, the unit stripped."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "html"])

    def items(name: str, n):
        one = lambda k: F.concat(F.lit(f'<li><a href="{name} '), k.cast("string"), F.lit(f'">{name[0]}'), k.cast("string"),
                                 F.lit(" of "), F.col("page_id").cast("string"), F.lit("</a></li>"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), one), "")).otherwise(F.lit(""))

    area = F.concat(F.lit('<li><a href="Floor Area">'), (30 + F.col("page_id") % 90).cast("string"), F.lit(" sq m</a></li>"))
    building = F.concat(items("building", F.col("page_id") % 7), F.when(F.col("page_id") % 7 > 0, area).otherwise(F.lit("")))
    apartment = items("apartment", F.col("page_id") % 11)
    html = F.concat(F.col("html"), F.lit('<ul class="building">'), building, F.lit('</ul><ul class="apartment">'), apartment, F.lit("</ul>"))
    # a page whose lists are both empty has no marked details
    marked = pages.select("page_id", F.when(F.col("page_id") % 77 == 0, F.lit("<p></p>")).otherwise(html).alias("html"))
    return extract.page_details_long(marked)


# ---- repeatable sample (A18, S6) -----------------------------------------

_SAMPLED = 40


@register("actual_vs_predicted_sample", f"""
    SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice AS actual, l_quantity * p_retailprice AS predicted
    FROM lineitem JOIN part ON l_partkey = p_partkey
    QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR))) <= {_SAMPLED}""")
def actual_vs_predicted_sample(spark, sf_dir):
    """A bounded, repeatable sample of (actual, predicted) pairs for each return flag."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice"])
    pt = read_table(spark, sf_dir, "part", ["p_partkey", "p_retailprice"])
    pairs = li.join(pt, li.l_partkey == pt.p_partkey).select(
        "l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * F.col("p_retailprice")).alias("predicted"))
    return profile.bottom_k(pairs, F.concat_ws("-", "l_orderkey", "l_linenumber"), _SAMPLED, ["l_returnflag"])


# ---- partitioned sink (S7) -----------------------------------------------

@register("partition_overwrite", with_listings("""
    SELECT address, CASE WHEN province = 'NATION_7' THEN floor_area + 1000 ELSE floor_area END AS floor_area, province FROM listings
    WHERE province IN ('NATION_7', 'NATION_11')"""))
def partition_overwrite(spark, sf_dir):
    """Listings by province, one province written again: the others stay; a read of two opens their folders only."""
    path = scratch_path(spark, "by-province")
    rows = listings(spark, sf_dir).select("address", "floor_area", "province")
    files.overwrite_partitions(rows, path, ["province"])
    again = rows.where(F.col("province") == "NATION_7").withColumn("floor_area", F.col("floor_area") + 1000)
    files.overwrite_partitions(again, path, ["province"])
    return spark.read.schema(rows.schema).parquet(path).where(F.col("province").isin("NATION_7", "NATION_11"))


# ---- SQL text (S3, P9) ---------------------------------------------------

@register("price_usd_sql_text", with_listings(f"""
    SELECT split_part(address, ',', 1) AS street, TRY_CAST(rooms AS INTEGER) AS rooms, ROUND({price_intended_sql()}, 4) AS price
    FROM listings WHERE {price_intended_sql()} >= 200000"""))
def price_usd_sql_text(spark, sf_dir):
    """The cleaning written in SQL only, with SQL-defined functions and a parameter."""
    from hearth.functions.sql import register_functions
    register_functions(spark)
    return spark.sql("""SELECT text_before(address) AS street, whole_number(rooms) AS rooms, round(price_usd(price), 4) AS price
                        FROM {rows} WHERE price_usd(price) >= :least""", args={"least": 200000.0}, rows=listings(spark, sf_dir))


# ---- cluster as one-hot flags (M13) --------------------------------------

@register("cluster_one_hot_regression", f"""
    WITH {_APART_SQL},
         x AS (SELECT g, AVG(l_quantity) AS mx, AVG(l_extendedprice) AS my, SUM(1) AS n, REGR_SXX(l_extendedprice, l_quantity) AS sxx,
                      REGR_SXY(l_extendedprice, l_quantity) AS sxy FROM s GROUP BY g),
         b AS (SELECT SUM(sxy) / SUM(sxx) AS b FROM x),
         a AS (SELECT g, my - b * mx AS a FROM x, b),
         l AS (SELECT a AS a2 FROM a WHERE g = 2)
    SELECT 'coef:l_quantity' AS metric, ROUND(b, 3) AS value FROM b UNION ALL SELECT 'intercept', ROUND(a2, 3) FROM l
    UNION ALL SELECT 'coef:cluster_' || CAST(g AS INTEGER), ROUND(a - a2, 3) FROM a, l WHERE g < 2""")
def cluster_one_hot_regression(spark, sf_dir):
    """The fitted cluster as 0/1 columns (sparse, the last one left out) of a regression."""
    from pyspark.ml.feature import OneHotEncoder
    rows = _apart(spark, sf_dir)
    model = models.kmeans(3, "features", "raw_cluster").fit(rows)
    centres = [float(c[0]) for c in model.clusterCenters()]
    rank = F.array(*[F.lit(float(sorted(centres).index(c))) for c in centres])
    rows = model.transform(rows).withColumn("cluster", F.get(rank, F.col("raw_cluster")))
    stages = [OneHotEncoder(inputCol="cluster", outputCol="flags", dropLast=True), features.assembler(["l_quantity", "flags"], "both", "error"),
              models.linear_regression("both", "l_extendedprice", solver="normal")]
    fit = features.pipeline(*stages).fit(rows).stages[-1]
    out = models.training_summary(spark, fit, ["l_quantity", "cluster_0", "cluster_1"])
    return out.where(F.col("metric").startswith("coef:") | (F.col("metric") == "intercept")).select("metric", F.round("value", 3).alias("value"))
