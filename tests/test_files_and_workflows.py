"""CSV round trips, sessions, metrics with nulls, and both workflows end to end."""
import math
import os

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from hearth import session
from hearth.operators import models
from hearth.plans import cluster_price, ridge_price
from hearth.sources.files import read_csv, write_csv
from hearth.sources.listings import RAW_SCHEMA, listings


def test_csv_with_original_headers(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('Floor Area,price,Number of Rooms,Province\n85,"$ 52,000",3,"a ""quoted"" name"\nbad,,6+,""\n')
    rows = read_csv(spark, path).collect()
    assert [r.price for r in rows] == ["$ 52,000", None] and rows[0].province == 'a "quoted" name'
    assert rows[0].floor_area == 85 and rows[1].floor_area is None
    assert [r.rooms for r in rows] == ["3", "6+"] and rows[0].bathrooms is None
    assert [f.name for f in RAW_SCHEMA.fields] == read_csv(spark, path).columns
    inferred = read_csv(spark, path, infer_schema=True)
    assert inferred.columns == ["floor_area", "price", "rooms", "province"] and dict(inferred.dtypes)["floor_area"] == "string"


@pytest.mark.parametrize("multi_line", [False, True])
def test_csv_round_trip_of_awkward_texts(spark, tmp_path, multi_line):
    texts = ['a "b" c', "x,y", "back\\slash", '"', " edge ", "", None, "֏ 1"] + (["two\nlines", 'q"\n"'] if multi_line else [])
    df = spark.createDataFrame([(t, "p") for t in texts], "address string, province string")
    write_csv(df, str(tmp_path / "t"))
    got = read_csv(spark, str(tmp_path / "t"), multi_line=multi_line)
    assert sorted((r.address for r in got.collect()), key=repr) == sorted(texts, key=repr)


def test_shared_folder_must_be_set_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "yarn"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())


def test_stages_can_be_dropped(spark):
    df = session.stage(spark.range(5), "drop-me")
    path = df.inputFiles()[0].removeprefix("file:").lstrip("/")
    assert df.count() == 5 and os.path.exists("/" + path)
    session.drop_stages(spark)
    assert not os.path.exists("/" + path)


def test_metrics_skip_incomplete_rows(spark):
    rows = [(1.0, 2.0), (5.0, 4.0), (None, 3.0), (9.0, None)]
    df = spark.createDataFrame(rows, "price double, prediction double")
    got = models.regression_metrics(df, digits=None).first()
    whole = df.dropna()
    for name in ("mae", "mse", "rmse", "r2"):
        want = RegressionEvaluator(labelCol="price", metricName=name).evaluate(whole)
        assert got[name] == pytest.approx(want)
    assert got["n"] == 2


@pytest.fixture(scope="module")
def complete(spark, sf_small):
    """Listings without a null, as the notebook's strict indexers need them."""
    return listings(spark, sf_small).na.fill("unknown").na.fill(1)


@pytest.mark.parametrize("as_written", [False, True])
def test_cluster_workflow_end_to_end(spark, complete, as_written):
    rows = cluster_price.run(complete, as_written, k_values=(2, 3)).collect()
    value = {(r.step, r.split, r.k, r.metric): r.value for r in rows}
    assert {r.step for r in rows} == {"sweep", "clusters", "regression", "regression_summary"}
    assert value["sweep", "all", 2, "wssse"] > value["sweep", "all", 3, "wssse"] > 0
    assert math.isfinite(value["regression", "test", 5, "rmse"])
    if as_written:  # the label is among the features
        assert value["regression", "test", 5, "r2"] > 0.999


def test_cluster_indices_are_fitted_on_training_rows_only(spark, complete):
    data = cluster_price.prepare(complete)
    base = cluster_price.typed_rows(complete)
    labels = base.where(F.col("bucket") < cluster_price.TRAIN_PCT).select("address").distinct().count()
    test = data.where(F.col("bucket") >= cluster_price.TRAIN_PCT)
    assert test.count() and test.agg(F.max("address_index")).first()[0] <= labels


def test_cluster_fits_read_rows_without_a_join_behind_them(spark, complete, monkeypatch):
    """Each task of each fit sends the metrics of the whole plan behind its rows."""
    plans, fitted = [], models.KMeans

    class Spy(fitted):
        def _fit(self, dataset):
            plans.append(dataset._jdf.queryExecution().executedPlan().toString())
            return super()._fit(dataset)

    monkeypatch.setattr(models, "KMeans", Spy)
    cluster_price.run(complete, k_values=(2,))
    cluster_price.fit(complete, k=2)
    assert len(plans) == 3  # the sweep's, the final one, the saved workflow's
    assert all("InMemory" in p and "Join" not in p and "Exchange" not in p and "Aggregate" not in p for p in plans)


def test_cluster_fits_read_all_rows_in_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(cluster_price, "FIT_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 100 * (cores + 2), 1, 4 * cores).select(
        (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id")).cast("double").alias("y"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a split for each written file
    try:
        got = cluster_price.fit_rows(rows)
        assert got.rdd.getNumPartitions() == cores + 2  # by the rows, not by the partitions that made them
        assert cluster_price.fit_rows(rows.limit(50)).rdd.getNumPartitions() <= cores
        assert cluster_price.fit_rows(rows.where("x < 0")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("as_written", [False, True])
def test_ridge_workflow_end_to_end(spark, complete, as_written):
    result = ridge_price.run(complete, as_written)
    assert result.best_reg_param in models.REG_PARAM_GRID and len(result.cv_metrics) == len(models.REG_PARAM_GRID)
    assert result.metrics.count() >= 1


def test_assignment_breaks_ties_by_the_lowest_centre(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (9.0,)], "x double")
    got = models.assign_to_centres(df, ["x"], [[0.0], [2.0], [2.0]])
    assert [r.cluster for r in got.orderBy("x").collect()] == [0, 0, 1, 1]
