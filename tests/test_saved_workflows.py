"""Workflows as one saved model, scoring of arriving listings, one-hot clusters."""
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from hearth.operators import features, stages
from hearth.plans import cluster_price, ridge_price
from hearth.session import scratch_path
from hearth.sources.listings import listings
from hearth.streaming import drops, listing_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def raw(spark, sf_small):
    return listings(spark, sf_small)


@pytest.fixture(scope="module")
def fitted(raw):
    return cluster_price.fit(raw)


def rows_of(df):
    return sorted((r["address"], r["cluster"], round(r["prediction"], 4)) for r in df.select("address", "cluster", "prediction").collect())


def test_whole_workflow_b_is_one_saved_model(spark, raw, fitted):
    path = scratch_path(spark, "workflow-b")
    fitted.write().save(path)
    again = PipelineModel.load(path)
    assert [type(s) for s in again.stages] == [type(s) for s in fitted.stages]
    assert [s.uid for s in again.stages] == [s.uid for s in fitted.stages]
    want = rows_of(fitted.transform(raw))
    assert rows_of(again.transform(raw)) == want and len(want) == raw.count()
    fitted.write().overwrite().save(path)  # an existing folder only if asked
    with pytest.raises(Exception, match="exist"):
        fitted.write().save(path)


def test_saved_model_scores_in_another_session(spark, raw, fitted, sf_small, tmp_path):
    path, out = scratch_path(spark, "workflow-b-other"), str(tmp_path / "scores")
    fitted.write().save(path)
    code = textwrap.dedent(f"""
        from pyspark.ml import PipelineModel
        from hearth.session import local_session
        from hearth.sources.listings import listings
        spark = local_session(2)
        model = PipelineModel.load({path!r})
        model.transform(listings(spark, {sf_small!r})).select("address", "cluster", "prediction").write.parquet({out!r})
    """)
    env = {**os.environ, "PYTHONPATH": ROOT, "HEARTH_DRIVER_MEMORY": "2g"}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=600, env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    assert rows_of(spark.read.parquet(out)) == rows_of(fitted.transform(raw))


def test_workflow_a_predicts_raw_listings_as_its_steps_do(spark, raw):
    complete = raw.na.fill("unknown").na.fill(1)
    result = ridge_price.run(complete)
    path = scratch_path(spark, "workflow-a")
    result.model.write().save(path)
    scores = PipelineModel.load(path).transform(complete).select("address", "price", "prediction")
    want = sorted((round(r.price, 6), round(r.prediction, 4)) for r in result.predictions.collect())
    have = {(round(r.price, 6), round(r.prediction, 4)) for r in scores.where("price IS NOT NULL AND NOT isnan(prediction)").collect()}
    assert want and set(want) <= have


def test_indexer_is_a_pipeline_stage(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("a", "y"), (None, "y")], "c string, d string")
    model = Pipeline(stages=[stages.FrequencyIndexer(inputCols=["c", "d"], outputCols=["i", "j"])]).fit(df)
    path = scratch_path(spark, "indexer")
    model.write().save(path)
    again = PipelineModel.load(path)
    batch = spark.createDataFrame([("a", "new"), ("b", "x"), (None, "y")], "c string, d string")
    got = [tuple(r) for r in again.transform(batch).select("c", "i", "j").collect()]
    assert sorted(got, key=str) == sorted([("a", 0.0, 2.0), ("b", 1.0, 1.0), (None, 2.0, 0.0)], key=str)
    assert again.stages[0].getHandleInvalid() == "keep" and again.stages[0].getInputCols() == ["c", "d"]
    unfitted = stages.FrequencyIndexer(inputCols=["c"], handleInvalid="skip")
    path = scratch_path(spark, "unfitted")
    unfitted.write().save(path)
    assert stages.FrequencyIndexer.load(path).fit(df).transform(batch).count() == 2
    with pytest.raises(ValueError, match="null"):
        stages.FrequencyIndexer(inputCols=["c"], handleInvalid="error").fit(df)
    with pytest.raises(ValueError, match="output"):
        stages.FrequencyIndexer(inputCols=["c", "d"], outputCols=["i"]).fit(df).transform(df)


def test_indexer_looks_large_tables_up_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(f"l{k % 7}", f"m{k}") for k in range(60)] + [(None, None)] * 3, "c string, d string")
    want = sorted(map(tuple, features.fit_index(df, ["c", "d"]).transform(df).collect()), key=str)
    monkeypatch.setattr(features, "BROADCAST_LABELS", -1)
    assert sorted(map(tuple, features.fit_index(df, ["c", "d"]).transform(df).collect()), key=str) == want


def test_small_label_tables_cost_no_shuffle(spark, raw):
    model = features.fit_index(raw, ["province", "balcony"])
    plan = model.transform(spark.read.schema(raw.schema).parquet(scratch_dir(spark, raw)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("LeftOuter, BuildRight") == 2


def scratch_dir(spark, df):
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    return path


def test_one_hot_cluster_has_a_level_of_its_own(raw):
    model = cluster_price.fit(raw, k=3)
    lr = model.stages[-1]
    n = len(cluster_price.feature_list())
    assert len(lr.coefficients) == n + 2  # one flag for each cluster but the last
    flags = model.transform(raw).select("cluster", "cluster_flags").distinct().collect()
    assert {(r.cluster, tuple(r.cluster_flags.toArray())) for r in flags} == {(0, (1.0, 0.0)), (1, (0.0, 1.0)), (2, (0.0, 0.0))}
    assert len(cluster_price.fit(raw, k=3, one_hot=False).stages[-1].coefficients) == n + 1


def test_scores_of_drops_equal_the_batch(spark, raw, fitted):
    """Any split into drops, with the query started anew for each."""
    path = scratch_path(spark, "model")
    fitted.write().save(path)
    model = PipelineModel.load(path)
    want = sorted((r.address, round(r.prediction, 4)) for r in fitted.transform(raw).collect())
    for n in (1, 3):
        source, out, ckpt = (scratch_path(spark, x) for x in ("in", "out", "ckpt"))
        for k in range(n):
            raw.where(features.hash_bucket("address", n) == k).write.mode("append").parquet(source)
            drops.append_available(drops.scored(listing_stream.listing_stream(spark, source), model, ["address"]), out, ckpt)
            drops.append_available(drops.scored(listing_stream.listing_stream(spark, source), model, ["address"]), out, ckpt)  # nothing new
        assert sorted((r.address, round(r.prediction, 4)) for r in spark.read.parquet(out).collect()) == want
