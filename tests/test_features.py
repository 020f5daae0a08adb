"""Feature stages: indices, expansion, scaling, repeatable splits."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import features as fe


def test_string_index_keep_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",), ("b",), (None,)], "c string")
    m = fe.string_indexer(["c"], "_i", "keep").fit(df)
    got = [r[0] for r in m.transform(df).select("c_i").collect()]
    assert got == [1.0, 0.0, 0.0, 2.0, 1.0, 3.0]


def test_frequency_index_equals_string_indexer(spark, sf_small):
    from hearth.sources.listings import listings
    df = listings(spark, sf_small).select("address", "province")
    for col in ("address", "province"):
        mine = fe.frequency_index(df, col, "mine", "keep", partitions=7)
        ref = fe.string_indexer([col], "_ref", "keep").fit(df).transform(df)
        a = sorted((r[0], r[1]) for r in mine.select(col, "mine").distinct().collect())
        b = sorted((r[0], r[1]) for r in ref.select(col, col + "_ref").distinct().collect())
        assert a == b


def test_frequency_index_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "c string")
    got = sorted((r[0] is None, r[1]) for r in fe.frequency_index(df, "c", "i").select("c", "i").collect())
    assert got == [(False, 0.0), (False, 0.0), (False, 1.0), (True, 2.0)]
    with pytest.raises(ValueError):
        fe.frequency_index(df, "c", "i", "error")


def test_poly_expansion_order(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "x double, y double, z double")
    v = fe.assembler(["x", "y", "z"], "f", "error").transform(df)
    p = fe.poly_expansion("f", "p", 2).transform(v)
    got = p.select(*fe.vector_columns("p", 9, "p", None)).first()
    assert list(got) == [2, 4, 3, 6, 9, 5, 10, 15, 25]


def test_scaler_divides_by_sample_std(spark):
    x = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(v, 7.0) for v in x], "a double, b double")
    v = fe.assembler(["a", "b"], "f", "error").transform(df)
    s = fe.scaler("f", "s").fit(v).transform(v)
    got = [r[0] for r in s.select(*fe.vector_columns("s", 2, "s", None)[:1]).collect()]
    assert got == pytest.approx([xi / np.std(x, ddof=1) for xi in x])
    zero = [r[0] for r in s.select(*fe.vector_columns("s", 2, "s", None)[1:]).collect()]
    assert zero == [0.0] * 4   # zero variance -> 0


def test_assembler_keep_gives_nan(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    v = fe.assembler(["a", "b"], "f", "keep").transform(df)
    got = v.select(*fe.vector_columns("f", 2, "f", None)).first()
    assert got[0] == 1.0 and np.isnan(got[1])


def test_hash_split_invariant_to_partitioning(spark, sf_small):
    from hearth.sources.listings import listings
    df = listings(spark, sf_small).select("address").distinct()
    a_train, _ = fe.hash_split(df.repartition(1), "address")
    b_train, _ = fe.hash_split(df.repartition(7), "address")
    assert sorted(r[0] for r in a_train.collect()) == sorted(r[0] for r in b_train.collect())
    n = df.count()
    assert 0.7 * n < a_train.count() < 0.9 * n
    folds = fe.hash_folds(df, "address", 5).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]


def test_index_columns_equals_string_indexer(spark, sf_small):
    from hearth.sources.listings import listings
    df = listings(spark, sf_small).select("address", "province")
    mixed = fe.index_columns(df, ["address", "province"], "_i", "keep")
    ref = fe.string_indexer(["address", "province"], "_r", "keep").fit(df).transform(df)
    a = sorted(tuple(r) for r in mixed.select("address", "address_i", "province", "province_i").collect())
    b = sorted(tuple(r) for r in ref.select("address", "address_r", "province", "province_r").collect())
    assert a == b


def test_index_is_fitted_once_and_applied_to_later_batches(spark, tmp_path):
    fitted = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), (None, 4), ("c", 5)], "c string, k int")
    later = spark.createDataFrame([(9, "a"), (8, None), (7, "new"), (6, "c")], "k int, c string")
    model = fe.fit_index(fitted, ["c"], "_i", "keep")
    model.save(str(tmp_path / "index"))
    for m in (model, fe.FrequencyIndex.load(spark, str(tmp_path / "index"))):
        out = m.transform(later)
        assert out.columns == ["k", "c", "c_i"]   # the input's order
        assert sorted((r.k, r.c_i) for r in out.collect()) == [(6, 2.0), (7, 3.0), (8, 3.0), (9, 0.0)]
    skip = fe.fit_index(fitted, ["c"], "_i", "skip").transform(later)
    assert sorted(r.k for r in skip.collect()) == [6, 9]
    strict = fe.fit_index(fitted.dropna(), ["c"], "_i", "error")
    assert strict.transform(later.where("c = 'a'")).first().c_i == 0.0
    for bad in ("c is null", "c = 'new'"):
        with pytest.raises(Exception, match="no index of c"):
            strict.transform(later.where(bad)).collect()


def test_null_rows_do_not_meet_in_one_partition(spark):
    fitted = spark.createDataFrame([("a",)], "c string")
    rows = spark.range(2000).selectExpr("id", "CAST(NULL AS STRING) AS c")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(k, v)
        out = fe.fit_index(fitted, ["c"]).transform(rows)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_random_split_is_disjoint_and_complete(spark):
    df = spark.range(1000)
    train, test = fe.random_split(df)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not a & b and len(a | b) == 1000 and 700 < len(a) < 900
