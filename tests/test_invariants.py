"""Invariants of the distributed building blocks."""
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwright.functions.quantiles import mode_long, quantiles_long
from tabwright.functions.ranking import hash_rank
from tabwright.functions.hashing import hash_unit
from tabwright.operators import features as FE
from tabwright.operators import metrics as M
from tabwright.operators.clean import clean
from tabwright.operators.split import fold_assign, fold_stratified, split_random, split_stratified
from tabwright.plans.fixtures import dirty_events, scored_orders
from tabwright.sources.tables import read_table
from tests.conftest import SF0001, SF001


@pytest.mark.parametrize("accuracy", [50, 1000, 100_000])
def test_exact_quantiles_refine_path(spark, accuracy):
    """Groups larger than ``accuracy`` take the sketch+refine path; the answer
    must still equal linear-interpolated quantiles, including a hot value that
    holds a third of the group."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=3000).round(3)
    b = np.concatenate([np.full(1000, 7.0), rng.integers(0, 50, 2000).astype(float)])   # skewed ties
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 1.0), ("c", 5.0)] + [(None, float(x)) for x in a]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = {(r["g"], r["prob"]): r["value"] for r in quantiles_long(df, ["g"], "v", probs, accuracy=accuracy,
                                                                     small_groups_first=False).collect()}
    for g, arr in (("a", a), ("b", b), ("c", np.array([1.0, 5.0])), (None, a)):
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(arr, p)), abs=1e-9), (g, p)


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("x", "a"), ("x", None), ("x", None), ("x", None)],
                               "g string, v string")
    r = mode_long(df, ["g"], "v").collect()[0]
    assert (r["mode"], r["mode_count"]) == ("a", 2)


def test_hash_rank_equals_global_window(spark):
    o = read_table(spark, SF001, "orders").select("o_orderkey", "o_orderstatus")
    got = hash_rank(o, "o_orderkey", 42, group=["o_orderstatus"], buckets=64, rank_col="r")
    w = Window.partitionBy("o_orderstatus").orderBy(hash_unit("o_orderkey", 42), "o_orderkey")
    ref = o.withColumn("r2", F.row_number().over(w))
    j = got.join(ref, ["o_orderkey", "o_orderstatus"])
    assert j.where(F.col("r") != F.col("r2")).count() == 0
    assert j.count() == o.count()


def test_split_sizes_and_stability(spark):
    o = read_table(spark, SF001, "orders").select("o_orderkey", "o_orderstatus")
    s1 = split_stratified(o, "o_orderkey", "o_orderstatus")
    s2 = split_stratified(o.repartition(13, "o_orderstatus"), "o_orderkey", "o_orderstatus")
    assert s1.join(s2, ["o_orderkey", "o_orderstatus", "split"]).count() == o.count()
    per = {r["o_orderstatus"]: (r["n"], r["t"]) for r in s1.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t")).collect()}
    total = sum(n for n, _ in per.values())          # the reference rounds the total, not each class
    assert sum(t for _, t in per.values()) == math.ceil(0.2 * total)
    for n, t in per.values():
        assert abs(t - math.ceil(0.2 * total) * n / total) < 1
    r = split_random(o, "o_orderkey")
    assert r.where("split = 'test'").count() == math.ceil(0.2 * o.count())


def test_folds_partition_rows(spark):
    o = read_table(spark, SF001, "orders").select("o_orderkey", "o_orderstatus")
    f = fold_assign(o, "o_orderkey", 5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sum(sizes) == o.count() and sizes[-1] - sizes[0] <= 1
    fs = fold_stratified(o, "o_orderkey", "o_orderstatus", 5)
    assert fs.select("o_orderkey").distinct().count() == o.count()


def test_clean_output_has_no_nulls(spark):
    res = clean(dirty_events(spark, SF0001), "target")
    d = res.data
    nulls = d.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in d.columns]).collect()[0]
    assert all(v == 0 for v in nulls.asDict().values())


def test_auc_matches_spark_evaluator(spark):
    s = scored_orders(spark, SF001)
    ours = M.auc(s, "label", "score").collect()[0]["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0)
    assert ours == pytest.approx(ev.evaluate(s.withColumn("label", F.col("label").cast("double"))), abs=1e-9)


def test_onehot_unseen_level_is_zero(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (4.0, None)], "x double, c string")
    pre = FE.fit_preprocessor(train, ["x"], ["c"])
    assert pre.feature_names == ["numeric__x", "categorical__c_a", "categorical__c_b"]
    test = spark.createDataFrame([(1.0, "zzz"), (2.0, "a")], "x double, c string")
    vals = [r["v"] for r in pre.transform(test).select(vector_to_array("features").alias("v")).collect()]
    assert vals[0][1:] == [0.0, 0.0]
    assert vals[1][1:] == [1.0, 0.0]
    # population std scaling: mean 0, pop std 1 on the training rows
    tv = np.array([r["v"][0] for r in pre.transform(train).select(vector_to_array("features").alias("v")).collect()])
    assert tv.mean() == pytest.approx(0.0, abs=1e-12) and tv.std() == pytest.approx(1.0)


def test_median_imputer_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "x double")
    assert FE.fit_medians(df, ["x"])["x"] == 2.5


def test_csv_tokens(spark, tmp_path):
    from tabwright.sources.csv import read_csv
    p = tmp_path / "t.csv"
    p.write_text(" a ,b,c\n1,NA,x\n2,2.5,null\nN/A,3,True\n")
    df = read_csv(spark, str(p))
    assert df.columns == ["a", "b", "c"]
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert df.where(F.col("a").isNull()).count() == 1 and df.where(F.col("b").isNull()).count() == 1


def test_hash_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(30)], "k long, g string")
    r = hash_rank(df, "k", 42, group=["g"], buckets=16, rank_col="r")
    assert r.count() == 30
    got = sorted(x["r"] for x in r.where(F.col("g").isNull()).collect())
    assert got == list(range(1, 11))
