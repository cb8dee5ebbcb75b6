"""Coalitions made in place give the values of those made as rows."""
import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from tabwright.operators import explain as X


def test_coalitions_in_place_give_the_same_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, *(float(v) for v in rng.normal(size=4)), float(rng.integers(0, 2))) for i in range(90)]
    rows += rows[:7]                                                       # keys may repeat
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    d = VectorAssembler(inputCols=[*"abcd"], outputCol="features").transform(d)
    model = LogisticRegression(labelCol="y").fit(d)
    w, c = model.coefficients.toArray(), float(model.intercept)
    args = (d, d.where("id < 20"), "id", "features", 4, lambda x: model.transform(x).withColumn("_out", vector_to_array("probability")[1]), [*"abcd"])
    want = {r.feature: r.importance for r in X.shap_sampled(*args).collect()}
    monkeypatch.setattr(X, "COALITIONS", 900)                              # several steps a batch
    got = {r.feature: r.importance for r in X.shap_sampled(*args, predict_rows=lambda x: 1 / (1 + np.exp(-(x @ w + c)))).collect()}
    assert set(got) == set(want) and all(abs(got[f] - want[f]) < 1e-9 for f in want)
