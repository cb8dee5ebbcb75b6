"""Kernel maps: error bounds, gamma, a set that no linear margin separates, stored models."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors

from tabwright.operators import kernels as K
from tabwright.operators import models as MO


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(0).normal(size=(60, 7))


@pytest.mark.parametrize("dims", [256, 4096])
def test_fourier_features_keep_their_bound(points, dims):
    gamma = 0.1
    z = K.map_rows(points, "rbf", gamma, dims, 42)
    err = np.abs(z @ z.T - K.kernel(points, points, "rbf", gamma))
    pairs = len(points) * (len(points) - 1) / 2
    assert err.max() <= math.sqrt(4 / dims * math.log(2 * pairs / 1e-6))      # all pairs at once, chance of failing 1e-6
    assert np.allclose((z * z).sum(axis=1), 1.0)


def test_tensor_sketch_is_unbiased_within_its_variance(points):
    gamma, dims = 0.2, 1024
    want = K.kernel(points, points, "poly", gamma)
    got = [(lambda z: z @ z.T)(K.map_rows(points, "poly", gamma, dims, seed)) for seed in range(30)]
    own = np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert (np.mean([(g - want) ** 2 for g in got], axis=0) / own ** 2).mean() <= (3 ** K.DEGREE - 1) / dims
    assert (np.abs(np.mean(got, axis=0) - want) / own).max() <= 6 * math.sqrt((3 ** K.DEGREE - 1) / dims / 30)


def test_gamma_from_the_training_vectors(spark, points):
    df = spark.createDataFrame([(Vectors.dense(x.tolist()),) for x in points], ["features"])
    width = lambda **kw: K.KernelMap(**kw).fit(df).getOrDefault("width")
    assert math.isclose(width(gamma="scale"), 1 / (7 * points.var()))
    assert math.isclose(width(gamma="auto"), 1 / 7) and width(gamma=0.25) == 0.25
    same = spark.createDataFrame([(Vectors.dense([2.0, 2.0]),)] * 3, ["features"])
    assert K.KernelMap(gamma="scale").fit(same).getOrDefault("width") == 1.0
    with pytest.raises(ValueError):
        K.KernelMap(kernel="sigmoid")


@pytest.fixture(scope="module")
def ring(spark):
    rng = np.random.default_rng(4)
    turn, far = rng.uniform(0, 2 * np.pi, 400), np.repeat([1.0, 3.0], 200) + rng.normal(0, 0.2, 400)
    rows = [(Vectors.dense([float(r * np.cos(t)), float(r * np.sin(t))]), float(r > 2), float(r * r)) for t, r in zip(turn, far)]
    return spark.createDataFrame(rows, ["features", "label_idx", "squared"]).coalesce(2).cache()


def accuracy(df):
    return df.where("prediction = label_idx").count() / df.count()


def test_a_ring_needs_the_kernel(spark, ring, tmp_path):
    linear = LinearSVC(labelCol="label_idx", maxIter=50).fit(ring).transform(ring)
    assert accuracy(linear) < 0.75
    model = MO.make_estimator("SVM", 400).fit(ring)
    out = model.transform(ring)
    assert accuracy(out) > 0.99
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(ring)
    assert [r.prediction for r in again.select("prediction").collect()] == [r.prediction for r in out.select("prediction").collect()]
    assert model.transform(ring.where("false")).count() == 0


def test_regression_and_more_classes(ring):
    fit = MO.make_estimator("SVR", 400, params={"C": 2.0, "kernel": "rbf", "gamma": "auto"}).fit(ring.withColumn("label_idx", ring.squared))
    r = fit.transform(ring).selectExpr("corr(prediction, squared) AS c").first()
    assert r.c > 0.97
    three = ring.withColumn("label_idx", (ring.label_idx + (ring.squared > 10).cast("int")))
    assert accuracy(MO.make_estimator("SVM", 400, 3).fit(three).transform(three)) > 0.85


def test_all_points_of_the_search_differ(spark):
    _, maps = MO.search_space("SVM")
    assert len({tuple(sorted(m.items())) for m in maps}) == 12 == len(MO.combinations("SVM"))
    stages = [MO.make_estimator("SVM", 10, params=m).getStages()[0] for m in maps]
    assert {(s.getOrDefault("kernel"), s.getOrDefault("gamma")) for s in stages} == {(k, g) for k in K.KERNELS for g in ("scale", "auto")}


def test_sketch_of_sparse_rows_holds_no_rounding(spark):
    """Dimensions without a product are exactly 0: a learner that scales features would blow rounding up."""
    rows = np.eye(4)[np.arange(40) % 4] + np.outer(np.arange(40) > 30, [0, 0, 0, 2.0])
    z = K.map_rows(rows, "poly", 0.5, 512, 42)
    assert (z == 0).mean() > 0.5 and np.abs(z[z != 0]).min() > 1e-9
    df = spark.createDataFrame([(Vectors.dense(r.tolist()), float(r[3] > 0)) for r in rows], ["features", "label_idx"]).coalesce(1)    # the soft margin of C = 1 gives the nine unit vectors up
    assert accuracy(MO.make_estimator("SVM", 40, params={"C": 100.0, "kernel": "poly", "gamma": "scale"}).fit(df).transform(df)) == 1.0
