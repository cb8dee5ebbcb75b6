"""Trees grown on binned rows against Spark's own; scores of ensembles in lots; failures that must not look like results."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabwright.operators import grown as G
from tabwright.operators import models as MO
from tabwright.operators import select as SEL
from tabwright.operators import trees as T

COLS = dict(featuresCol="features", labelCol="label_idx")


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 5)), *(float(v) for v in np.eye(4)[rng.integers(0, 4)])) for i in range(700)]
    rows = [(*r, r[1] * (1 + r[3]) + (r[2] > 2) + 0.3 * float(rng.normal())) for r in rows]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double, label_idx double")
    d = VectorAssembler(inputCols=[*"abcdef"], outputCol="features").transform(d).select("id", "features", "label_idx")
    return d.withColumn("two", (F.col("label_idx") > 0.6).cast("double")).coalesce(2).persist()


def _two(frame):
    return frame.select("id", "features", F.col("two").alias("label_idx"))


def _all(model, frame, *cols):
    return np.array([[float(v) for c in r for v in (c.toArray() if hasattr(c, "toArray") else [c])] for r in model.transform(frame).orderBy("id").select(*cols).collect()])


def test_a_chain_without_draws_is_sparks(frame):
    kw = dict(maxIter=6, maxDepth=5, stepSize=0.3, minInstancesPerNode=2, seed=1)
    for spark_kind, own, d, cols in ((GBTRegressor, G.GrownBoostedRegressor, frame, ["prediction"]),
                                     (GBTClassifier, G.GrownBoostedClassifier, _two(frame), ["prediction", "probability", "rawPrediction"])):
        want, got = spark_kind(**COLS, **kw).fit(d), own(**COLS, **kw).fit(d)
        assert isinstance(got, G.GrownModel) and got.spark_model.getNumTrees == 6
        # a split of rounding's gain may be one side's only
        assert all(abs(a.numNodes - b.numNodes) <= 4 for a, b in zip(got.spark_model.trees, want.trees))
        assert np.allclose(_all(got, d, *cols), _all(want, d, *cols), atol=1e-9)
        assert np.allclose(_all(got.spark_model, d, *cols), _all(want, d, *cols), atol=1e-9)


def test_a_grown_forest_is_like_sparks_and_predicts_as_its_spark_model(frame, monkeypatch):
    for spark_kind, own, d, cols in ((RandomForestRegressor, G.GrownForestRegressor, frame, ["prediction"]),
                                     (RandomForestClassifier, G.GrownForestClassifier, _two(frame), ["prediction", "probability", "rawPrediction"])):
        kw = dict(numTrees=60, maxDepth=30, seed=3, featureSubsetStrategy="all")
        want, got = spark_kind(**COLS, **kw).fit(d), own(**COLS, **kw).fit(d)
        a, b = _all(want, d, *cols), _all(got, d, *cols)
        assert np.allclose(b, _all(got.spark_model, d, *cols), atol=1e-9)
        assert np.corrcoef(a[:, -1], b[:, -1])[0, 1] > 0.97
        assert abs(sum(t.numNodes for t in got.spark_model.trees) / sum(t.numNodes for t in want.trees) - 1) < 0.05
        assert np.allclose(got.featureImportances.toArray(), got.spark_model.featureImportances.toArray(), atol=1e-9)
        assert len({t.toDebugString.split("\n", 1)[1] for t in got.spark_model.trees}) == 60
        again = own(**COLS, **kw).fit(d.repartition(5))
        assert np.array_equal(_all(again, d, *cols), b)                # the layout does not matter
        monkeypatch.setattr(G, "HISTOGRAM", 100)                       # nodes in chunks: the same trees
        assert np.allclose(_all(own(**COLS, **kw).fit(d), d, *cols), b, atol=1e-9)
        monkeypatch.undo()


def test_too_many_cells_go_to_spark(frame, monkeypatch):
    monkeypatch.setattr(G, "CELL_BYTES", 1000)
    model = G.GrownForestRegressor(**COLS, numTrees=3, maxDepth=4, seed=3).fit(frame)
    assert type(model).__name__ == "RandomForestRegressionModel" and model.getNumTrees == 3


def test_many_values_keep_their_ranks(frame, monkeypatch):
    exact = G.find_bins(frame, 700, 6, 32, "features").at
    monkeypatch.setattr(G, "VALUES", 100)
    monkeypatch.setattr(G, "RANKS", 350)
    got = G.find_bins(frame, 700, 6, 32, "features").at
    assert len(got[0]) == 31 and all(np.array_equal(x, y) for x, y in zip(got[1:], exact[1:]))
    assert np.abs(got[0] - exact[0]).max() < 0.2


def test_large_learners_are_grown():
    assert isinstance(MO.make_estimator("Random Forest", MO.FOREST_ROWS), G.GrownForestClassifier)
    assert isinstance(MO.make_estimator("Random Forest Regressor", MO.FOREST_ROWS), G.GrownForestRegressor)
    assert isinstance(MO.make_estimator("Random Forest Regressor", MO.LOT_ROWS), G.GrownLotForest)
    assert isinstance(MO.make_estimator("Level-wise Boosting Regressor", MO.BOOSTED_ROWS), G.GrownBoostedRegressor)


def test_large_ensembles_are_scored_in_lots(frame, monkeypatch):
    """More nodes than a task may hold were an error, and the search's points rows without a score."""
    points = [(3, 2), (6, 2), (6, 30)]
    for task, kind, d in (("regression", G.GrownForestRegressor, frame), ("classification", G.GrownForestClassifier, _two(frame)),
                          ("regression", G.GrownBoostedRegressor, frame)):
        size = dict(maxIter=6) if kind is G.GrownBoostedRegressor else dict(numTrees=6)
        e = kind(**COLS, maxDepth=5, seed=3, **size).fit(d).ensemble
        want = T.score_points(e, d, points, task, "f1_weighted")
        x = np.array([r[0].toArray() for r in d.orderBy("id").select("features").collect()])
        y = np.array([r[0] for r in d.orderBy("id").select("label_idx").collect()])
        if task == "regression":
            plain = T.predict_points(e, x, points)
            assert np.allclose(want, [1 - ((y - plain[:, j]) ** 2).sum() / ((y - y.mean()) ** 2).sum() for j in range(3)])
        with monkeypatch.context() as m:
            m.setattr(T, "MODEL_BYTES", 1)
            assert len(list(e.lots())) == 6
            assert np.allclose(T.score_points(e, d, points, task, "f1_weighted"), want, atol=1e-12)


def test_no_rows_have_no_score(frame):
    e = G.GrownForestClassifier(**COLS, numTrees=3, maxDepth=5, seed=3).fit(_two(frame)).ensemble
    for task, scoring in (("classification", "f1_weighted"), ("classification", "accuracy"), ("regression", "r2")):
        with pytest.raises(ValueError, match="no rows"):
            T.score_points(e, _two(frame).where("id < 0"), [(3, 5)], task, scoring)
    with pytest.raises(ValueError, match="all equal"):
        T.score_points(e, _two(frame).where("label_idx = 1"), [(3, 5)], "regression", "r2")


def _trainset(spark):
    rows = [(i, float(i % 10), "uv"[i % 2], "yes" if (i % 10) + (i % 3) > 6 else "no") for i in range(120)]
    return SEL.prepare(spark.createDataFrame(rows, "id long, x double, c string, y string"), "id", "y", "classification", ["x"], ["c"])


def test_a_search_with_failed_points_is_no_table(spark, monkeypatch):
    from tabwright.plans import q_models as Q
    ts = _trainset(spark)
    monkeypatch.setattr(SEL, "search_space", lambda *a: ("grid_search", [{"C": 1.0}, {"C": 0.0}]))
    r = SEL.tune(ts, "Logistic Regression", "f1_weighted")
    assert [t[1] is None for t in r.trials] == [False, True]
    with pytest.raises(RuntimeError, match="1 of 2 points have no score"):
        Q._trials(spark, r)
    ts.release()


def test_a_score_that_is_no_number_is_a_failure(spark, monkeypatch):
    ts = _trainset(spark)
    monkeypatch.setattr(SEL, "cv_score", lambda *a: float("nan"))
    assert SEL.cross_validate(ts, [("Logistic Regression", None)], "accuracy")[0][0] is None
    ts.release()


def test_model_compare_has_the_boosters(spark, monkeypatch):
    """They were left out of the registered comparison."""
    from tabwright.plans import q_models as Q
    monkeypatch.setattr(MO, "BOOSTER_ROUNDS", 4)
    monkeypatch.setattr(MO, "FOREST_TREES", 4)
    ts = _trainset(spark)
    monkeypatch.setattr(Q, "doc_trainset", lambda *a: (None, ts))
    got = {r.model: r for r in Q.q_model_compare(spark, None).collect()}
    assert set(got) == {*MO.CLASSIFIERS, *MO.BOOSTERS}
    assert all(r.fit_status == "ok" and len(r.fold_scores) == ts.k for r in got.values())
