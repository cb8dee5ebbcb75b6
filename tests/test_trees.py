"""Prefix scores against separate fits; tree Shapley values against enumeration of all coalitions."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabwright.operators import trees as T


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        a, b, c = rng.normal(), float(rng.integers(0, 5)), "pqrs"[rng.integers(0, 4)]
        y = a * (1 + (c == "p")) + (b > 2) + 0.3 * rng.normal()
        rows.append((i, float(a), b, c, float(y), float(y > 0.6) + float(y > 1.4)))
    d = spark.createDataFrame(rows, "id long, a double, b double, c string, y double, k double")
    d = StringIndexer(inputCol="c", outputCol="ci").fit(d).transform(d)
    one = OneHotEncoder(inputCols=["ci"], outputCols=["oh"], dropLast=False).fit(d).transform(d)
    v = VectorAssembler(inputCols=["a", "b", "ci", "oh"], outputCol="features").transform(one)
    return v.select("id", "features", "y", "k", (F.col("k") > 0).cast("double").alias("two")).cache()


LEARNERS = {
    "tree": lambda: DecisionTreeRegressor(labelCol="y", maxDepth=7),
    "forest": lambda: RandomForestRegressor(labelCol="y", numTrees=7, maxDepth=6, seed=3, featureSubsetStrategy="all"),
    "class tree": lambda: DecisionTreeClassifier(labelCol="k", maxDepth=6),
    "class forest": lambda: RandomForestClassifier(labelCol="k", numTrees=5, maxDepth=6, seed=3),
    "boosted": lambda: GBTRegressor(labelCol="y", maxIter=6, maxDepth=4, stepSize=0.3, seed=3),
    "class boosted": lambda: GBTClassifier(labelCol="two", maxIter=6, maxDepth=3, stepSize=0.3, seed=3),
}


def _x(frame):
    return np.array([r[0] for r in frame.orderBy("id").select(vector_to_array("features")).collect()])


def _outputs(e, x):
    """What the ensemble says of each row, by walking it."""
    scale = [w / (1 if e.kind == "margin" else len(e.trees)) for w in e.weights]
    return sum(s * t.value[T.walk(t, x, t.feature < 0)] for t, s in zip(e.trees, scale))


@pytest.mark.parametrize("name", LEARNERS)
def test_node_tables_predict_as_the_model(frame, name):
    model = LEARNERS[name]().fit(frame)
    e, x = T.load(frame.sparkSession, model), _x(frame)
    got = T.predict_points(e, x, [(len(e.trees), 30)])[:, 0]
    if e.kind == "margin" and "class" in name:
        got = (got > 0).astype(float)
    want = [r.prediction for r in model.transform(frame).orderBy("id").select("prediction").collect()]
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("name", LEARNERS)
def test_shapley_values_are_those_of_all_coalitions(spark, frame, name):
    model = LEARNERS[name]().fit(frame)
    e, x = T.load(frame.sparkSession, model), _x(frame)
    rows, z = frame.where("id < 4"), x[100:106]
    got = {(r.key, r.feature, r.output): r.phi for r in T.shapley_values(model, rows, frame.where("id BETWEEN 100 AND 105"), "id").collect()}
    d, outputs = x.shape[1], e.trees[0].value.shape[1]
    for i in range(4):
        worth = {}
        for size in range(d + 1):
            for s in itertools.combinations(range(d), size):
                mixed = z.copy()
                mixed[:, list(s)] = x[i, list(s)]
                worth[s] = _outputs(e, mixed).mean(axis=0)
        for j in range(d):
            phi = np.zeros(outputs)
            for s, v in worth.items():
                if j not in s:
                    w = math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d)
                    phi += w * (worth[tuple(sorted((*s, j)))] - v)
            for c in range(outputs):
                assert got.get((i, j, c), 0.0) == pytest.approx(phi[c], abs=1e-10), (i, j, c)


@pytest.mark.parametrize("name", LEARNERS)
def test_shapley_values_add_up(frame, name):
    model = LEARNERS[name]().fit(frame)
    e, x = T.load(frame.sparkSession, model), _x(frame)
    told, bg = _outputs(e, x), _outputs(e, x[200:230]).mean(axis=0)
    total = np.tile(bg, (len(x), 1))
    for r in T.shapley_values(e, frame, frame.where("id BETWEEN 200 AND 229"), "id").collect():
        total[r.key, r.output] += r.phi
    assert np.abs(total - told).max() < 1e-9


def test_lots_of_trees_give_the_same_sums(frame, monkeypatch):
    e = T.load(frame.sparkSession, LEARNERS["forest"]().fit(frame))
    rows, bg = frame.where("id < 20"), frame.where("id >= 220")
    one = {(r.key, r.feature): r.phi for r in T.shapley_values(e, rows, bg, "id").collect()}
    monkeypatch.setattr(T, "MODEL_BYTES", 1)
    monkeypatch.setattr(T, "CELLS", 50)
    assert len(list(e.lots())) == 7
    many = {(r.key, r.feature): r.phi for r in T.shapley_values(e, rows, bg, "id").collect()}
    assert {k for k, v in one.items() if abs(v) > 1e-12} == {k for k, v in many.items() if abs(v) > 1e-12}
    assert all(abs(one[k] - many.get(k, 0)) < 1e-10 for k in one)


@pytest.mark.parametrize("task,label,make", [
    ("regression", "y", lambda n, d: RandomForestRegressor(labelCol="label_idx", numTrees=n, maxDepth=d, seed=5, featureSubsetStrategy="all")),
    ("classification", "k", lambda n, d: RandomForestClassifier(labelCol="label_idx", numTrees=n, maxDepth=d, seed=5)),
    ("regression", "y", lambda n, d: DecisionTreeRegressor(labelCol="label_idx", maxDepth=d)),
    ("classification", "k", lambda n, d: DecisionTreeClassifier(labelCol="label_idx", maxDepth=d)),
])
def test_depth_prefixes_are_separate_fits(frame, task, label, make):
    d = frame.withColumn("label_idx", F.col(label))
    train, test = d.where("id % 4 != 0"), d.where("id % 4 = 0")
    trees = 8 if "Forest" in type(make(8, 3)).__name__ else 1
    points = [(trees, k) for k in (0, 1, 3, 5, 12, 30)]
    got = T.score_points(T.load(frame.sparkSession, make(8, 30).fit(train)), test, points, task, "f1_weighted")
    for (n, depth), score in zip(points, got):
        pred = make(n, depth).fit(train).transform(test)
        want = RegressionEvaluator(labelCol="label_idx", metricName="r2").evaluate(pred) if task == "regression" else \
            MulticlassClassificationEvaluator(labelCol="label_idx", metricName="weightedFMeasure").evaluate(pred)
        assert score == pytest.approx(want, abs=1e-9), depth


@pytest.mark.parametrize("task,label,make", [
    ("regression", "y", lambda n: GBTRegressor(labelCol="label_idx", maxIter=n, maxDepth=3, stepSize=0.2, seed=5, subsamplingRate=0.8)),
    ("classification", "two", lambda n: GBTClassifier(labelCol="label_idx", maxIter=n, maxDepth=3, stepSize=0.2, seed=5, subsamplingRate=0.8)),
])
def test_boosting_prefixes_are_separate_fits(frame, task, label, make):
    d = frame.withColumn("label_idx", F.col(label))
    train, test = d.where("id % 4 != 0"), d.where("id % 4 = 0")
    points = [(n, 3) for n in (1, 4, 9)]
    got = T.score_points(T.load(frame.sparkSession, make(9).fit(train)), test, points, task, "accuracy")
    for (n, _), score in zip(points, got):
        pred = make(n).fit(train).transform(test)
        want = RegressionEvaluator(labelCol="label_idx", metricName="r2").evaluate(pred) if task == "regression" else \
            MulticlassClassificationEvaluator(labelCol="label_idx", metricName="accuracy").evaluate(pred)
        assert score == pytest.approx(want, abs=1e-9), n


def test_search_by_chains_scores_like_separate_fits(spark):
    """Depth points of one number of trees: every score equals that of its own fit."""
    from tabwright.operators import models as MO
    from tabwright.operators import select as SEL
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), float(rng.normal()), "uvw"[i % 3]) for i in range(150)]
    rows = [(*r, "yes" if r[1] * r[2] + (r[3] == "u") > 0.3 else "no") for r in rows]
    ts = SEL.prepare(spark.createDataFrame(rows, "id long, a double, b double, c string, y string"), "id", "y", "classification", ["a", "b"], ["c"])
    jobs = [("Random Forest", {"numTrees": 6, "maxDepth": d, "minInstancesPerNode": m}) for d in (2, 30, 5) for m in (1, 3)]
    jobs += [("Decision Tree", {"maxDepth": d, "minInstancesPerNode": 2}) for d in (1, 4, 30)] + [("Logistic Regression", {"C": 1.0})]
    assert len(MO.chains(jobs, 2)) == 4
    got = SEL.cross_validate(ts, jobs, "f1_weighted", tuning=True)
    for j in (1, 2, 6):
        want = SEL.cross_validate(ts, [jobs[j]], "f1_weighted", tuning=True)[0]
        assert got[j][1] is None and np.allclose(got[j][0], want[0], atol=1e-9), jobs[j]
    ts.release()


def test_chains_keep_every_point():
    from tabwright.operators import models as MO
    for name in ("Random Forest", "Decision Tree", "Random Forest Regressor", "Level-wise Boosting", "SVM"):
        _, maps = MO.search_space(name)
        found = MO.chains([(name, m) for m in maps], 2)
        assert sorted(j for _, _, members in found for j, _ in members) == list(range(len(maps)))
    assert len(MO.chains([("Random Forest", m) for m in MO.search_space("Random Forest")[1]], 2)) <= 3
    rounds = [("Level-wise Boosting", {"maxIter": n, "maxDepth": 4}) for n in (150, 250, 350)]
    assert [(p["maxIter"], len(m)) for _, p, m in MO.chains(rounds, 2)] == [(350, 3)]
    assert len(MO.chains(rounds, 3)) == 3                 # one-vs-rest models have no single chain


def test_importance_explains_a_cell_once(frame, monkeypatch):
    """Rows that no test tells apart are explained together, odd numbers included, with equal results."""
    spark = frame.sparkSession
    e = T.load(spark, LEARNERS["forest"]().fit(frame))
    x, at = _x(frame), T.cuts(e)
    x[:6, 0] = [np.nan, np.inf, -np.inf, at[0][0], np.nextafter(at[0][0], np.inf), at[0][-1] + 1]
    for t in e.trees:
        p = T.Paths(t, 1.0)
        assert (p.masks(x) == p.masks(T.cells(x, at))).all()
    seen = []
    real = T._values
    monkeypatch.setattr(T, "_values", lambda e, x, *a: seen.append(x.count()) or real(e, x, *a))
    many = frame.unionByName(frame).unionByName(frame.withColumn("id", F.col("id") + 1000))
    bg = frame.where("id BETWEEN 100 AND 120")
    names = [str(i) for i in range(x.shape[1])]
    got = {r.feature: r.importance for r in T.shapley_importance(e, many, bg, "id", names).collect()}
    assert seen[0] <= frame.count()
    want = T.shapley_values(e, frame, bg, "id").groupBy("feature").agg((F.sum(F.abs("phi")) / frame.count()).alias("s")).collect()
    assert all(math.isclose(got[str(r.feature)], r.s, rel_tol=1e-9) for r in want) and len(want) > 2
