"""Large regression forests are grown in lots and are one Spark forest in the end."""
import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor

from tabwright.operators import forests as FO
from tabwright.operators.models import make_estimator
from tabwright.operators.trees import load


def _frame(spark):
    rows = [(Vectors.dense([float(i % 13), float(i % 5 == 0)]), float((i * 37) % 101)) for i in range(400)]
    return spark.createDataFrame(rows, ["features", "label_idx"]).coalesce(1).persist()


def test_only_large_regression_forests_take_lots(spark):
    name = "Random Forest Regressor"
    assert isinstance(make_estimator(name, FO.LOT_ROWS), FO.LotForest)
    assert make_estimator(name, FO.LOT_ROWS).forest.getNumTrees() == 300
    assert isinstance(make_estimator(name, FO.LOT_ROWS - 1), RandomForestRegressor)
    assert isinstance(make_estimator(name, FO.LOT_ROWS, params={"numTrees": FO.LOT_TREES}), RandomForestRegressor)
    assert not isinstance(make_estimator("Random Forest", FO.LOT_ROWS), FO.LotForest)


def test_lots_make_one_forest_of_all_trees(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(FO, "LOT_TREES", 2)
    d = _frame(spark)
    forest = RandomForestRegressor(featuresCol="features", labelCol="label_idx", numTrees=5, maxDepth=30, featureSubsetStrategy="all", seed=42)
    seen, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda est, data: seen.append((est.getNumTrees(), est.getCacheNodeIds(), est.getSeed())) or fit(est, data))
    model = FO.LotForest(forest).fit(d)
    assert [t for t, _, _ in sorted(seen, key=lambda s: s[2])] == [2, 2, 1] and all(kept for _, kept, _ in seen)
    assert type(model) is RandomForestRegressionModel and model.getNumTrees == 5 == len(model.trees) and model.getOrDefault("numTrees") == 5
    # its trees are those of the lots, fitted apart and without kept node ids, in order
    lots = [forest.copy({forest.numTrees: n, forest.seed: s}).fit(d) for n, _, s in sorted(seen, key=lambda s: s[2])]
    apart = [t.toDebugString.split("\n", 1)[1] for m in lots for t in m.trees]
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == apart and len(set(apart)) == 5
    x = [r.features for r in d.distinct().limit(40).collect()]
    got = np.array([model.predict(v) for v in x])
    assert np.allclose(got, [sum(t.predict(v) for m in lots for t in m.trees) / 5 for v in x])
    assert len(load(spark, model).trees) == 5
    model.save(f"{tmp_path}/m")
    assert np.allclose([RandomForestRegressionModel.load(f"{tmp_path}/m").predict(v) for v in x[:5]], got[:5])
    d.unpersist()
