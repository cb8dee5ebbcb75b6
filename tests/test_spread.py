"""Learners' frames are dealt by what a fit makes of a row, whatever the cluster."""
from collections import Counter

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabwright.operators import select as SEL


def _frame(spark, n):
    rows = [(Vectors.dense([float(i % 7), float(i % 3)]), float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, ["features", "label_idx"]).coalesce(1)


def test_spread_by_rows_and_by_bytes(spark, monkeypatch):
    d = _frame(spark, 5000)
    assert SEL.spread(d, 500, 2, {"SVM"}) is d                                   # small frames stay as they are
    assert SEL.spread(d, 5000, 2, {"Random Forest Regressor"}) is d
    assert SEL.spread(d, 5000, 2, {"SVM"}).rdd.getNumPartitions() == 2
    assert SEL.spread(d, 10**6, 2, {"SVM"}).rdd.getNumPartitions() == 62         # 64 MB of kernel maps each
    monkeypatch.setattr(SEL, "TASK_ROWS", 500)
    out = SEL.spread(d, 5000, 2, {"SVM"})
    per = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(per) == 10 and max(per) <= 600
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, d.collect()))


def test_fit_final_runs_in_several_tasks(spark, monkeypatch):
    rows = [(i, float(i % 11), "ab"[i % 2], "yn"[(i % 11) > 5]) for i in range(4500)]
    ts = SEL.prepare(spark.createDataFrame(rows, "id long, x double, c string, y string").coalesce(1), "id", "y", "classification", ["x"], ["c"])
    seen, make = [], SEL.make_estimator

    def watched(*a, **b):
        est = make(*a, **b)
        fit = est.fit
        est.fit = lambda d: seen.append(d.rdd.getNumPartitions()) or fit(d)
        return est

    monkeypatch.setattr(SEL, "make_estimator", watched)
    SEL.fit_final(ts, "Decision Tree", None)
    ts.release()
    assert seen == [2]
