"""Run registry semantics and streaming scoring."""
from pyspark.sql import functions as F

from tabwright.plans.q_io import q_predict_stream
from tabwright.plans.q_runs import rule_runs
from tabwright.sources import registry as REG
from tests.conftest import SF0001


def test_registry_append_compare_history(spark):
    runs = rule_runs(spark, SF0001)
    n = runs.count()
    path = REG.default_registry(spark, "test-runs")
    REG.append_runs(runs, path)
    REG.append_runs(runs.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY")), path)
    reg = REG.read_runs(spark, path)
    assert reg.count() == 2 * n
    ranked = REG.compare_runs(reg).where("rank_in_dataset = 1").collect()
    assert len(ranked) == reg.select("dataset_signature").distinct().count()
    hist = {r["dataset_signature"]: r for r in REG.history(reg).collect()}
    best = {}
    for r in reg.collect():   # a handful of rows: brute force on the driver
        k = r["dataset_signature"]
        if k not in best or (r["timestamp"], r["run_id"]) > best[k][0]:
            best[k] = ((r["timestamp"], r["run_id"]), r["winner"])
    for k, (_, w) in best.items():
        assert hist[k]["prior_winner"] == w
        assert hist[k]["n_runs"] == 2 * runs.where(F.col("dataset_signature") == k).count()


def test_stream_scores_every_row(spark):
    out = q_predict_stream(spark, SF0001)
    assert out.count() == out.select("doc_id").distinct().count() > 0
    assert set(out.columns) == {"doc_id", "quality", "prediction"}
