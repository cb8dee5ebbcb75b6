"""Scale paths: sketch statistics and scan pruning."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions.quantiles import quantiles_long
from tabwright.operators import profile as P
from tabwright.plans.q_models import doc_quality
from tests.conftest import SF001


def test_sketch_quantiles_close(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=5000)
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    got = {r["prob"]: r["value"] for r in quantiles_long(df, ["g"], "v", [0.25, 0.5, 0.75], exact=False,
                                                            accuracy=1000).collect()}
    for p, val in got.items():
        # rank error of the sketch is at most n / accuracy
        rank = (v < val).mean()
        assert abs(rank - p) <= 2.0 / 1000 + 1.0 / len(v)


def test_approx_distinct_close(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    e = {r["column_name"]: r["n_distinct"] for r in P.distinct_stats({"orders": o}).collect()}
    a = {r["column_name"]: r["value"] for r in P.lake_stats({"orders": o}, exact=False).where("metric = 'n_distinct'").collect()}
    for c in e:
        assert a[c] == pytest.approx(e[c], rel=0.1)


def test_join_prunes_text_column(spark):
    plan = doc_quality(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scans and all("text:" not in ln for ln in scans)
