"""Quantiles by rank bisection against numpy, with sketches far too coarse for the data."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import quantiles as Q

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(8)
    n = 4000
    hot = np.where(np.arange(n) % 3 == 0, 7.0, rng.integers(0, 60, n).astype(float))       # one value holds over a third
    return {"normal": rng.normal(size=n), "hot": hot, "steps": np.repeat([1.0, 2.0, 1e300, -1e300], n // 4), "same": np.full(n, 3.25),
            "gaps": np.where(np.arange(n) % 7 == 0, rng.normal(size=n) * 1e-9, np.nan), "wild": np.exp(rng.normal(size=n) * 40)}


@pytest.fixture(scope="module")
def frame(spark, columns):
    rows = [tuple(None if v != v else float(v) for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("none", F.lit(None).cast("double")).repartition(7).cache()


@pytest.mark.parametrize("accuracy", [30, 200, 3000, 100_000])
def test_exact_at_any_accuracy(frame, columns, accuracy):
    got = Q.rank_quantiles(frame, [F.col(c) for c in [*columns, "none"]], PROBS, accuracy)
    for c, row in zip(columns, got):
        v = columns[c][~np.isnan(columns[c])]
        assert np.allclose(row, np.quantile(v, PROBS), rtol=1e-12, atol=0), (c, accuracy)
    assert got[-1] == [None] * len(PROBS)


def test_windows_in_several_passes(frame, columns, monkeypatch):
    monkeypatch.setattr(Q, "AGGREGATES", 3)
    got = Q.rank_quantiles(frame, [F.col("normal"), F.col("hot")], [0.25, 0.5, 0.75], 100)
    assert np.allclose(got[0], np.quantile(columns["normal"], [0.25, 0.5, 0.75])) and np.allclose(got[1], np.quantile(columns["hot"], [0.25, 0.5, 0.75]))


def test_a_sketch_that_errs_is_found_out(frame, columns, monkeypatch):
    """Counts decide: windows beside the rank are thrown away and asked for again, wider."""
    real, lies = Q._pass, [3]

    def liar(df, exprs):
        out = real(df, exprs)
        if lies[0] and isinstance(out[0], list):
            lies[0] -= 1
            return [[-5.0, -4.0] for _ in out]
        return out

    monkeypatch.setattr(Q, "_pass", liar)
    assert np.allclose(Q.rank_quantiles(frame, [F.col("normal")], [0.5], 100)[0], [np.quantile(columns["normal"], 0.5)])


def test_few_rows(spark):
    d = spark.createDataFrame([(1.0, 5), (2.0, None)], "a double, b int")
    assert Q.rank_quantiles(d, [F.col("a"), F.col("b")], [0.25, 0.5]) == [[1.25, 1.5], [5.0, 5.0]]
    assert Q.rank_quantiles(d.where("false"), [F.col("a")], [0.5]) == [[None]]
    assert Q.rank_quantiles(d, [], [0.5]) == []


def test_sketches_sent_to_the_last_task_stay_small(spark, monkeypatch):
    """Ranks with one window share a sketch, and no sketch is as fine as the accuracy asked for."""
    asked, real = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: asked.append(a) or real(c, p, a))
    v = np.random.default_rng(3).normal(size=30_000)
    d = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5).cache()
    got = Q.rank_quantiles(d, [F.col("v")], [0.25, 0.5, 0.75], 100_000)
    assert np.allclose(got[0], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12, atol=0)
    assert max(asked) <= 10_000 and len(asked) <= 1 + 6       # one for the whole column, then one for each open window


def test_merge_of_many_tasks_sketches_is_bounded(spark, monkeypatch):
    """What the merging task reads is the tasks' number times a sketch, whose size has a small bound; more rounds make up for it."""
    asked, real = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: asked.append(a) or real(c, p, a))
    d = spark.range(3_000_000, numPartitions=12).select(((F.col("id") * 7919) % 3_000_000).cast("double").alias("v"), (F.col("id") % 5).alias("few"))
    got = Q.rank_quantiles(d, [F.col("v"), F.col("few")], [0.25, 0.5, 0.75], 100_000)
    assert got == [[749_999.75, 1_499_999.5, 2_249_999.25], [1.0, 2.0, 3.0]]
    assert max(asked) <= 2_000
