"""Dictionaries of levels: order, unseen and null levels, many ranges, a crowded level."""
import pytest
from pyspark.sql import functions as F

from tabwright.functions import dictionary as D


@pytest.mark.parametrize("per_range,broadcast", [(250_000, 200_000), (3, 2)])
def test_levels_in_order_and_unseen_ones(spark, monkeypatch, per_range, broadcast):
    monkeypatch.setattr(D, "LEVELS_PER_RANGE", per_range)
    monkeypatch.setattr(D, "BROADCAST_LEVELS", broadcast)
    rows = [(i, v) for i, v in enumerate(["b", "a", None, "é", "Z", "b", "", "a b", "b", "10", "9", "b"])]
    df = spark.createDataFrame(rows, "id long, c string")
    levels = D.level_dictionary(df, "c")
    want = sorted({v for _, v in rows if v is not None}, key=lambda s: s.encode())
    assert {r.level: r.idx for r in levels.table.collect()} == {v: i for i, v in enumerate(want)} and levels.size == len(want)
    new = spark.createDataFrame([*rows, (100, "never seen"), (101, "B")], "id long, c string")
    got = {r.id: (r.i, r.v) for r in D.encode(new, "c", levels, "i", "v").collect()}
    assert len(got) == len(rows) + 2
    for k, v in [*rows, (100, None), (101, None)]:
        i, vec = got[k]
        assert vec.size == len(want) and i == (want.index(v) if v is not None else None)
        assert list(vec.indices) == ([i] if i is not None else []) and all(x == 1.0 for x in vec.values)


def test_three_hundred_thousand_levels_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(D, "LEVELS_PER_RANGE", 50_000)
    n = 300_000
    df = spark.range(n + n // 2).select(F.when(F.col("id") < n, F.concat(F.lit("level "), F.col("id"))).otherwise("level 7").alias("c"))   # one level holds a third
    collected = []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(out := real(self)) or out)
    levels = D.level_dictionary(df, "c")
    out = D.encode(df, "c", levels, "i", "v")
    top = out.agg(F.count("i").alias("n"), F.countDistinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi")).first()
    assert tuple(top) == (n + n // 2, n, 0, n - 1) and levels.size == n
    assert max(len(x) for x in collected) <= 100
    assert out.where("c = 'level 7'").select("i").distinct().count() == 1


def test_no_levels(spark):
    df = spark.createDataFrame([(1, None)], "id long, c string")
    levels = D.level_dictionary(df, "c")
    assert levels.size == 0 and D.encode(df, "c", levels, "i").first().i is None
