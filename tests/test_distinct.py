"""Distinct values by digests: equal to Spark's own count, and cheap per cell."""
import datetime as dt

from pyspark.sql import functions as F

from tabwright.operators import profile as P

SCHEMA = "i int, l long, d double, f float, b boolean, s string, day date, at timestamp, x decimal(30,2), raw binary, v array<double>"


def _odd(spark):
    day, at = dt.date(2020, 2, 29), dt.datetime(2020, 2, 29, 1, 2, 3, 4)
    rows = [(0, 0, 0.0, 0.0, False, "", day, at, None, b"", [1.0]), (0, -1, -0.0, -0.0, True, "a", day, at, None, b"\x00", [1.0, None]),
            (-1, 1 << 62, float("nan"), float("nan"), None, None, None, None, None, None, None), (None, None, float("nan"), 0.1, None, "a ", None, dt.datetime(1960, 1, 1), None, b"\x00", []),
            (7, 0, float("inf"), 0.1, True, "a" * 1000, dt.date(1900, 1, 1), None, None, None, [1.0])]
    return spark.createDataFrame(rows * 3, SCHEMA).union(spark.range(500).selectExpr(
        "int(id % 300)", "id * 1234567891011", "id / 3", "float(id / 7)", "id % 2 = 0", "string(id % 77)", "date_add(date'2000-01-01', int(id % 99))",
        "timestamp_micros(id % 401)", "decimal(id % 13)", "cast(string(id % 55) as binary)", "array(double(id % 44))"))


def test_distinct_counts_equal_sparks(spark):
    df = _odd(spark)
    want = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first().asDict()
    assert {r["column_name"]: r["n_distinct"] for r in P.distinct_stats({"t": df}).collect()} == want


def test_profile_digests_cells_without_text(spark):
    """Numbers are hashed as they are, and no minimum is taken that nobody reads."""
    df = _odd(spark)
    plan = P.stats_wide({"t": df.select("i", "l", "d", "f", "b", "day", "at")})._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "as string" not in plan and "min(" not in plan
    assert [r["n_null"] for r in P.null_stats({"t": df}, constant=False).collect()] == [r["n_null"] for r in P.null_stats({"t": df}).collect()]
