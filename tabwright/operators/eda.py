"""Exploratory statistics (D1-D7).  Each is one aggregate over all columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import DEFAULT, Options
from .stats import as_double, column_quantiles, column_stats
from ..functions import cross


def numeric_summary(df: DataFrame, columns: list[str], decimals: int = 4) -> DataFrame:
    """(column_name, mean, std, min, max), sample std, rounded like the reference."""
    st = column_stats(df.select(*columns), distinct=False)
    wide = st.where(F.col("metric").isin("mean", "std", "min", "max")).groupBy("column_name").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("mean", "std", "min", "max")])
    return wide.select("column_name", *[F.round(m, decimals).alias(m) for m in ("mean", "std", "min", "max")])


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct) of categorical columns (nulls ignored)."""
    from .profile import distinct_stats   # (column, 16 bytes) a value, instead of a row copy per column
    return distinct_stats({"": df.select(*columns)}).select("column_name", "n_distinct")


def target_distribution(df: DataFrame, target: str, decimals: int = 4) -> DataFrame:
    """D3: (value, n, share, is_majority) including the null class."""
    counts = df.groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("t"), F.max("n").alias("m")).collect()[0]   # two scalars
    return counts.select("value", "n", F.round(F.col("n") / F.lit(tot["t"] or 1), decimals).alias("share"),
                         (F.col("n") == F.lit(tot["m"])).alias("is_majority"))


def describe(df: DataFrame, column: str, exact: bool = True, decimals: int = 4) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max of one numeric column (long form)."""
    x = as_double(df, column)
    m = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
               F.min(x).alias("min"), F.max(x).alias("max"))
    q = column_quantiles(df, [column], [0.25, 0.5, 0.75], exact=exact)
    ql = q.select(F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"), "value")
    ml = m.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"))
                                      for s in ("count", "mean", "std", "min", "max")])).alias("e")).select("e.*")
    return ml.unionByName(ql).select("stat", F.round("value", decimals).alias("value"))


def corr_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r for every pair i < j, long form (col_a, col_b, r).

    All pairs of up to ``cross.WIDTH`` columns come from one scan and one aggregate of
    matrix products.  Pairs whose variance may be lost to rounding (a column that is
    constant, or nearly, where the other has values) are taken again, each centred on its
    own means.  NULL for a constant column and where a value is not finite."""
    spark, schema = df.sparkSession, "col_a string, col_b string, r double"
    block = columns if len(columns) <= cross.WIDTH else None
    half = [columns] if block is not None else [columns[s:s + cross.WIDTH // 2] for s in range(0, len(columns), cross.WIDTH // 2)]
    out, again = [], []
    for i, a in enumerate(half):
        for j, b in enumerate(half[i:], i):
            if len(columns) < 2:
                continue
            r, unsure = cross.pearson(cross.pair_sums(df, [as_double(df, c) for c in a], [as_double(df, c) for c in b]))
            for x, ca in enumerate(a):
                for y, cb in enumerate(b):
                    if i < j or x < y:
                        (again if unsure[x, y] else out).append((ca, cb, None if math.isnan(r[x, y]) else float(r[x, y])))
    for s in range(0, len(again), 200):
        out += _centred(df, [(a, b) for a, b, _ in again[s:s + 200]])
    place = {c: k for k, c in enumerate(columns)}
    return spark.createDataFrame(sorted(out, key=lambda t: (place[t[0]], place[t[1]])), schema)


def _centred(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, float | None]]:
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        xa, xb = F.when(both, as_double(df, a)), F.when(both, as_double(df, b))
        aggs.append(F.try_divide(F.covar_pop(xa, xb), F.stddev_pop(xa) * F.stddev_pop(xb)).alias(f"_r{i}"))
    got = df.agg(*aggs).first()
    return [(a, b, None if v is None or math.isnan(v) else float(v)) for (a, b), v in zip(pairs, got)]
