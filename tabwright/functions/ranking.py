"""Exact per-group rank by a hash order, computed without ranking a whole
group in one task.

``rank = row_number() over (partition by group order by h, key)`` is the
primitive behind exact-size random splits, stratified splits and balanced
folds.  A plain window would put a whole class (possibly a third of all
rows) into one task.  Instead the hash range is cut into ``buckets`` slices:

1. ``groupBy(group, bucket).count()`` - a partially aggregated count table,
   at most groups x buckets rows;
2. a running sum over that small table gives the rows before each bucket;
3. the rows are ranked only inside their (group, bucket) slice, so each
   window partition holds about n / buckets rows.

Because the bucket is a monotone function of the hash the result equals the
global window exactly.  The count table is joined without a broadcast hint:
AQE broadcasts it at runtime only when its measured size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import HASH_SPACE, hash_unit


def bucket_count(n_rows: int, rows_per_bucket: int = 250_000) -> int:
    """Power of two so that a bucket holds about ``rows_per_bucket`` rows (16 .. 2^20)."""
    want = max(1, -(-int(n_rows) // rows_per_bucket))
    return min(1 << 20, max(16, 1 << (want - 1).bit_length()))


def hash_rank(df: DataFrame, key: str, seed: int, group: list[str] | None = None,
              buckets: int | None = None, rank_col: str = "rank", hash_col: str = "_h",
              size_col: str = "_gn", n_rows: int | None = None) -> DataFrame:
    """Adds ``rank_col`` (1-based) and ``size_col`` (rows in the group).

    ``buckets`` defaults to ``bucket_count(n_rows)`` (one count when not given),
    so a bucket's window stays around 250k rows at any scale."""
    group = list(group or [])
    if buckets is None:
        buckets = bucket_count(n_rows if n_rows is not None else df.count())
    width = HASH_SPACE // buckets
    d = df.withColumn(hash_col, hash_unit(key, seed)).withColumn("_b", (F.col(hash_col) / F.lit(width)).cast("long"))
    counts = d.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wg = Window.partitionBy(*group)
    prefix = counts.select(*group, "_b", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_before"),
                           F.sum("_cnt").over(wg).alias(size_col))
    if group:
        # null-safe on the group columns: rows of a null group are ranked, never dropped
        p = prefix.select(*[F.col(g).alias(f"_p_{g}") for g in group], F.col("_b").alias("_p_b"), "_before", size_col)
        cond = [d[g].eqNullSafe(p[f"_p_{g}"]) for g in group] + [d["_b"] == p["_p_b"]]
        d = d.join(p, cond, "inner").drop(*[f"_p_{g}" for g in group], "_p_b")
    else:
        d = d.join(prefix, on=["_b"], how="inner")
    w2 = Window.partitionBy(*group, "_b").orderBy(hash_col, key)
    return d.withColumn(rank_col, F.col("_before") + F.row_number().over(w2)).drop("_b", "_before")
