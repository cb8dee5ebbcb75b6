"""Splits, folds, samples and the scoring choice.

Everything is keyed by an explicit row key and the md5 hash of it, so the
assignment is reproducible, independent of partitioning, and equal to the
same SQL in another engine.  Exact sizes (``ceil(test_size * n)`` test rows,
balanced folds) come from ``hash_rank``; no step ranks a whole class or table
in one task.  Class sizes are one row per class, joined null-safely.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..functions.ranking import hash_rank
from ..options import DEFAULT, Options


def _test_flag(test_size: float):
    return F.col("_rank") <= F.ceil(F.lit(float(test_size)) * F.col("_gn"))


def split_random(df: DataFrame, key: str, options: Options = DEFAULT) -> DataFrame:
    """Adds ``split`` in {'train','test'}; exactly ceil(test_size*n) test rows."""
    r = hash_rank(df, key, options.seed, rank_col="_rank")
    return r.withColumn("split", F.when(_test_flag(options.test_size), "test").otherwise("train")) \
        .drop("_rank", "_gn", "_h")


def min_class_count(df: DataFrame, label: str) -> int:
    row = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count").alias("m")).collect()[0]
    return int(row["m"] or 0)


def split_stratified(df: DataFrame, key: str, label: str, options: Options = DEFAULT,
                     smallest_class: int | None = None) -> DataFrame:
    """ceil(test_size * n) test rows in all, allotted to the classes by largest
    remainder (ties to the first class); plain split if a class has < 2 rows."""
    m = min_class_count(df, label) if smallest_class is None else smallest_class
    if m < 2:
        return split_random(df, key, options)
    sizes = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    want = math.ceil(options.test_size * n)
    exact = F.lit(want) * F.col("_n") / F.lit(max(1, n))
    # one row per class from here on
    sizes = sizes.select("_c", F.floor(exact).alias("_base"), (exact - F.floor(exact)).alias("_rest"))
    by_rest = Window.orderBy(F.desc("_rest"), F.asc_nulls_last("_c"))
    spare = F.lit(want) - F.sum("_base").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sizes = sizes.select("_c", (F.col("_base") + (F.row_number().over(by_rest) <= spare).cast("long")).alias("_test"))
    r = hash_rank(df, key, options.seed, group=[label], rank_col="_rank")
    r = r.join(sizes, F.col(label).eqNullSafe(F.col("_c")))
    return r.withColumn("split", F.when(F.col("_rank") <= F.col("_test"), "test").otherwise("train")) \
        .drop("_rank", "_gn", "_h", "_c", "_test")


def fold_assign(df: DataFrame, key: str, k: int, options: Options = DEFAULT) -> DataFrame:
    """Balanced shuffled k-fold: fold = (hash rank - 1) mod k."""
    r = hash_rank(df, key, options.seed, rank_col="_rank")
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_gn", "_h")


def fold_stratified(df: DataFrame, key: str, label: str, k: int, options: Options = DEFAULT) -> DataFrame:
    """Stratified k-fold.  A class starts at the fold after the previous class's
    last row, so folds differ by at most one row within a class and overall."""
    sizes = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.asc_nulls_last("_c")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    r = hash_rank(df, key, options.seed, group=[label], rank_col="_rank")
    r = r.join(sizes, F.col(label).eqNullSafe(F.col("_c")))
    return r.withColumn("fold", ((F.col("_start") + F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_gn", "_h", "_c", "_start")


def choose_folds(task_type: str, n_rows: int, smallest_class: int | None, options: Options = DEFAULT, tuning: bool = False):
    """(k, stratified): reference rules for the number of folds.

    classification with every class >= 2 rows -> stratified, k = max(2, min(folds, smallest));
    regression comparison -> plain k = folds; otherwise plain k = min(folds, max(2, n // 4)).
    """
    if task_type == "regression" and not tuning:
        return options.cv_folds, False
    if task_type == "classification" and smallest_class is not None and smallest_class >= 2:
        return max(2, min(options.cv_folds, smallest_class)), True
    return min(options.cv_folds, max(2, n_rows // 4)), False


def sample_topn(df: DataFrame, key: str, n: int, options: Options = DEFAULT) -> DataFrame:
    """E5: the n rows with the lowest hash (deterministic bounded sample; TakeOrderedAndProject)."""
    return df.withColumn("_h", hash_unit(key, options.seed)).orderBy("_h", key).limit(n).drop("_h")


def scoring_choice(counts: DataFrame, task_type: DataFrame | None = None, options: Options = DEFAULT) -> DataFrame:
    """E6 over (table_name, value, n) class counts (nulls ignored):
    f1_weighted if the minority share < 0.35, else accuracy."""
    c = counts.where(F.col("value").isNotNull()).groupBy("table_name").agg(
        (F.min("n") / F.sum("n")).alias("minority_share"))
    return c.select("table_name", F.when(F.col("minority_share") < options.minority_f1_ratio, "f1_weighted")
                    .otherwise("accuracy").alias("scoring"), "minority_share")
