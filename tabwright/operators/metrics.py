"""Scoring and evaluation (H1-H10) on any (label, prediction[, score]) table.

All metrics are aggregates: the per-class counts are one ``groupBy(label,
prediction)`` (at most classes^2 rows), ROC-AUC is a rank sum over the
*distinct* scores, so a score value shared by a third of the rows is a single
row after the first (map-side combined) aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H2 -> one row (accuracy); null is a class of its own, here and below."""
    return df.agg(F.avg(F.col(label).eqNullSafe(F.col(prediction)).cast("double")).alias("accuracy"))


def class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for observed cells."""
    return df.groupBy(F.col(label).cast("string").alias("actual"), F.col(prediction).cast("string").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, tp, n_pred, n_actual, precision, recall, f1) over the union of labels."""
    cc = class_counts(df, label, prediction)
    # each cell counts for its actual and for its predicted class: one aggregate, nulls included
    side = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0)).alias("t")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("s")
    j = cc.select(side).groupBy(F.col("s.class").alias("class")).agg(
        F.sum("s.t").alias("tp"), F.sum("s.p").alias("n_pred"), F.sum("s.a").alias("n_actual"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("n_actual")), F.lit(0.0))
    j = j.select("*", p.alias("precision"), r.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return j.select("*", f1.alias("f1"))


def prf_weighted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H3: support-weighted precision / recall / F1 (0 on zero division) -> one row."""
    pc = per_class(df, label, prediction)
    tot = F.sum("n_actual")
    return pc.agg(*[(F.sum(F.col(m) * F.col("n_actual")) / tot).alias(m) for m in ("precision", "recall", "f1")])


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H6: (actual, predicted, n) zero-filled over the union of labels.

    The label set is a bounded array (classes), exploded twice into the k x k
    grid and left-joined to the observed cells.
    """
    cc = class_counts(df, label, prediction)
    # structs, since collect_set leaves out bare nulls
    labels = cc.select(F.explode(F.array(F.struct(F.col("actual").alias("c")), F.struct(F.col("predicted").alias("c")))).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("ls"))
    grid = labels.select(F.explode("ls").alias("a"), "ls").select(F.col("a.c").alias("_a"), F.explode("ls").alias("p")).select("_a", F.col("p.c").alias("_p"))
    return grid.join(cc, F.col("_a").eqNullSafe(F.col("actual")) & F.col("_p").eqNullSafe(F.col("predicted")), "left").select(
        F.col("_a").alias("actual"), F.col("_p").alias("predicted"), F.coalesce("n", F.lit(0)).alias("n"))


def auc(df: DataFrame, label: str, score: str, positive=1, group: list[str] | None = None,
        buckets: int = 1024) -> DataFrame:
    """H4: exact ROC-AUC (ties count 1/2) per group -> (group..., auc).

    AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P * N) over distinct
    scores s.  ``neg_below`` is a running sum over distinct scores, computed
    as bucket prefix + in-bucket running sum so no window holds all scores.
    """
    if not group:
        return auc(df.withColumn("_all", F.lit(0)), label, score, positive, ["_all"], buckets).drop("_all")
    group = list(group)
    is_pos = (F.col(label) == F.lit(positive)).cast("long")
    g = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, F.col(score).cast("double").alias("_s")) \
        .agg(F.sum(is_pos).alias("_p"), F.sum(1 - is_pos).alias("_n")).persist()   # read the source once
    rng = g.groupBy(*group).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    gb = g.join(rng, group, "inner")
    gb = gb.withColumn("_b", F.least(F.floor((F.col("_s") - F.col("_lo")) / width * buckets), F.lit(buckets - 1)))
    bt = gb.groupBy(*group, "_b").agg(F.sum("_n").alias("_bn"))
    wb = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*group, "_b", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_prefix"))
    gb = gb.join(bt, [*group, "_b"])
    ws = Window.partitionBy(*group, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    gb = gb.withColumn("_below", F.col("_prefix") + F.coalesce(F.sum("_n").over(ws), F.lit(0)))
    out = gb.groupBy(*group).agg(
        (F.sum(F.col("_p") * (F.col("_below") + 0.5 * F.col("_n"))) /
         (F.sum("_p").cast("double") * F.sum("_n"))).alias("auc"))
    return out


def auc_ovr_weighted(long_scores: DataFrame, label: str = "label", klass: str = "class", prob: str = "prob") -> DataFrame:
    """H5: one-vs-rest AUC per class, weighted by class prevalence -> one row.

    ``long_scores`` has one row per (row, class) with that class's probability.
    """
    per = auc(long_scores.withColumn("_is", (F.col(label) == F.col(klass)).cast("int")), "_is", prob, 1, group=[klass])
    support = long_scores.where(F.col(label) == F.col(klass)).groupBy(klass).agg(F.count(F.lit(1)).alias("_sup"))
    j = per.join(support, klass)
    return j.agg((F.sum(F.col("auc") * F.col("_sup")) / F.sum("_sup")).alias("auc_ovr"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H7-H9: rmse, mae, r2 (r2 = 1 - SSE / SST) -> one row."""
    e = F.col(label).cast("double") - F.col(prediction).cast("double")
    y = F.col(label).cast("double")
    a = df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
               F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    return a.select("rmse", "mae", (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def primary_metric(metrics_long: DataFrame) -> DataFrame:
    """H10 over (run, task_type, metric, value): F1, else accuracy; R2 for regression."""
    m = metrics_long.groupBy("run", "task_type").agg(
        *[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k) for k in ("f1_score", "accuracy", "r2_score")])
    return m.select("run", "task_type", F.when(F.col("task_type") == "classification",
                                               F.coalesce("f1_score", "accuracy", F.lit(0.0)))
                    .otherwise(F.coalesce("r2_score", F.lit(0.0))).alias("primary_metric"))
