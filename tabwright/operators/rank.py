"""Ranking and decisions over score tables.

All inputs are small per-run tables (one row per candidate or per run), so
windows here are partitioned by run / dataset and hold a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(fold_scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """G9 over (group..., candidate_no, model, fold, score) ->
    (group..., candidate_no, model, fold_scores, mean_score, std_score, rank).
    Mean descending, ties keep candidate order; population std."""
    group = list(group or [])
    agg = fold_scores.groupBy(*group, "candidate_no", "model").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]).alias("fold_scores"),
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    # ties are decided at 1e-12 so that float summation order cannot reorder equal means
    w = Window.partitionBy(*group).orderBy(F.desc(F.round("mean_score", 12)), "candidate_no")
    return agg.withColumn("rank", F.row_number().over(w))


def champion(board: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The top of the ranked list per run (a knockout bracket over a sorted
    list with left-wins-ties always returns it)."""
    return board.where(F.col("rank") == 1).select(*(group or []), F.col("model").alias("champion"), "mean_score")


def ballots_from_board(board: DataFrame, group: list[str] | None = None, top: int = 3) -> DataFrame:
    """Top-3 candidates vote 3, 2, 1 with confidence clamp(score or score/100, .55, .99)."""
    s = F.col("mean_score")
    conf = F.greatest(F.lit(0.55), F.least(F.lit(0.99), F.when(s <= 1, s).otherwise(s / 100)))
    return board.where(F.col("rank") <= top).select(*(group or []), "rank", F.col("model").alias("candidate"),
                                                   (top + 1 - F.col("rank")).alias("vote"), conf.alias("confidence"))


def weighted_vote(ballots: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per candidate sum(vote) and sum(confidence*vote); winner = max weighted
    (ties -> first ballot); confidence = min(.99, max weighted / max(1, sum |votes|)), 3 decimals."""
    group = list(group or [])
    per = ballots.groupBy(*group, "candidate").agg(F.sum("vote").alias("votes"),
                                                  F.sum(F.col("confidence") * F.col("vote")).alias("weighted"),
                                                  F.min("rank").alias("first_seen"))
    tot = per.groupBy(*group).agg(
        F.max(F.struct("weighted", (-F.col("first_seen")).alias("o"), "candidate")).alias("best"),
        F.sum(F.abs("votes")).alias("abs_votes"))
    return tot.select(*group, F.col("best.candidate").alias("winner"),
                      F.round(F.least(F.lit(0.99), F.col("best.weighted") / F.greatest(F.lit(1), F.col("abs_votes"))), 3)
                      .alias("confidence"))


def best_run(runs: DataFrame) -> DataFrame:
    """Best run per dataset signature (metric desc, then earliest timestamp)."""
    w = Window.partitionBy("dataset_signature").orderBy(F.desc_nulls_last("primary_metric"), "timestamp", "run_id")
    return runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
