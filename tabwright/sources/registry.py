"""Run registry (A3-A5): an append-only parquet table partitioned by dataset
signature.  Appends from concurrent sessions are safe (each writes its own
files); "compare" and "history" are ordinary queries over the table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder for written tables inside the shared ``spark.checkpoint.dir``."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def default_registry(spark: SparkSession, name: str = "runs") -> str:
    return work_dir(spark, name)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy("dataset_signature").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compare_runs(runs: DataFrame) -> DataFrame:
    """A4: every run with its rank inside its dataset (metric desc, earliest first)."""
    w = Window.partitionBy("dataset_signature").orderBy(F.desc_nulls_last("primary_metric"), "timestamp", "run_id")
    return runs.withColumn("rank_in_dataset", F.row_number().over(w))


def history(runs: DataFrame) -> DataFrame:
    """A5: per signature the run count, the latest winner and its parameters (reuse
    hints), the dataset's names, best metric and the set of winners seen."""
    latest = F.struct("timestamp", "run_id")
    more = [F.max_by("parameters", latest).alias("prior_parameters")] if "parameters" in runs.columns else []
    return runs.groupBy("dataset_signature").agg(
        F.count(F.lit(1)).alias("n_runs"), *more,
        F.array_sort(F.collect_set("dataset")).alias("datasets"),
        F.max_by("winner", latest).alias("prior_winner"),
        F.max("primary_metric").alias("best_metric"),
        F.array_sort(F.collect_set("winner")).alias("winners"),
        F.max_by("task_type", latest).alias("task_type"))
