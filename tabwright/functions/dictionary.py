"""Level dictionaries of any size (F7): levels are numbered and rows encoded without the driver seeing a level.

The distinct levels are dealt into ranges, each range is numbered by itself, and only
the ranges' sizes are collected to shift the numbers.  The ranged table is written to
the shared folder first, so that its ranges do not move between those steps.  Rows
get their level's number by a join that is broadcast only if the dictionary was
counted small; AQE splits a crowded level otherwise.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Levels up to which the dictionary is broadcast.
BROADCAST_LEVELS = 200_000
#: Levels numbered by one task.
LEVELS_PER_RANGE = 250_000


@dataclass
class Dictionary:
    table: DataFrame       # level string, idx long: levels in order, from 0
    size: int


def level_dictionary(df: DataFrame, column: str) -> Dictionary:
    """Levels of a column in text order; nulls are no level."""
    spark = df.sparkSession
    levels = df.select(F.col(column).cast("string").alias("level")).where("level IS NOT NULL").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/levels-{uuid.uuid4().hex}"
    levels.write.parquet(f"{path}/found")
    levels = spark.read.schema("level string, n long").parquet(f"{path}/found")
    size = levels.count()
    ranges = max(1, -(-size // LEVELS_PER_RANGE))
    levels.repartitionByRange(ranges, "level").select("level", F.spark_partition_id().alias("part")).write.parquet(f"{path}/ranges")
    ranged = spark.read.schema("level string, part int").parquet(f"{path}/ranges")
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}     # a row per range
    before, start = 0, []
    for p in range(max(counts, default=-1) + 1):
        start.append(before)
        before += counts.get(p, 0)
    shift = F.element_at(F.array(*[F.lit(x).cast("long") for x in start or [0]]), F.col("part") + 1)
    idx = F.row_number().over(Window.partitionBy("part").orderBy("level")) - 1 + shift
    return Dictionary(ranged.select("level", idx.cast("long").alias("idx")), size)


def encode(df: DataFrame, column: str, levels: Dictionary, output: str, vector: str | None = None) -> DataFrame:
    """``output``: the level's number, null for a null or unseen level.  ``vector``: its one-hot sparse
    vector of the dictionary's size, all zeros for a null or unseen level."""
    table = levels.table.select(F.col("level").alias("_level"), F.col("idx").alias(output))
    small = F.broadcast(table) if levels.size <= BROADCAST_LEVELS else table
    out = df.join(small, F.col(column).cast("string") == F.col("_level"), "left").drop("_level")
    if vector is None:
        return out
    if not levels.size:
        raise ValueError(f"{column} has no level to encode")
    # a number beyond the last level is "invalid", and the encoder's place for it is the one dropped
    hot = OneHotEncoder(inputCols=["_idx"], outputCols=[vector], handleInvalid="keep", dropLast=True)
    ends = df.sparkSession.createDataFrame([(0.0,), (float(levels.size - 1),)], "_idx double")
    return hot.fit(ends).transform(out.withColumn("_idx", F.coalesce(F.col(output).cast("double"), F.lit(float(levels.size))))).drop("_idx")
