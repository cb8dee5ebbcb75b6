"""Derived test inputs built by Spark from the given tables.

* ``dirty_events`` - the events table with injected nulls, infinities, a
  sparse column, a constant column, a collinear pair and duplicated rows
  (the driver tables hold none of these).
* ``scored_orders`` - a rule-scored (label, prediction, score) table on
  ``orders`` for exact metric oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table



def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    d = e.select(
        "event_id", "user_id",
        F.when(k % 23 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 101 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
        F.when(k % 40 == 0, F.col("value")).alias("sparse_col"),
        F.lit(1).cast("int").alias("const_col"),
        (F.col("value") * 2 + 1).alias("value_x2"),
        F.when(k % 29 == 0, F.lit(None)).otherwise((F.col("value") > 60).cast("int")).alias("target"),
    )
    return d.unionByName(d.where(k % 50 == 0))


SCORED_ORDERS_SQL = """
SELECT o_orderkey,
  CAST(o_orderstatus = 'F' AS INT) AS label,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS score,
  CAST((CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100) > 0.5 AS INT) AS prediction
FROM orders
"""


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary rule score: label = status 'F', score in [0, 1] with many ties."""
    o = read_table(spark, sf_dir, "orders")
    score = ((F.col("o_orderkey") * 37) % 101).cast("double") / 100
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                    score.alias("score"), (score > 0.5).cast("int").alias("prediction"))


MULTI_ORDERS_SQL = """
SELECT o_orderkey, o_orderstatus AS label,
  CASE (o_orderkey * 7 + o_custkey) % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P'
       ELSE o_orderstatus END AS prediction
FROM orders
"""


def multi_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class rule prediction of the order status (right about half the time)."""
    o = read_table(spark, sf_dir, "orders")
    r = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 4
    pred = (F.when(r == 0, "F").when(r == 1, "O").when(r == 2, "P").otherwise(F.col("o_orderstatus")))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("label"), pred.alias("prediction"))
