"""Connected components by alternating large and small stars.

Edges are pairs of ids.  A large star links every larger neighbour of a node
to the node's least neighbour, a small star every smaller one; alternated,
they turn each component into a star around its least member in a logarithmic
number of rounds.  A round's least neighbours are a partial aggregate; they
are written to the shared folder before the join, so that both of its sides
are plain exchanges that AQE can split if a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")).where("u != v") if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least", True)
    near = both.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    done = materialize(out.where("u != v").distinct(), "cc-edges", True)
    discard(least)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; ``edges`` has two long columns u, v.
    The component is its least node.  No edges: no rows."""
    edges = materialize(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges", True)
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        big = _star(edges, True)
        small = _star(big, False)
        discard(edges)
        discard(big)
        edges = small
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())
