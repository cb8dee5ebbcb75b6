"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Documents with equal text form a group and stay together.  Every group is a
vector (bytes, tokens, rows).  Groups of at least 1/512 of a shard in some
dimension are items of their own (there can be at most 3 x 512 x shards of
them); all smaller groups are folded by a hash of their text into a fixed
number of bundles.  The items, largest first, go to the shard whose residual
capacity has the highest dot product with the item, of those with room for its
bytes (so bytes, the law, come out near equal around a group that upsets another
dimension).  Only this bounded list
of sums reaches the driver.  Only a group that no shard can hold (in one of the
three dimensions) is cut, and then evenly, into some parts for each shard: the fewest
that fit would fill their shards in that dimension alone, and bytes, tokens and rows
could not all be balanced around them.  Its rows are dealt out by their number in the file.

Null text has no bytes (size 1) and groups with nulls only.  Repeated rows, and
rows that repeat an id or have none, are separate rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, join_small, materialize

SHARDS = 8
GRAIN = 512           # an item of its own: at least this fraction of a shard
BUNDLES_PER_SHARD = 1024
PARTS_PER_SHARD = 4   # of a group that no shard can hold
ROWS_PER_CELL = 50_000


def place(items: np.ndarray, shards: int) -> list[int]:
    """Shard of each item (rows: bytes, tokens, rows), largest item first, to the
    highest dot product of item and residual capacity among the shards with room for
    its bytes (if none has, to the most room for bytes); ties to the lowest shard."""
    total = np.maximum(items.sum(axis=0), 1)
    v = items * shards / total                       # in units of one shard's capacity
    left = np.ones((shards, items.shape[1]))
    out = [0] * len(items)
    for i in np.lexsort((np.arange(len(items)), -v.max(axis=1))):
        room = left[:, 0] >= v[i, 0]
        s = int(np.argmax(np.where(room, left @ v[i], -np.inf))) if room.any() else int(np.argmax(left[:, 0]))
        left[s] -= v[i]
        out[i] = s
    return out


def _weighed(docs: DataFrame, text_col: str, *keep) -> DataFrame:
    """size, tokens, text_key and ``keep`` of every row, and its number ``rid`` (of no meaning but to deal rows out)."""
    t = F.col(text_col)
    return docs.select((F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
                       F.coalesce(F.md5(t.cast("binary")), F.lit("null")).alias("text_key"), F.monotonically_increasing_id().alias("rid"), *keep)


class Plan:
    """Where groups go: ``own`` (groups that are items by themselves, and their parts) and ``table`` (shard of each item)."""

    def __init__(self, light: DataFrame, shards: int):
        spark, self.shards = light.sparkSession, shards
        sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
        total = light.agg(*sums).first()
        self.rows = total.n or 0
        cap = [max(1.0, float(x or 0) / shards) for x in total]
        share = F.greatest(F.col("size") / cap[0], F.col("tokens") / cap[1], F.col("n") / cap[2])
        # at most 3 * GRAIN * shards rows: each takes 1/GRAIN of a shard in a dimension
        self.own = materialize(light.groupBy("text_key").agg(*sums).withColumn("share", share).where(F.col("share") >= 1 / GRAIN)
                               .select("text_key", F.when(F.col("share") > 1, F.lit(PARTS_PER_SHARD * shards)).otherwise(1).cast("long").alias("parts")), "shard-own", True)
        items = sorted((r.unit, r.size, r.tokens, r.n) for r in self._units(light).groupBy("unit").agg(*sums).collect())  # bounded, see above
        where = place(np.array([x[1:] for x in items], dtype=float).reshape(-1, 3), shards)
        self.table = spark.createDataFrame([(x[0], s) for x, s in zip(items, where)], "unit string, shard int")

    def _units(self, light: DataFrame) -> DataFrame:
        bundle = F.pmod(F.xxhash64("text_key"), F.lit(BUNDLES_PER_SHARD * self.shards))
        part = F.pmod(F.xxhash64("rid"), F.col("parts"))
        return light.join(F.broadcast(self.own), "text_key", "left").withColumn(
            "unit", F.when(F.col("parts").isNull(), bundle.cast("string")).otherwise(F.concat_ws(":", "text_key", part.cast("string"))))

    def placed(self, light: DataFrame) -> DataFrame:
        return self._units(light).join(F.broadcast(self.table), "unit")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row per document."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc")
    light = materialize(_weighed(docs, text_col, F.col(id_col).alias("doc_id"), crc), "shard-light")      # rid is fixed from here on
    plan = Plan(light, shards)
    placed = plan.placed(light).select("doc_id", "size", "crc", "shard", "rid")
    cells = 1 << max(0, math.ceil(math.log2(max(1, plan.rows / shards / ROWS_PER_CELL))))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = materialize(counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-start", True)
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "crc", "size", "rid")) - 1
    return join_small(placed.withColumn("slot", slot.cast("long")), start, ["shard", "cell"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("start")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> None:
    """Write every row once as ``path/shard=N/``; groups are placed as by ``assign``, and rows go
    to their shard as they are read, without a join on ids.  Columns shard and slot are left out."""
    light = materialize(_weighed(docs, text_col), "shard-light")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = Plan(light, shards).placed(_weighed(docs, text_col, F.struct(*own).alias("row")))
    placed.select("row.*", "shard").write.partitionBy("shard").parquet(path)
    discard(light)
