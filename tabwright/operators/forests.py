"""A large regression forest grown in lots.

Trees of a forest do not depend on each other, but Spark grows them together: their nodes wait
for one queue of passes, every pass sends dense statistics of each node of the group, and every
row is walked down all trees from the root in each of them.  A frame of a few MB is one task, so
nothing of this runs in parallel, and dealing the rows over more tasks sends the statistics of
every node as often.  Here lots of trees are forests of their own, with their own seeds, fitted
beside each other over the same kept frame; each row's node ids are kept between passes.  Their
stored node data make one ``RandomForestRegressionModel``: the trees are those of the lots, in order.

The number of lots depends on the trees only, and whether there are any on the rows only, so that
reruns agree on any cluster.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, drop_path

#: Trees of a lot; lots fitted at a time; rows from which a forest is grown in lots.
LOT_TREES = 25
LOTS_AT_ONCE = 12
LOT_ROWS = 5_000


class LotForest(Estimator):
    """A ``RandomForestRegressor`` whose trees are fitted ``LOT_TREES`` at a time."""

    def __init__(self, forest: RandomForestRegressor):
        super().__init__()
        self.forest = forest

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        spark, trees = dataset.sparkSession, self.forest.getNumTrees()
        base = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
        starts = range(0, trees, LOT_TREES)

        def grow(start: int) -> str:
            # a bootstrap is drawn by seed + partition: seeds lie further apart than partitions
            lot = self.forest.copy({self.forest.numTrees: min(LOT_TREES, trees - start), self.forest.cacheNodeIds: True,
                                    self.forest.seed: self.forest.getSeed() + 1_000_003 * (start // LOT_TREES)})
            lot.fit(dataset).write().save(f"{base}/{start}")
            return f"{base}/{start}"

        try:
            with ThreadPoolExecutor(LOTS_AT_ONCE) as pool:
                paths = list(pool.map(grow, starts))
            return join_forests(spark, paths, list(starts), trees, f"{base}/whole")
        finally:
            drop_path(spark, base)


def join_forests(spark: SparkSession, paths: list[str], starts: list[int], trees: int, path: str) -> RandomForestRegressionModel:
    """One forest of all trees of stored ones; the first tree of each gets the number in ``starts``."""
    for table in ("data", "treesMetadata"):
        parts = []
        for p, start in zip(paths, starts):
            d = spark.read.parquet(f"{p}/{table}")
            tree = d.columns[0]
            parts.append(d.withColumn(tree, (F.col(tree) + start).cast(d.schema[tree].dataType)))
        reduce(DataFrame.unionByName, parts).write.parquet(f"{path}/{table}")
    meta = json.loads(spark.read.text(f"{paths[0]}/metadata").first()[0])
    meta["numTrees"] = meta["paramMap"]["numTrees"] = trees
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)
