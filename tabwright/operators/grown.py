"""Tree ensembles grown in tasks that hold the binned rows.

Spark's learners run a job for every level of a tree and every boosting round.  Like theirs, a
test here compares a feature with one of at most ``maxBins - 1`` thresholds, so a learner sees
of a row no more than its bins and its label.  Rows are binned where they are and equal ones
counted (a *cell* is bins, label and count); a vector's entries that share the bin of zero
are left out.  Cells are small beside the rows they come from: each task gets all of them and
grows whole trees, a forest's trees in many tasks, a chain's rounds in one.

* A bootstrap takes each row Poisson(1) times, hence a cell of n rows Poisson(n) times; a
  subsample takes a cell's rows Binomial(n, rate) times: the draws of the rows, added up.
* A level is one histogram of (node, bin); the bin of zero gets what the others of its feature
  leave of the node's total.  Nodes are taken in chunks of ``HISTOGRAM`` counts.
* Gain, stopping, pruning, first round, step and residuals are those of Spark ML.
* Trees are dealt over a fixed number of tasks and draw from the seed and their number, over cells
  in an order of their contents, so neither layout nor cluster matters.

Frames whose cells exceed ``CELL_BYTES`` are left to Spark's own learner.  The result is a
table with a row per tree, from which an ``Ensemble`` or Spark's model is made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, drop_path
from .forests import LotForest
from .trees import Ensemble, Tree, add_lot, cuts, distinct_cells

#: Bytes of cells that a task may hold, of features' distinct values seen as they are, and
#: numbers of a histogram.
CELL_BYTES = 128 << 20
VALUES = 500_000
HISTOGRAM = 2 << 20
#: Features at most (a node's histogram holds all their bins); values that stand for more of one feature.
FEATURES = 20_000
RANKS = 2_000
#: Tasks that a forest's trees are dealt over; cells of trees that are grown side by side.
LOTS = 48
BESIDE = 200_000

TREES = ("tree int, weight double, feature array<int>, threshold array<double>, left array<int>, right array<int>, prediction array<double>, "
         "impurity array<double>, gain array<double>, count array<long>, stats array<double>")


@dataclass
class Bins:
    """Thresholds of all features, one after the other; bins are numbered through all features."""
    at: list[np.ndarray]

    def __post_init__(self):
        size = np.array([len(t) + 1 for t in self.at])
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.total = int(self.end[-1])
        self.feature = np.repeat(np.arange(len(size)), size)
        self.inner = np.ones(self.total, bool)                 # bins with a threshold above them
        self.inner[self.end - 1] = False
        self.threshold = np.full(self.total, np.nan)
        self.threshold[self.inner] = np.concatenate(self.at)
        f = np.flatnonzero(size > 1)
        self._key = np.repeat(f, size[f] - 1) + 1j * np.concatenate(self.at)
        self.zero = self.of(np.arange(len(size)), np.zeros(len(size)))

    def of(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._key, feature + 1j * value, side="left") + feature


def entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the stored numbers of unwrapped vectors (sparse or dense)."""
    kind, stored, named = (vectors.field(f) for f in ("type", "values", "indices"))
    dense = kind.to_numpy(zero_copy_only=False) == 1
    size = np.diff(stored.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    feature[~dense[row]] = named.flatten().to_numpy(zero_copy_only=False)
    return row, feature, stored.flatten().to_numpy(zero_copy_only=False)


def split_points(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Spark's thresholds of a feature: midpoints of neighbouring values, at most ``most`` at equal strides of the rows."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= most:
        return middle
    stride = counts.sum() / (most + 1)
    seen, target, out = np.cumsum(counts), stride, []
    for i in range(1, len(values)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out[:most])


def find_bins(frame: DataFrame, n: int, size: int, most: int, features: str) -> Bins:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, f, v = entries(b.column(0))
            f, v = f[v != 0], v[v != 0]
            keys, many = np.unique(f + 1j * v, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.real.astype(np.int32)), pa.array(keys.imag.copy()), pa.array(many)], names=["f", "v", "n"])

    seen = frame.select(F.unwrap_udt(features).alias("x")).mapInArrow(run, "f int, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    if seen.count() > VALUES:                          # equal ranks of the rows stand for a feature's many values
        sizes = {r.f: r for r in seen.groupBy("f").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("rows")).collect()}
        many = [f for f, r in sizes.items() if r.d > RANKS]

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, f, v = entries(b.column(0))
                on = (v != 0) & np.isin(f, many)
                yield pa.RecordBatch.from_arrays([pa.array(f[on].astype(np.int32)), pa.array(v[on])], names=["f", "v"])

        ranks = frame.select(F.unwrap_udt(features).alias("x")).mapInArrow(stored, "f int, v double").groupBy("f").agg(
            F.percentile_approx("v", [(i + 0.5) / RANKS for i in range(RANKS)], 20 * RANKS).alias("q")).select("f", F.explode("q").alias("v")).toPandas()
        ranks["n"] = ranks["f"].map(lambda f: sizes[f].rows / RANKS)
        few = seen.where(~F.col("f").isin(many)).toPandas()
        got = pd.concat([ranks.groupby(["f", "v"], as_index=False)["n"].sum(), few.astype({"n": float})])
    else:
        got = seen.toPandas()
    seen.unpersist()
    at = [np.empty(0)] * size
    for f, g in got.groupby("f"):
        v, c = g["v"].to_numpy(float), g["n"].to_numpy(float)
        if (zeros := n - c.sum()) > 0.5:
            v, c = np.append(v, 0.0), np.append(c, zeros)
        order = np.argsort(v)
        at[int(f)] = split_points(v[order], c[order], min(most, n) - 1)
    return Bins(at)


@dataclass
class Binned:
    """A frame's cells: ``cells`` has (bins, label, count) a row."""
    cells: DataFrame
    bins: Bins
    classes: int
    rows: int

    def release(self):
        self.cells.unpersist()


def bin_rows(frame: DataFrame, most: int = 32, features: str = "features", label: str = "label_idx") -> Binned | None:
    """The cells of a frame, or None if they are too many for a task."""
    first = frame.select(features).first()
    if first is None or not 0 < (size := first[0].size) <= FEATURES:
        return None
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("top")).first()
    bins = find_bins(frame, row.n, size, most, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, f, v = entries(b.column(0))
            code = bins.of(f, v)
            told = code != bins.zero[f]
            ends = np.append(0, np.cumsum(np.bincount(r[told], minlength=b.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[told], pa.int32())), b.column(1)], names=["x", "y"])

    cells = frame.select(F.unwrap_udt(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(run, "x array<int>, y double") \
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    held = cells.agg(F.count(F.lit(1)).alias("m"), F.max(F.size("x")).alias("w")).first()
    if held.m * (4 * max(1, held.w) + 16) > CELL_BYTES:
        cells.unpersist()
        return None
    meta = frame.schema[label].metadata.get("ml_attr", {})
    classes = len(meta["vals"]) if "vals" in meta else int(row.top) + 1
    return Binned(cells, bins, max(2, classes), row.n)


# ------------------------------------------------------------------ one tree
class Cells:
    """The cells in a task, in an order of their contents."""

    def __init__(self, batches: Iterator[pa.RecordBatch], bins: Bins):
        ends, codes, y, n = [], [], [], []
        for b in batches:
            for packed in zip(*(b.column(i).to_pylist() for i in range(4))):
                for held, part, kind in zip((ends, codes, y, n), packed, (np.int32, np.int32, float, float)):
                    held.append(np.frombuffer(part, kind))
        size, flat, self.y, self.n = (np.concatenate(v) for v in (ends, codes, y, n))
        self.bins = bins
        self.codes = np.full((len(size), int(size.max(initial=0))), bins.total, np.int32)       # one bin more for no entry
        row = np.repeat(np.arange(len(size)), size)
        self.codes[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
        mix = np.random.default_rng(0).integers(1 << 62, size=self.codes.shape[1] + 1, dtype=np.uint64) | np.uint64(1)
        mark = self.y.copy().view(np.uint64) * mix[-1]
        for j in range(self.codes.shape[1]):
            mark += (self.codes[:, j].astype(np.uint64) + np.uint64(1)) * mix[j]
            mark ^= mark >> np.uint64(29)
        order = np.lexsort((mark, self.y))
        self.codes, self.y, self.n = self.codes[order], self.y[order], self.n[order]


def merit(parts: list[np.ndarray], classes: int) -> np.ndarray:
    """What a set of rows adds to the gain: squares of the class counts, or of the sum, by the count."""
    if classes:
        count = sum(parts)
        return sum(p * p for p in parts) / np.maximum(count, 1e-300)
    return parts[1] * parts[1] / np.maximum(parts[0], 1e-300)


def grow_trees(cells: Cells, y: np.ndarray, w: np.ndarray, classes: int, depth: int, least: int, subset: int, rng, keep_all: bool = False):
    """(node arrays of each tree, each cell's leaf value if ``keep_all``) of trees grown side by side on labels ``y``
    and multiplicities ``w`` (trees, cells).  ``keep_all``: a single tree, which also tells of cells that it has not drawn."""
    b, d = cells.bins, len(cells.bins.start)
    width, total, trees = cells.codes.shape[1], cells.bins.total, len(w)
    if keep_all:
        slot, rows, codes, w = np.zeros(len(y), np.int64), np.arange(len(y)), cells.codes, w[0]
    else:
        slot, rows = np.nonzero(w)
        codes, w, y = cells.codes[rows], w[slot, rows], y[rows]
    shift = 0.0 if classes or not w.sum() else float(np.average(y, weights=w))
    cols = [w * (y == c) for c in range(classes)] if classes else [w, w * (y - shift)]
    square = None if classes else w * y * y
    nodes, made = trees, 0
    tree = np.arange(nodes)                                    # of each node of the level
    told = np.zeros(len(rows)) if keep_all else None
    levels = []
    for level in range(depth + 1):
        sums = [np.bincount(slot, c, nodes) for c in cols]
        count = sum(sums) if classes else sums[0]
        whole = merit(sums, classes)
        gain, best = np.zeros(nodes), np.zeros(nodes, np.int64)
        side = np.zeros(len(slot), np.int8)
        step = max(1, HISTOGRAM // total)
        if level < depth and nodes > step:                     # nodes in chunks: their rows lie together
            order = np.argsort(slot, kind="stable")
            slot, codes, rows = slot[order], codes[order], rows[order]
            cols = [c[order] for c in cols]
            square = None if square is None else square[order]
        for lo in range(0, nodes if level < depth else 0, step):
            hi = min(nodes, lo + step)
            here = slice(None) if nodes <= step else slice(*np.searchsorted(slot, [lo, hi]))
            k, place = hi - lo, (slot[here] - lo) * (total + 1)
            hist = []
            for c, s in zip(cols, sums):
                weigh = c[here]
                h = np.zeros(k * (total + 1))
                for j in range(width):
                    h += np.bincount(place + codes[here, j], weigh, len(h))
                h = h.reshape(k, total + 1)[:, :total]
                h[:, b.zero] += s[lo:hi, None] - np.add.reduceat(h, b.start, axis=1)
                run = np.cumsum(h, axis=1)
                before = np.zeros((k, d))
                before[:, 1:] = run[:, b.start[1:] - 1]
                hist.append(run - before[:, b.feature])
            left, right = hist, [s[lo:hi, None] - h for s, h in zip(sums, hist)]
            nl, nr = (sum(left), sum(right)) if classes else (left[0], right[0])
            got = merit(left, classes) + merit(right, classes)
            ok = (nl >= least - 0.5) & (nr >= least - 0.5) & b.inner
            if subset < d:
                drawn = np.zeros((k, d), bool)
                np.put_along_axis(drawn, np.argpartition(rng.random((k, d)), subset - 1, axis=1)[:, :subset], True, axis=1)
                ok &= drawn[:, b.feature]
            got = np.where(ok, got, -np.inf)
            pick = got.argmax(axis=1)
            best[lo:hi], gain[lo:hi] = pick, got[np.arange(k), pick] - whole[lo:hi]
            # 1 left, 2 right, 0: the row has no entry of the feature
            f = b.feature[pick]
            table = np.zeros((k, total + 1), np.int8)
            table[:, :total] = np.where(b.feature == f[:, None], np.where(np.arange(total) <= pick[:, None], 1, 2), 0)
            table, to = table.ravel(), np.zeros(len(place), np.int8)
            for j in range(width):
                np.maximum(to, table[place + codes[here, j]], out=to)
            side[here] = np.where(to > 0, to, np.where(b.zero[f] <= pick, 1, 2)[slot[here] - lo])
        split = gain > 1e-12 * np.maximum(whole, 1e-300)
        if classes:
            stats = np.stack(sums, axis=1)
            share = stats / np.maximum(count, 1e-300)[:, None]
            says, impurity = stats.argmax(axis=1).astype(float), 1 - (share * share).sum(axis=1)
        else:
            q = np.bincount(slot, square, nodes)
            plain = sums[1] + shift * sums[0]
            says = plain / np.maximum(count, 1e-300)
            stats, impurity = np.stack([count, plain, q], axis=1), np.maximum(q / np.maximum(count, 1e-300) - says * says, 0.0)
        kid = np.where(split, made + nodes + 2 * (np.cumsum(split) - 1), -1)
        levels.append([np.where(split, b.feature[best], -1), np.where(split, b.threshold[best], np.nan), kid, np.where(split, kid + 1, -1), says, impurity,
                       np.where(split, gain / np.maximum(count, 1e-300), -1.0), np.rint(count).astype(np.int64), stats, tree])
        ends = ~split[slot]
        if keep_all:
            told[rows[ends]] = says[slot[ends]]
        go = ~ends
        slot = 2 * (np.cumsum(split) - 1)[slot[go]] + (side[go] == 2)
        rows, codes, cols = rows[go], codes[go], [c[go] for c in cols]
        square = None if square is None else square[go]
        made, nodes, tree = made + nodes, 2 * int(split.sum()), np.repeat(tree[split], 2)
        if not nodes:
            break
    *a, tree = prune([np.concatenate(v) for v in zip(*levels)], [len(v[0]) for v in levels])
    order = np.argsort(tree, kind="stable")                    # a tree's nodes together, still by levels
    ends = np.cumsum(np.bincount(tree, minlength=trees))
    place = np.empty(len(tree), np.int64)
    place[order] = np.arange(len(tree)) - np.repeat(np.append(0, ends[:-1]), np.diff(ends, prepend=0))
    for v in (a[2], a[3]):
        v[v >= 0] = place[v[v >= 0]]
    return [[v[order[lo:hi]] for v in a] for lo, hi in zip(np.append(0, ends[:-1]), ends)], told


def prune(a: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """Nodes whose two children are leaves of one prediction become leaves, from below."""
    feature, threshold, left, right, says, _, gain = a[:7]
    ends = np.cumsum(sizes)
    keep = np.ones(len(feature), bool)
    for lo, hi in zip(ends[::-1] - sizes[::-1], ends[::-1]):
        i = np.flatnonzero(left[lo:hi] >= 0) + lo
        i = i[(left[left[i]] < 0) & (left[right[i]] < 0) & (says[left[i]] == says[right[i]])]
        keep[left[i]] = keep[right[i]] = False
        feature[i], threshold[i], left[i], right[i], gain[i] = -1, np.nan, -1, -1, -1.0
    new = np.cumsum(keep) - 1
    a = [v[keep] for v in a]
    for v in (a[2], a[3]):
        v[v >= 0] = new[v[v >= 0]]
    return a


def grow_forest(cells: Cells, trees: list[int], classes: int, depth: int, least: int, subset: int, rate: float, seed: int):
    beside = max(1, BESIDE // max(1, len(cells.y)))
    for lo in range(0, len(trees), beside):
        some = trees[lo:lo + beside]
        rng = np.random.default_rng([seed & 0xFFFFFFFF, some[0]])
        w = rng.poisson(rate * cells.n, (len(some), len(cells.n))).astype(float)
        for t, a in zip(some, grow_trees(cells, cells.y, w, classes, depth, least, subset, rng)[0]):
            yield t, 1.0, a


def grow_chain(cells: Cells, rounds: int, two: bool, depth: int, least: int, subset: int, rate: float, step: float, seed: int):
    """Boosting as Spark does it: the first tree learns the labels, the others the loss's negative gradient."""
    y = 2 * cells.y - 1 if two else cells.y
    told = np.zeros(len(y))
    for t in range(rounds):
        rng = np.random.default_rng([seed & 0xFFFFFFFF, t])
        aim = y if t == 0 else 4 * y / (1 + np.exp(np.minimum(2 * y * told, 700))) if two else 2 * (y - told)
        w = rng.binomial(cells.n.astype(np.int64), rate).astype(float) if rate < 1 else cells.n
        (tree,), says = grow_trees(cells, aim, w[None], 0, depth, least, subset, rng, keep_all=True)
        weight = 1.0 if t == 0 else step
        told += weight * says
        yield t, weight, tree


# ------------------------------------------------------------------ estimators
def _subset(strategy: str, d: int, forest: bool, classes: int) -> int:
    """Features drawn for a node, by Spark's names."""
    if strategy == "auto":
        strategy = "all" if not forest else "sqrt" if classes else "onethird"
    named = {"all": d, "sqrt": np.ceil(np.sqrt(d)), "log2": max(1, np.ceil(np.log2(d))), "onethird": np.ceil(d / 3)}
    if strategy in named:
        return int(named[strategy])
    return min(int(strategy), d) if strategy.isdigit() else int(np.ceil(float(strategy) * d))


def grow(est, held: Binned) -> DataFrame:
    """The trees of a forest or boosted learner on binned rows, a row each (``TREES``)."""
    bins, boosted = held.bins, isinstance(est, (GBTClassifier, GBTRegressor))
    classes = held.classes if isinstance(est, RandomForestClassifier) else 0
    two, d = isinstance(est, GBTClassifier), len(bins.start)
    if two and held.classes > 2:
        raise ValueError(f"a boosted classifier knows two classes, not {held.classes}")
    size = est.getMaxIter() if boosted else est.getNumTrees()
    depth, least, rate, seed = est.getMaxDepth(), est.getMinInstancesPerNode(), est.getSubsamplingRate(), est.getSeed()
    subset, step = _subset(est.getFeatureSubsetStrategy(), d, not boosted and size > 1, classes), est.getStepSize() if boosted else 1.0
    lots = 1 if boosted else min(size, LOTS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0)
            parts = (np.diff(x.offsets.to_numpy()).astype(np.int32), x.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
                     b.column(1).to_numpy().astype(float), b.column(2).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["size", "x", "y", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, kept = None, []
        for b in batches:
            if b.num_rows:
                lot = b.column(4)[0].as_py()
                kept.append(b)
        if lot is None:
            return
        cells = Cells(iter(kept), bins)
        kept.clear()
        made = grow_chain(cells, size, two, depth, least, subset, rate, step, seed) if boosted else \
            grow_forest(cells, list(range(lot, size, lots)), classes, depth, least, subset, rate, seed)
        for t, weight, a in made:
            listed = [pa.array([v.ravel()], pa.list_(k)) for v, k in zip(a, (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(),
                                                                             pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([weight]), *listed], names=[c.split()[0] for c in TREES.split(", ")])

    packed = held.cells.mapInArrow(pack, "size binary, x binary, y binary, n binary")
    dealt = packed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).repartitionById(lots, F.col("lot"))
    return dealt.mapInArrow(run, TREES)


#: What walking a tree takes of it (a node's right child follows its left one).
WALK = ("tree", "weight", "feature", "threshold", "left", "prediction")


def as_ensemble(est, rows: pa.Table) -> Ensemble:
    boosted = isinstance(est, (GBTClassifier, GBTRegressor))
    votes = isinstance(est, RandomForestClassifier)
    made, weights, rows = [], [], rows.sort_by("tree")
    for i in range(rows.num_rows):
        feature, threshold, left, says = (rows[c][i].values.to_numpy(zero_copy_only=False) for c in WALK[2:])
        n, value = len(feature), says[:, None]
        if votes:
            stats = rows["stats"][i].values.to_numpy(zero_copy_only=False).reshape(n, -1)
            value = stats / stats.sum(axis=1, keepdims=True)
        made.append(Tree(feature, threshold, [], left, np.where(left < 0, -1, left + 1).astype(np.int32), value, says))
        weights.append(rows["weight"][i].as_py())
    return Ensemble(made, weights, "margin" if boosted else "votes" if votes else "mean")


MODELS = {RandomForestClassifier: RandomForestClassificationModel, RandomForestRegressor: RandomForestRegressionModel,
          GBTClassifier: GBTClassificationModel, GBTRegressor: GBTRegressionModel}


def as_model(est, trees: DataFrame, size: int, classes: int):
    """Spark's model of the trees: stored as one and loaded.  A fit of a stump on made-up rows gives the layout."""
    spark = trees.sparkSession
    kind = next(k for k in MODELS if isinstance(est, k))
    base = f"{checkpoint_dir(spark).rstrip('/')}/grown-{uuid.uuid4().hex}"
    few = [(Vectors.sparse(size, {0: float(i)}), float(i)) for i in range(max(2, classes))]
    tiny = spark.createDataFrame(few, [est.getFeaturesCol(), est.getLabelCol()]).coalesce(1)
    count = est.maxIter if kind in (GBTClassifier, GBTRegressor) else est.numTrees
    try:
        kind._fit(est.copy({count: 1, est.maxDepth: 1}), tiny).write().save(f"{base}/stump")
        stump, of = spark.read.parquet(f"{base}/stump/data"), spark.read.parquet(f"{base}/stump/treesMetadata")
        at = stump.schema["nodeData"].dataType
        cols = ["feature", "threshold", "left", "right", "prediction", "impurity", "gain", "count"]
        width = F.size("stats") / F.size("feature")
        node = trees.select("tree", F.posexplode(F.arrays_zip(*cols)).alias("id", "v"), "stats", width.cast("int").alias("w"))
        leaf = F.col("v.left") < 0
        field = {"id": F.col("id"), "prediction": F.col("v.prediction"), "impurity": F.col("v.impurity"), "impurityStats": F.slice("stats", F.col("id") * F.col("w") + 1, F.col("w")),
                 "rawCount": F.col("v.count"), "gain": F.col("v.gain"), "leftChild": F.col("v.left"), "rightChild": F.col("v.right"),
                 "split": F.struct(F.col("v.feature").alias("featureIndex"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("v.threshold")).alias("leftCategoriesOrThreshold"),
                                   F.lit(-1).alias("numCategories"))}
        data = F.struct(*[field[f.name].cast(f.dataType).alias(f.name) for f in at.fields]).alias("nodeData")
        node.select(F.col("tree").cast(stump.schema[stump.columns[0]].dataType).alias(stump.columns[0]), data).write.parquet(f"{base}/whole/data")
        one, (no, about, weight) = of.first(), of.columns
        trees.select(F.col("tree").cast(of.schema[no].dataType).alias(no), F.lit(one[about]).alias(about), F.col("weight").cast(of.schema[weight].dataType).alias(weight)) \
            .write.parquet(f"{base}/whole/treesMetadata")
        meta = json.loads(spark.read.text(f"{base}/stump/metadata").first()[0])
        meta["numTrees"] = meta["paramMap"][count.name] = est.getOrDefault(count)
        meta["paramMap"]["maxDepth"] = est.getMaxDepth()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{base}/whole/metadata")
        return MODELS[kind].load(f"{base}/whole")
    finally:
        drop_path(spark, base)


def grows(est) -> bool:
    return isinstance(est, (Grown, GrownLotForest))


def whole(est) -> tuple[int, int]:
    """(trees or rounds, depth) of all that a learner grows."""
    est = getattr(est, "forest", est)
    return est.getMaxIter() if isinstance(est, (GBTClassifier, GBTRegressor)) else est.getNumTrees(), est.getMaxDepth()


def ensemble(est, held: Binned) -> Ensemble:
    """A learner's trees on binned rows, without a model."""
    est = getattr(est, "forest", est)
    return as_ensemble(est, grow(est, held).select(*WALK, *(["stats"] if isinstance(est, RandomForestClassifier) else [])).toArrow())


class GrownModel(Model):
    """The fitted ensemble: predicts by its node arrays; for all else it is Spark's model, made when asked for."""

    def __init__(self, est, rows: pa.Table, size: int, classes: int):
        super().__init__()
        self.est, self.rows, self.size, self.classes = est, rows, size, classes
        self.ensemble = as_ensemble(est, rows)

    @cached_property
    def spark_model(self):
        spark = SparkSession.active()
        return as_model(self.est, spark.createDataFrame(self.rows, TREES).repartition(LOTS), self.size, self.classes)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.spark_model, name)

    def _to_java(self):
        return self.spark_model._to_java()

    @cached_property
    def featureImportances(self) -> DenseVector:
        """Gain by rows of each feature's tests, as Spark sums them: a forest's trees weigh alike."""
        out = np.zeros(self.size)
        for i in range(self.rows.num_rows):
            f, gain, count = (self.rows[c][i].values.to_numpy(zero_copy_only=False) for c in ("feature", "gain", "count"))
            one = np.bincount(f[f >= 0], (gain * count)[f >= 0], self.size)
            out += one if self.ensemble.kind == "margin" or not one.sum() else one / one.sum()
        return DenseVector(out / out.sum() if out.sum() else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        e, est = self.ensemble, self.est
        if len(list(e.lots())) > 1:
            return self.spark_model.transform(df)
        sent, at = df.sparkSession.sparkContext.broadcast(e), cuts(e)
        whole_of, kind, outputs = [(len(e.trees), 30)], e.kind, e.trees[0].value.shape[1]

        @F.pandas_udf("array<double>")
        def told(v: pd.Series) -> pd.Series:
            if not len(v):
                return v
            one, back = distinct_cells(np.stack(v.to_list()).astype(float), at)
            total = np.zeros((len(v), 1, outputs))
            held = sent.value
            add_lot(total, one, back, [*zip(range(len(held.trees)), held.trees, held.weights)], whole_of, kind)
            return pd.Series(list(total[:, 0] / (whole_of[0][0] if kind == "mean" else 1)))

        raw = told(vector_to_array(est.getFeaturesCol()))
        if not isinstance(est, (RandomForestClassifier, GBTClassifier)):
            return df.withColumn(est.getPredictionCol(), raw[0])
        out, r = df.withColumn("_raw", raw), F.col("_raw")
        if kind == "margin":
            out = out.withColumn("_raw", F.array(-r[0], r[0])).withColumn("_p", F.array(1 - 1 / (1 + F.exp(-2 * r[1])), 1 / (1 + F.exp(-2 * r[1]))))
        else:
            out = out.withColumn("_p", F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b)))
        return out.withColumn(est.getRawPredictionCol(), array_to_vector(r)).withColumn(est.getProbabilityCol(), array_to_vector("_p")) \
            .withColumn(est.getPredictionCol(), (F.array_position(r, F.array_max(r)) - 1).cast("double")).drop("_raw", "_p")


class Grown:
    """Grows the trees of a Spark learner on binned rows; frames of too many cells go to the learner itself."""

    def _fit(self, dataset: DataFrame):
        return fit(self, dataset) or super()._fit(dataset)


def fit(est, dataset: DataFrame) -> GrownModel | None:
    """The model, or None if the cells are too many."""
    held = bin_rows(dataset, est.getMaxBins(), est.getFeaturesCol(), est.getLabelCol())
    if held is None:
        return None
    try:
        return GrownModel(est, grow(est, held).toArrow(), len(held.bins.start), held.classes)
    finally:
        held.release()


class GrownForestClassifier(Grown, RandomForestClassifier):
    pass


class GrownForestRegressor(Grown, RandomForestRegressor):
    pass


class GrownBoostedClassifier(Grown, GBTClassifier):
    pass


class GrownBoostedRegressor(Grown, GBTRegressor):
    pass


class GrownLotForest(LotForest):
    """A large regression forest: grown on binned rows, else in lots."""

    def _fit(self, dataset: DataFrame):
        return fit(self.forest, dataset) or super()._fit(dataset)
