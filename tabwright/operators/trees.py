"""Fitted tree ensembles as node tables: prefix scores (G10, G11) and exact Shapley values.

A Spark tree model is stored and its node data read back as a table (a row per
node: test, children, prediction, class counts).  Two things are computed from it
for all rows of a frame, in tasks that hold the nodes of some trees:

* **Prefix scores.**  Trees are grown from the top, so a tree of depth 30 cut at
  depth 10 is the tree of depth 10, and the first rounds of a boosted chain are
  the shorter chain.  One fit answers every search point that differs from it in
  depth, rounds or number of trees only; all points are scored in one pass.
* **Interventional tree Shapley values.**  For a row x, a background row z and a
  leaf, the features tested on the leaf's path fall into those that only x passes
  (a of them), only z (b), or both; a leaf that either fails on some feature adds
  nothing.  With leaf value v a feature of the first kind gets
  v (a-1)! b! / (a+b)!, of the second -v a! (b-1)! / (a+b)!.  The sum over
  leaves, averaged over the background, is the exact Shapley value of the
  interventional game; no sampling.  Which features a row passes on a path is a
  bit mask, and rows and background rows are reduced to distinct masks a leaf.
  Mean importances explain each cell of the ensemble's thresholds once, with the
  number of its rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, drop_path

#: Bytes of node arrays that a task may hold; more trees take more passes over the rows.
MODEL_BYTES = 128 << 20
_SET_BYTES = 48
#: Cells (rows x leaves x path features) looked at together.
CELLS = 4 << 20


@dataclass
class Tree:
    feature: np.ndarray        # -1 at a leaf
    threshold: np.ndarray      # of a continuous test: left if value <= threshold
    left_set: list             # of a categorical test: the categories that go left, else None; empty without such tests
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray          # (nodes, outputs)
    prediction: np.ndarray


@dataclass
class Ensemble:
    """Trees with weights.  ``kind``: "mean" (regression forest or tree), "votes" (classification
    forest or tree: class shares, averaged) or "margin" (boosted: weighted sum)."""
    trees: list[Tree]
    weights: list[float]
    kind: str

    def lots(self) -> Iterator[list[int]]:
        """Numbers of trees that fit a task's memory together."""
        lot, held = [], 0
        for i, t in enumerate(self.trees):
            size = sum(a.nbytes for a in (t.feature, t.threshold, t.left, t.right, t.value, t.prediction)) + _SET_BYTES * len(t.left_set)
            if lot and held + size > MODEL_BYTES:
                yield lot
                lot, held = [], 0
            lot.append(i)
            held += size
        if lot:
            yield lot


def node_table(spark: SparkSession, model, path: str) -> DataFrame:
    """tree, node, feature, threshold, left_set, left, right, prediction, stats of a fitted tree
    model, which is stored under ``path`` for it."""
    model.write().overwrite().save(path)
    d = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in d.columns else F.struct(*d.columns)
    d = d.select((F.col("treeID") if "treeID" in d.columns else F.lit(0)).alias("tree"), node.alias("n"))
    continuous = F.col("n.split.numCategories") == -1
    test = F.col("n.split.leftCategoriesOrThreshold")
    return d.select("tree", F.col("n.id").alias("node"), F.when(F.col("n.leftChild") >= 0, F.col("n.split.featureIndex")).otherwise(-1).alias("feature"),
                    F.when(continuous, F.get(test, F.lit(0))).alias("threshold"), F.when(~continuous, test).alias("left_set"),
                    F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), F.col("n.prediction").alias("prediction"),
                    F.col("n.impurityStats").alias("stats"))


def is_trees(model) -> bool:
    """Whether a fitted model has node tables: a decision tree, random forest or boosted model."""
    return hasattr(type(model), "spark_model") or type(model).__name__.startswith(("DecisionTree", "RandomForest", "GBT"))


def load(spark: SparkSession, model) -> Ensemble:
    """Node arrays of a fitted decision tree, random forest or boosted model."""
    if hasattr(type(model), "spark_model"):            # grown here: it has them
        return model.ensemble
    name, path = type(model).__name__, f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    boosted = name.startswith("GBT")
    votes = "Classification" in name and not boosted
    rows = node_table(spark, model, path).orderBy("tree", "node").toPandas()
    drop_path(spark, path)
    trees = []
    for _, t in rows.groupby("tree", sort=True):
        stats = np.array(t["stats"].tolist(), float)
        value = stats / stats.sum(axis=1, keepdims=True) if votes else t["prediction"].to_numpy(float)[:, None]
        trees.append(Tree(t["feature"].to_numpy(np.int64), t["threshold"].to_numpy(float),
                          [None if s is None else frozenset(int(c) for c in s) for s in t["left_set"]],
                          t["left"].to_numpy(np.int64), t["right"].to_numpy(np.int64), value, t["prediction"].to_numpy(float)))
    weights = [float(w) for w in model.treeWeights] if hasattr(model, "treeWeights") else [1.0]
    return Ensemble(trees, weights, "margin" if boosted else "votes" if votes else "mean")


# ------------------------------------------------------------------ prefix scores
def cut(tree: Tree, depth: int) -> np.ndarray:
    """Which nodes are leaves of the tree grown to ``depth`` only.  As when it is grown, a node
    whose two children are leaves of one prediction becomes a leaf."""
    leaf, levels = tree.feature < 0, []
    at = np.zeros(1, np.int64)
    while len(at):
        if len(levels) == depth:
            leaf[at] = True
        levels.append(at := at[~leaf[at]])
        at = np.concatenate([tree.left[at], tree.right[at]])
    for at in levels[::-1]:                            # a level's children are done before it
        a, b = tree.left[at], tree.right[at]
        leaf[at[leaf[a] & leaf[b] & (tree.prediction[a] == tree.prediction[b])]] = True
    return leaf


def walk(tree: Tree, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The leaf that each row of ``x`` reaches."""
    at = np.zeros(len(x), np.int64)
    go = np.arange(len(x)) if not leaf[0] else np.empty(0, np.int64)
    while len(go):
        node = at[go]
        v = x[go, tree.feature[node]]
        left = v <= tree.threshold[node]
        for k in np.unique(node[np.isnan(tree.threshold[node])]):
            here = node == k
            left[here] = np.isin(v[here], list(tree.left_set[k]))
        at[go] = np.where(left, tree.left[node], tree.right[node])
        go = go[~leaf[at[go]]]
    return at


def predict_points(ensemble: Ensemble, x: np.ndarray, points: list[tuple[int, int]]) -> np.ndarray:
    """Predictions (rows, points); a point is (number of trees or rounds, depth)."""
    out = np.zeros((len(x), len(points)))
    for depth in sorted({d for _, d in points}):
        ends = sorted({t for t, d in points if d == depth})
        total, done = 0.0, 0
        for end in ends:
            for t, w in zip(ensemble.trees[done:end], ensemble.weights[done:end]):
                value = t.value[walk(t, x, cut(t, depth))]
                total = total + (value if ensemble.kind != "margin" else w * value)
            done = end
            got = total[:, 0] / end if ensemble.kind == "mean" else total.argmax(axis=1) if ensemble.kind == "votes" else total[:, 0]
            for j, p in enumerate(points):
                if p == (end, depth):
                    out[:, j] = got
    return out


def score_points(ensemble: Ensemble, frame: DataFrame, points: list[tuple[int, int]], task_type: str, scoring: str,
                 features: str = "features", label: str = "label_idx") -> list[float]:
    """One score per point over all rows of ``frame``, in one pass and one aggregate.

    An ensemble of more nodes than a task may hold is met in lots, a pass each, which add to the
    kept sums of every row.  Rows of a batch that no test tells apart are walked once.  Without
    rows, or if the labels of a regression are all equal, there is no score, which is an error.
    A margin's class is 1 above 0, as the boosted classifier decides."""
    spark = frame.sparkSession
    classes = task_type == "classification"
    at, k, outputs = cuts(ensemble), len(points), ensemble.trees[0].value.shape[1]
    lots = list(ensemble.lots())

    def run(batches: Iterator[pa.RecordBatch], sent, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            total = np.zeros((len(x), k, outputs)) if first else matrix(b.column(2)).reshape(len(x), k, outputs).copy()
            one, back = distinct_cells(x, at)
            add_lot(total, one, back, sent.value, points, kind)
            if not last:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(total.reshape(len(x), -1)), pa.list_(pa.float64()))], names=["x", "y", "t"])
                continue
            got = settle(total, points, kind)
            if classes and kind == "margin":
                got = (got > 0).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k), len(x))), pa.array(np.repeat(b.column(1).to_numpy(), k)), pa.array(got.ravel())],
                                             names=["point", "y", "p"])

    kind, kept = ensemble.kind, None
    rows = frame.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    for i, lot in enumerate(lots):
        sent = spark.sparkContext.broadcast([(t, ensemble.trees[t], ensemble.weights[t]) for t in lot])
        first, last = i == 0, i == len(lots) - 1
        step = lambda batches, sent=sent, first=first, last=last: run(batches, sent, first, last)
        rows = rows.mapInArrow(step, "point long, y double, p double" if last else "x array<double>, y double, t array<double>")
        if not last:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            rows.count()
            if kept is not None:
                kept.unpersist()
            kept = rows
    try:
        return _scores(rows, k, classes, scoring)
    finally:
        if kept is not None:
            kept.unpersist()


def add_lot(total: np.ndarray, x: np.ndarray, back: np.ndarray, lot: list, points: list[tuple[int, int]], kind: str) -> None:
    """Adds a lot's trees (number, tree, weight) to the sums (rows, points, outputs) of rows whose tests are those of ``x[back]``."""
    for depth in {d for _, d in points}:
        here = [(j, end) for j, (end, d) in enumerate(points) if d == depth]
        for t, tree, w in lot:
            if any(end > t for _, end in here):
                value = tree.value[walk(tree, x, cut(tree, depth))][back]
                value = w * value if kind == "margin" else value
                for j, end in here:
                    if end > t:
                        total[:, j] += value


def settle(total: np.ndarray, points: list[tuple[int, int]], kind: str) -> np.ndarray:
    """Predictions (rows, points) of the sums."""
    if kind == "votes":
        return total.argmax(axis=2).astype(float)
    return total[:, :, 0] / np.array([float(end) for end, _ in points]) if kind == "mean" else total[:, :, 0]


def _scores(rows: DataFrame, k: int, classes: bool, scoring: str) -> list[float]:
    if classes:
        counts = rows.groupBy("point", "y", "p").agg(F.count(F.lit(1)).alias("n")).collect()      # classes squared a point
        if not counts:
            raise ValueError("there are no rows to score")
        return [_class_score([r for r in counts if r.point == j], scoring) for j in range(k)]
    e = F.col("y") - F.col("p")
    sums = {r.point: r for r in rows.groupBy("point").agg(F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst")).collect()}
    if not sums or not sums[0].sst:
        raise ValueError("there are no rows to score, or their labels are all equal")
    return [1 - sums[j].sse / sums[j].sst for j in range(k)]


def _class_score(counts: list, scoring: str) -> float:
    total = sum(r.n for r in counts)
    if scoring != "f1_weighted":
        return sum(r.n for r in counts if r.y == r.p) / total
    score = 0.0
    for c in {r.y for r in counts}:
        actual = sum(r.n for r in counts if r.y == c)
        taken = sum(r.n for r in counts if r.p == c)
        right = sum(r.n for r in counts if r.y == c == r.p)
        score += actual / total * (2 * right / (actual + taken))
    return score


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists all have one length."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


# ------------------------------------------------------------------ Shapley values
class Paths:
    """A tree's leaves: per leaf the distinct features on its path, each with one merged test."""

    def __init__(self, tree: Tree, scale: float, arity: int = 0):
        found: list[tuple[dict, int]] = []
        stack: list[tuple[int, dict]] = [(0, {})]
        arity = 1 + max((max(s, default=0) for s in tree.left_set if s is not None), default=arity)
        while stack:
            i, held = stack.pop()
            f = int(tree.feature[i])
            if f < 0:
                found.append((held, i))
                continue
            t = tree.threshold[i]
            if math.isnan(t):                          # categories: (allowed, and whether all others are too)
                inside, others = held.get(f, (frozenset(range(arity)), True))
                chosen = tree.left_set[i]
                yes, no = (inside & chosen, False), (inside - chosen, others)
            else:                                      # low < value <= high
                low, high = held.get(f, (-math.inf, math.inf))
                yes, no = (low, min(high, t)), (max(low, t), high)
            stack += [(int(tree.left[i]), held | {f: yes}), (int(tree.right[i]), held | {f: no})]
        n, m = len(found), max((len(h) for h, _ in found), default=0)
        self.feature = np.full((n, m), -1)
        self.low, self.high = np.full((n, m), -np.inf), np.full((n, m), np.inf)
        self.table = np.full((n, m), -1)
        self.allowed: list[np.ndarray] = []
        self.arity = arity
        self.size = np.array([len(h) for h, _ in found])
        for r, (held, _) in enumerate(found):
            for j, (f, (a, b)) in enumerate(held.items()):
                self.feature[r, j] = f
                if isinstance(a, frozenset):
                    ok = np.zeros(arity + 1, bool)
                    ok[list(a)] = True
                    ok[arity] = b
                    self.table[r, j] = len(self.allowed)
                    self.allowed.append(ok)
                else:
                    self.low[r, j], self.high[r, j] = a, b
        self.value = scale * tree.value[[i for _, i in found]]

    def masks(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves) bits: bit j is set if the row passes the test of the leaf's j-th feature."""
        out = np.zeros((len(x), len(self.size)), np.int64)
        tables = np.array(self.allowed) if self.allowed else None
        for j in range(self.feature.shape[1]):
            v = x[:, self.feature[:, j]]
            ok = (v > self.low[:, j]) & (v <= self.high[:, j])
            sets = np.flatnonzero(self.table[:, j] >= 0)
            if len(sets):
                c = v[:, sets]
                c = np.where((c >= 0) & (c < self.arity), c, self.arity).astype(np.int64)
                ok[:, sets] = tables[self.table[sets, j], c]
            out |= (ok & (self.feature[:, j] >= 0)).astype(np.int64) << j
        return out


_FACT = np.array([float(math.factorial(i)) for i in range(64)])


def tree_shapley(paths: Paths, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley values (rows, features, outputs) of one tree against the background ``z``."""
    d, outputs = x.shape[1], paths.value.shape[1]
    phi = np.zeros((len(x) * d, outputs))
    leaves = len(paths.size)
    full = (np.int64(1) << paths.size.astype(np.int64)) - 1
    zb = paths.masks(z)
    at = np.arange(leaves, dtype=np.int64) << 32
    keys, many = np.unique((at + zb).ravel(), return_counts=True)      # distinct masks of a leaf, and how often
    zleaf, zmask = keys >> 32, keys & 0xFFFFFFFF
    first = np.searchsorted(zleaf, np.arange(leaves + 1))
    either = np.bitwise_or.reduce(zb, axis=0)
    step = max(1, CELLS // max(1, leaves * max(1, paths.feature.shape[1])))
    for lo in range(0, len(x), step):
        xb = paths.masks(x[lo:lo + step])
        row, leaf = np.nonzero((full & ~xb & ~either) == 0)            # what x fails, some z must pass
        ux, back = np.unique((leaf.astype(np.int64) << 32) + xb[row, leaf], return_inverse=True)
        uleaf, umask = ux >> 32, ux & 0xFFFFFFFF
        n = first[uleaf + 1] - first[uleaf]
        u = np.repeat(np.arange(len(ux)), n)
        p = np.repeat(first[uleaf] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keep = (umask[u] | zmask[p]) == full[uleaf[u]]
        u, p = u[keep], p[keep]
        only_x, only_z = umask[u] & ~zmask[p], zmask[p] & ~umask[u]
        a, b = np.bitwise_count(only_x).astype(int), np.bitwise_count(only_z).astype(int)
        share = many[p] / len(z) / _FACT[a + b]
        wx = np.where(a > 0, share * _FACT[np.maximum(a - 1, 0)] * _FACT[b], 0.0)
        wz = np.where(b > 0, share * _FACT[a] * _FACT[np.maximum(b - 1, 0)], 0.0)
        for j in range(paths.feature.shape[1]):
            part = np.bincount(u, wx * (only_x >> j & 1) - wz * (only_z >> j & 1), len(ux))
            on = part[back] != 0
            if on.any():
                cell = (lo + row[on]) * d + paths.feature[leaf[on], j]
                for c in range(outputs):
                    phi[:, c] += np.bincount(cell, part[back[on]] * paths.value[leaf[on], c], len(phi))
    return phi.reshape(len(x), d, outputs)


def shapley_values(model, rows: DataFrame, background: DataFrame, key: str, features: str = "features") -> DataFrame:
    """key, feature (its number), output, phi: exact Shapley values, those of 0 left out.

    ``model``: a fitted decision tree, random forest or boosted model, or an ``Ensemble``.
    ``background`` is bounded by the caller (the reference takes 50 rows); ``key`` tells rows apart.
    The outputs are a classifier's class shares, a regressor's value or a boosted model's margin.
    Every row meets every lot of trees once, so few rows still keep all cores busy."""
    e = model if isinstance(model, Ensemble) else load(rows.sparkSession, model)
    return _values(e, rows.select(F.col(key).alias("key"), vector_to_array(features).alias("x")), background, features)


def _values(e: Ensemble, x: DataFrame, background: DataFrame, features: str) -> DataFrame:
    """``shapley_values`` of the arrays ``x``, told apart by ``key`` (of any type that can be grouped)."""
    spark = x.sparkSession
    z = np.array([r[0] for r in background.select(vector_to_array(features)).collect()], float)
    scale = [w / (1.0 if e.kind == "margin" else len(e.trees)) for w in e.weights]
    cores = max(1, spark.sparkContext.defaultParallelism)
    parts = None
    for lot in e.lots():
        groups = [lot[i::cores] for i in range(min(cores, len(lot)))]
        sent = spark.sparkContext.broadcast([[(e.trees[i], scale[i]) for i in g] for g in groups])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made: dict[int, list[Paths]] = {}
            for b in batches:
                group, m = b.column(2).to_numpy(), matrix(b.column(1))
                for g in np.unique(group):
                    here = np.flatnonzero(group == g)
                    if g not in made:
                        made = {g: [Paths(t, s) for t, s in sent.value[g]]}
                    phi = sum(tree_shapley(p, m[here], z) for p in made[g])
                    r, f, c = np.nonzero(phi)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(here[r])), pa.array(f, pa.int32()), pa.array(c, pa.int32()), pa.array(phi[r, f, c])],
                                                     names=["key", "feature", "output", "phi"])

        dealt = x.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1)))).repartition("g", F.pmod(F.xxhash64("key"), F.lit(64)))
        schema = f"key {dict(x.dtypes)['key']}, feature int, output int, phi double"
        part = dealt.sortWithinPartitions("g").select("key", "x", "g").mapInArrow(run, schema)
        parts = part if parts is None else parts.union(part)
    return parts.groupBy("key", "feature", "output").agg(F.sum("phi").alias("phi"))


def cuts(ensemble: Ensemble) -> dict[int, np.ndarray | None]:
    """The sorted thresholds of each tested feature; None if it is tested by categories."""
    found: dict[int, list | None] = {}
    for t in ensemble.trees:
        for f in np.unique(t.feature[t.feature >= 0]):
            at = t.threshold[t.feature == f]
            if np.isnan(at).any():
                found[int(f)] = None
            elif found.setdefault(int(f), []) is not None:
                found[int(f)].append(np.unique(at))
    return {f: None if at is None else np.unique(np.concatenate(at)) for f, at in found.items()}


def cells(x: np.ndarray, at: dict[int, np.ndarray | None]) -> np.ndarray:
    """Rows that stand for all rows that every test of the ensemble treats as they: a number
    becomes the next threshold (infinity above all), one of no tested feature 0."""
    out = np.zeros(x.shape)
    for f, t in at.items():
        v = x[:, f]
        out[:, f] = v if t is None else np.where(np.isnan(v) | (v == -np.inf), v, np.append(t, np.inf)[np.searchsorted(t, v)])
    return out


def distinct_cells(x: np.ndarray, at: dict[int, np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row for every cell among the rows of ``x``, and which of them each row has."""
    if not at or not len(x):
        return x[:1], np.zeros(len(x), np.int64)
    _, one, back = np.unique(cells(x, at)[:, sorted(at)], axis=0, return_index=True, return_inverse=True)
    return x[one], back.ravel()


def shapley_importance(model, rows: DataFrame, background: DataFrame, key: str, names: list[str], features: str = "features") -> DataFrame:
    """(feature, importance): mean |phi| over all rows, and over a classifier's classes.

    Rows of one cell (no test tells them apart) have the same values, so that each cell is
    explained once and weighs as many rows as it holds."""
    e = model if isinstance(model, Ensemble) else load(rows.sparkSession, model)
    n, outputs, at = rows.count(), e.trees[0].value.shape[1], cuts(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = cells(matrix(b.column(0)), at)
            yield pa.RecordBatch.from_arrays([pa.array(list(m), pa.list_(pa.float64()))], names=["x"])

    held = rows.select(vector_to_array(features).alias("x")).mapInArrow(run, "x array<double>").groupBy("x").agg(F.count(F.lit(1)).alias("rows"))
    phi = _values(e, held.select(F.struct("x", "rows").alias("key"), "x"), background, features)
    total = phi.groupBy("feature").agg(F.sum(F.abs("phi") * F.col("key.rows")).alias("s"))
    every = rows.sparkSession.createDataFrame(list(enumerate(names)), "i int, name string")
    return every.join(total, F.col("i") == F.col("feature"), "left").select(
        F.col("name").alias("feature"), (F.coalesce("s", F.lit(0.0)) / (n * outputs)).alias("importance"))
