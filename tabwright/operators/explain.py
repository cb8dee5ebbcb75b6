"""Explanation (I1-I8) as Spark jobs.

Every method is "make copies of rows, transform once, aggregate":

* linear Shapley values (I1, closed form): ``coef_j * (x_j - mean_bg_j)``,
  exploded per feature and averaged;
* sampled permutation Shapley (I1, Strumbelj & Kononenko 2014) for any
  model: rows x permutations x (d + 1) coalition vectors built with array
  functions, one ``transform``, a lag inside each (row, permutation);
* permutation importance (I3): the rows get one random order by a distributed
  hash rank; every (feature, repeat) turns that order by its own step and
  joins the one value it swaps, and all copies are scored in one pass;
* partial dependence (I6): each row is exploded over a bounded grid
  (literal array, 100 points) instead of a join;
* surrogate ridge (I7) and the error table (I8).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross import gram
from ..functions.hashing import hash_unit
from ..functions.ranking import hash_rank
from ..options import DEFAULT, Options
from .stats import column_quantiles


#: Numbers of the coalitions looked at together.
COALITIONS = 4 << 20


# ------------------------------------------------------------------ I1 linear
def shap_linear(df: DataFrame, features_col: str, coefficients: list[float], background_mean: list[float],
                names: list[str]) -> DataFrame:
    """Mean |SHAP| per feature for a linear model -> (feature, importance)."""
    coef = F.array(*[F.lit(float(c)) for c in coefficients])
    mu = F.array(*[F.lit(float(m)) for m in background_mean])
    nm = F.array(*[F.lit(n) for n in names])
    x = df.select(F.posexplode(vector_to_array(features_col)).alias("j", "x"))
    contrib = F.abs(F.element_at(coef, F.col("j") + 1) * (F.col("x") - F.element_at(mu, F.col("j") + 1)))
    return x.groupBy("j").agg(F.avg(contrib).alias("importance")) \
        .select(F.element_at(nm, F.col("j") + 1).alias("feature"), "importance")


def vector_mean(df: DataFrame, features_col: str, size: int) -> list[float]:
    arr = vector_to_array(features_col)
    row = df.agg(*[F.avg(arr[i]).alias(f"m{i}") for i in range(size)]).collect()[0]
    return [float(row[f"m{i}"]) for i in range(size)]


# ------------------------------------------------------------------ I1 sampled
def shap_sampled(sample: DataFrame, background: DataFrame, key: str, features_col: str, size: int,
                 predict_vec: Callable[[DataFrame], DataFrame], names: list[str], permutations: int = 8,
                 seed: int = 42, predict_rows: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Sampled permutation Shapley values -> (feature, importance = mean |phi|).

    ``predict_vec`` maps a frame with a ``features`` vector column to one with
    a double ``_out`` column (probability of the positive class or the
    regression value).  The background is a bounded sample, indexed 0..B-1.
    ``predict_rows`` gives the same of a matrix of rows; with it coalitions are
    made and scored as matrices where the row is, and only its values travel.
    """
    if predict_rows:
        return _mean_phi(_phi_in_place(sample, background, key, features_col, size, predict_rows, permutations, seed), names)
    bg = background.select(vector_to_array(features_col).alias("b"))
    bg = bg.withColumn("_bi", F.row_number().over(Window.orderBy(F.xxhash64("b"))) - 1)   # bounded background only
    nb = bg.count()
    s = sample.select(key, vector_to_array(features_col).alias("x"))
    s = s.select(key, "x", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("m"))
    s = s.withColumn("_bi", F.pmod(hash_unit(F.concat_ws(":", F.col(key).cast("string"), F.col("m").cast("string")), seed),
                                   F.lit(nb)))
    s = s.join(F.broadcast(bg), "_bi")   # background is bounded by construction (explain sample)
    idx = F.sequence(F.lit(0), F.lit(size - 1))
    # permutation order: feature j gets rank by hash(key, m, j)
    keyed = F.transform(idx, lambda j: F.struct(
        F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("m").cast("string"), j.cast("string"))), 1, 8),
               16, 10).cast("long").alias("h"), j.alias("j")))
    s = s.withColumn("order", F.transform(F.array_sort(keyed), lambda t: t["j"]))
    s = s.select(key, "m", "x", "b", "order", F.explode(F.sequence(F.lit(0), F.lit(size))).alias("k"))
    # coalition: the first k features of the order take the row's values
    inset = lambda j: F.array_position(F.slice("order", 1, F.greatest(F.col("k"), F.lit(0))), j) > 0
    vec = F.transform(idx, lambda j: F.when((F.col("k") > 0) & inset(j), F.element_at("x", j + 1)).otherwise(F.element_at("b", j + 1)))
    s = s.withColumn("features", array_to_vector(vec))
    out = predict_vec(s).select(key, "m", "k", "order", "_out")
    w = Window.partitionBy(key, "m").orderBy("k")
    d = out.withColumn("diff", F.col("_out") - F.lag("_out").over(w)).where(F.col("k") > 0)
    d = d.select(key, "m", F.element_at("order", F.col("k")).alias("j"), "diff")
    return _mean_phi(d.groupBy(key, "j").agg(F.avg("diff").alias("phi")), names)


def _phi_in_place(sample: DataFrame, background: DataFrame, key: str, features_col: str, size: int, predict_rows, permutations: int, seed: int) -> DataFrame:
    """(key, j, phi): the background row and order of every (row, permutation) as in ``shap_sampled``."""
    b = vector_to_array(features_col)
    bg = np.array([r[0] for r in background.select(b.alias("b")).orderBy(F.xxhash64("b")).collect()], float).reshape(-1, size)
    text = F.col(key).cast("string")

    def order(m):
        h = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", text, F.lit(str(m)), j.cast("string"))), 1, 8), 16, 10).cast("long")
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), h)

    row = sample.select(F.col(key).alias("key"), b.alias("x"),
                        F.array(*[F.pmod(hash_unit(F.concat_ws(":", text, F.lit(str(m))), seed), F.lit(len(bg))) for m in range(permutations)]).cast("array<long>").alias("bi"),
                        F.flatten(F.array(*[order(m) for m in range(permutations)])).alias("h"))
    step = max(1, COALITIONS // (permutations * (size + 1) * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                some = whole.slice(lo, step)
                n = some.num_rows
                x, bi, h = (np.array(some.column(i).flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) for i in (1, 2, 3))
                orders = np.argsort(h.reshape(n, permutations, size), axis=2, kind="stable")
                place = np.argsort(orders, axis=2, kind="stable")
                taken = place[:, :, None, :] < np.arange(size + 1)[:, None]              # the first k features are the row's
                mixed = np.where(taken, x[:, None, None, :], bg[bi][:, :, None, :])
                out = predict_rows(mixed.reshape(-1, size)).reshape(n, permutations, size + 1)
                phi = np.take_along_axis(np.diff(out, axis=2), place, axis=2).mean(axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(phi), pa.list_(pa.float64()))], names=["key", "phi"])

    phi = row.mapInArrow(run, f"key {dict(row.dtypes)['key']}, phi array<double>").select("key", F.posexplode("phi").alias("j", "phi"))
    # copies of a key share one walk through the coalitions, so each adds its part of it
    return phi.groupBy("key", "j").agg((F.avg("phi") / F.count(F.lit(1))).alias("phi"))


def _mean_phi(phi: DataFrame, names: list[str]) -> DataFrame:
    nm = F.array(*[F.lit(n) for n in names])
    return phi.groupBy("j").agg(F.avg(F.abs("phi")).alias("importance")) \
        .select(F.element_at(nm, F.col("j") + 1).alias("feature"), "importance")


# ------------------------------------------------------------------ I2
def native_importance(model, names: list[str]) -> list[tuple[str, float]]:
    """Tree importances, else |coef| (averaged over classes), else uniform."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
        return [(n, float(x)) for n, x in zip(names, v)]
    if hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        return [(n, float(x)) for n, x in zip(names, np.abs(m).mean(axis=0))]
    if hasattr(model, "coefficients"):
        return [(n, abs(float(x))) for n, x in zip(names, model.coefficients.toArray())]
    return [(n, 1.0 / max(1, len(names))) for n in names]


# ------------------------------------------------------------------ I3
def rotation(feature: str, rep: int, n: int, seed: int) -> int:
    """How far (1 .. n - 1) the ranks turn for one (feature, repeat)."""
    return 1 + int(hashlib.md5(f"{feature}:{rep}:{seed}".encode()).hexdigest()[:12], 16) % max(1, n - 1)


def permutation_copies(ranked: DataFrame, n: int, features: list[str], repeats: int, seed: int) -> DataFrame:
    """All (feature, repeat) copies of ``ranked`` (columns and ``_r``, a random order
    1 .. n) with ``feature`` replaced by the value of another row: the row of rank i
    takes it from rank i + rotation, around the end.

    The values travel to the rows: a narrow side of (rank, tag, value) joins the
    rows once; no copy of a whole row is shuffled."""
    tags = [(f, r, rotation(f, r, n, seed)) for f in features for r in range(repeats)]
    spread = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("rep"), F.lit(s).cast("long").alias("s")) for f, r, s in tags]))
    giver = ranked.select("_r", *[F.col(f).alias(f"_src_{f}") for f in features], spread.alias("t"))
    giver = giver.select((F.pmod(F.col("_r") - 1 - F.col("t.s"), F.lit(n)) + 1).alias("_taker"), F.col("t.feature").alias("feature"), F.col("t.rep").alias("rep"),
                         *[F.when(F.col("t.feature") == f, F.col(f"_src_{f}")).alias(f"_src_{f}") for f in features])
    j = ranked.join(giver, F.col("_r") == F.col("_taker"))
    cols = [F.when(F.col("feature") == c, F.col(f"_src_{c}")).otherwise(F.col(c)).alias(c) if c in features else F.col(c)
            for c in ranked.columns if c != "_r"]
    return j.select(*cols, "feature", "rep")


def permutation_importance(df: DataFrame, key: str, features: list[str], score_fn: Callable[[DataFrame, list[str]], DataFrame],
                           repeats: int = 5, seed: int = 42) -> DataFrame:
    """I3 -> (feature, importance, std): mean drop of the score over repeats; a row per feature.

    ``score_fn(frame, group_cols)`` returns (group_cols..., score) - one pass."""
    n = df.count()
    ranked = hash_rank(df, key, seed, rank_col="_r", n_rows=n).drop("_gn", "_h").persist()
    base = score_fn(ranked.drop("_r"), []).collect()[0]["score"]
    per = score_fn(permutation_copies(ranked, n, features, repeats, seed), ["feature", "rep"])
    rows = per.groupBy("feature").agg((F.lit(float(base)) - F.avg("score")).alias("importance"), F.stddev_pop("score").alias("std")).collect()
    ranked.unpersist()
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "feature string, importance double, std double")


def importance_topk(parts: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """I4: union of (feature, importance) tables with a ``kind`` column; top-k per kind."""
    u = None
    for kind, d in parts.items():
        x = d.select(F.lit(kind).alias("kind"), "feature", "importance")
        u = x if u is None else u.unionByName(x)
    w = Window.partitionBy("kind").orderBy(F.desc("importance"), "feature")   # one row per feature
    return u.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ I6
def partial_dependence(df: DataFrame, features: list[str], predict: Callable[[DataFrame], DataFrame],
                       points: int = 100, exact: bool = True) -> DataFrame:
    """(feature, grid_index, grid_value, average_prediction) on a grid between the
    5th and 95th percentile (linear interpolation) of each feature."""
    q = {(r["column_name"], r["prob"]): r["value"] for r in column_quantiles(df, features, [0.05, 0.95], exact=exact).collect()}
    points_of = [(f, i, q[(f, 0.05)] + (q[(f, 0.95)] - q[(f, 0.05)]) * i / (points - 1)) for f in features if (f, 0.05) in q for i in range(points)]
    if not points_of:
        return df.sparkSession.createDataFrame([], "feature string, grid_index int, grid_value double, average_prediction double")
    g = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for f, i, v in points_of])).alias("_g")
    x = df.select("*", g)
    x = x.withColumns({f: F.when(F.col("_g.f") == f, F.col("_g.v")).otherwise(F.col(f)) for f in features})
    return predict(x).groupBy(F.col("_g.f").alias("feature"), F.col("_g.i").alias("grid_index")).agg(
        F.first("_g.v").alias("grid_value"), F.avg("prediction").alias("average_prediction"))


# ------------------------------------------------------------------ I7
@dataclass
class Linear:
    coefficients: DenseVector
    intercept: float


def surrogate_ridge(df: DataFrame, features: str | list[str], prediction_col: str, alpha: float = 1.0) -> Linear:
    """Ridge (``alpha``, intercept not penalised) of the model's predictions on its features:
    solved from Gram statistics, one scan.  No rows: no coefficients."""
    g = gram(df, features, prediction_col)
    if not g:
        return Linear(DenseVector([]), 0.0)
    coef, intercept = g[0].solve(alpha)
    return Linear(DenseVector(coef), intercept)


# ------------------------------------------------------------------ I8
def error_table(pred: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(key, actual, prediction, error); with k, the k worst by |error| (top-k report)."""
    e = pred.select(key, "actual", "prediction", (F.col("actual") - F.col("prediction")).alias("error"))
    if k is None:
        return e
    return e.orderBy(F.desc(F.abs("error")), key).limit(k)
