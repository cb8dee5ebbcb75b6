"""Sums of products of columns by matrix multiplication: pairwise-complete
correlations (D5, I5, F2) and Gram statistics (G2, I7).

A task adds up matrix products of its Arrow batches; what leaves it is a row per
pair of columns (or per pair and fold), whatever the number of rows.  Sums are
taken of values less a shift near the column's mean, since raw second moments
lose the variance of a column far from zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns whose pairs one scan adds up; more columns take a scan per pair of blocks of half as many.
WIDTH = 1024
#: Rows behind the shift.
SHIFT_ROWS = 1000
#: Share of a pair's second moment under which its variance counts as lost to rounding.
LOST = 1e-7


def _shift(x: DataFrame) -> np.ndarray:
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    got = x.limit(SHIFT_ROWS).agg(*[F.avg(finite(c)).alias(c) for c in x.columns]).first()
    return np.array([0.0 if v is None else float(v) for v in got])


def _dense(batch: pa.RecordBatch, columns) -> tuple[np.ndarray, np.ndarray]:
    """(values, present) of some columns; a null is 0 and not present."""
    present = np.column_stack([~batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in columns])
    values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
    return np.where(present, values, 0.0), present


def pair_sums(df: DataFrame, left: list[Column], right: list[Column]) -> np.ndarray:
    """(7, left, right): n, sums of x, y, xx, yy, xy less the shift over the rows with both values, and the
    number of those rows where one is not finite.  One scan, one aggregate."""
    both = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate([*left, *right])])
    shift, a, b = _shift(both), len(left), len(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((7, a, b))
        for batch in batches:
            if not batch.num_rows:
                continue
            v, present = _dense(batch, range(a + b))
            odd = present & ~np.isfinite(v)
            v, m = np.where(present & ~odd, v - shift, 0.0), present.astype(float)
            x, y, mx, my, ox, oy = v[:, :a], v[:, a:], m[:, :a], m[:, a:], odd[:, :a].astype(float), odd[:, a:].astype(float)
            total += np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y, ox.T @ my + mx.T @ oy])
        i, j = np.indices((a, b)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(t.ravel()) for t in total)], names=["i", "j", *"nxyuvwo"])

    rows = both.mapInArrow(run, "i long, j long, " + ", ".join(f"{c} double" for c in "nxyuvwo"))
    got = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nxyuvwo"]).toPandas()       # a row per pair
    out = np.zeros((7, a, b))
    out[:, got.i, got.j] = got[list("nxyuvwo")].to_numpy().T
    return out


def pearson(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r, unsure): nan where a value is not finite or rows are fewer than one; unsure where a variance may be rounding."""
    n, x, y, xx, yy, xy, odd = sums
    with np.errstate(all="ignore"):
        vx, vy, c = xx - x * x / n, yy - y * y / n, xy - x * y / n
        r = np.where((n > 0) & (odd == 0) & (vx > 0) & (vy > 0), c / np.sqrt(vx) / np.sqrt(vy), np.nan)
        unsure = (n > 0) & (odd == 0) & ((vx <= LOST * xx) | (vy <= LOST * yy)) & (xx > 0) & (yy > 0)
    return np.clip(r, -1.0, 1.0), unsure


# ------------------------------------------------------------------ Gram statistics
@dataclass
class Gram:
    """n, sums and products of features and label (last), less ``shift``.  Those of two sets of rows add up."""
    n: float
    sums: np.ndarray
    products: np.ndarray
    shift: np.ndarray

    def __add__(self, o: "Gram") -> "Gram":
        return Gram(self.n + o.n, self.sums + o.sums, self.products + o.products, self.shift)

    def __sub__(self, o: "Gram") -> "Gram":
        return Gram(self.n - o.n, self.sums - o.sums, self.products - o.products, self.shift)

    def centred(self) -> np.ndarray:
        return self.products - np.outer(self.sums, self.sums) / max(self.n, 1)

    def solve(self, alpha: float = 0.0) -> tuple[np.ndarray, float]:
        """Coefficients and intercept of ridge (``alpha``, intercept free) or, with 0, of least squares;
        directions without variance get no weight (the shortest solution)."""
        c = self.centred()
        values, axes = np.linalg.eigh(c[:-1, :-1])
        keep = values + alpha > 1e-12 * max(values.max(initial=0.0), 1e-300) if len(values) else np.zeros(0, bool)
        coef = axes[:, keep] @ ((axes[:, keep].T @ c[:-1, -1]) / (values[keep] + alpha))
        mean = self.sums / max(self.n, 1) + self.shift
        return coef, float(mean[-1] - coef @ mean[:-1])

    def sse(self, coef: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of a linear model over these rows."""
        w = np.append(-coef, 1.0)                                  # error = w . (shifted values) - c
        c = intercept - self.shift[-1] + coef @ self.shift[:-1]
        return float(w @ self.products @ w - 2 * c * (w @ self.sums) + self.n * c * c)

    def r2(self, coef: np.ndarray, intercept: float) -> float:
        total = self.centred()[-1, -1]
        return 1 - self.sse(coef, intercept) / total if total > 0 else float("nan")


def gram(df: DataFrame, features: str | list[str], label: str, fold: str | None = None) -> dict[int, Gram]:
    """fold -> Gram (0 alone without ``fold``) from one scan and one aggregate.  ``features``: a vector column
    or numeric columns; rows with a null take no part.  At most ``WIDTH`` features."""
    x = vector_to_array(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    d = df.select(x.alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold).cast("long") if fold else F.lit(0).cast("long")).alias("f"))
    d = d.where(F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    first = d.limit(SHIFT_ROWS).select("x", "y").collect()
    if not first:
        return {}
    shift = np.array([[*r.x, r.y] for r in first], float).mean(axis=0)
    k = len(shift)
    if k > WIDTH + 1:
        raise ValueError(f"{k - 1} features; a Gram matrix is built of at most {WIDTH}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = np.column_stack([b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy()]) - shift
            v = np.column_stack([v, np.ones(b.num_rows)])          # the last row of the products is the sums and n
            f = b.column(2).fill_null(-1).to_numpy()
            for g in np.unique(f):
                part = v[f == g]
                total[g] = total.get(g, 0.0) + part.T @ part
        for g, t in total.items():
            cells = np.arange(t.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, g)), pa.array(cells), pa.array(t.ravel())], names=["f", "i", "s"])

    rows = d.mapInArrow(run, "f long, i long, s double").groupBy("f", "i").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for g, part in rows.groupby("f"):
        t = np.zeros((k + 1) * (k + 1))
        t[part.i] = part.s
        t = t.reshape(k + 1, k + 1)
        out[int(g)] = Gram(float(t[k, k]), t[k, :k], t[:k, :k], shift)
    return out


def total(grams: dict[int, Gram]) -> Gram:
    first, *rest = grams.values()
    return sum(rest, start=first)


def gram_cross_validate(grams: dict[int, Gram], alpha: float = 0.0) -> dict[int, float]:
    """fold -> R2 on the fold of the model fitted to the other folds, without another look at the rows."""
    whole = total(grams) if grams else None
    return {f: g.r2(*(whole - g).solve(alpha)) for f, g in grams.items()}
