"""Kernel maps for linear learners (G5, G12): a margin that is linear in the mapped
vectors is one of the kernel's in the given vectors.

Both maps are random, fixed by the seed, and of a chosen number of dimensions, so a
fit stays one distributed pass an iteration whatever the number of rows (an exact
kernel machine needs the matrix of all pairs of rows).

* ``rbf``, exp(-gamma |x - y|^2): random Fourier features.  Half of the dimensions
  are cosines, half sines, so a vector has length 1.  The error of one kernel value
  exceeds e with a chance of at most 2 exp(-dims e^2 / 4).
* ``poly``, (gamma x.y)^3: tensor sketch, three count sketches convolved by fast
  Fourier transforms.  Unbiased, the variance at most (3^3 - 1) / dims of the
  product of the two vectors' own kernel values.

``gamma`` is a number, ``auto`` (1 / features) or ``scale`` (1 / (features x variance
of all entries), 1 if they are constant).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNELS = ("rbf", "poly")
DEGREE = 3
DIMS = 512
ROUNDING = 1e-12           # of a sketch's largest entry
MAP_BYTES = 256 << 20      # of a worker's random directions


def kernel(x: np.ndarray, y: np.ndarray, kind: str, gamma: float) -> np.ndarray:
    """Exact kernel values of all rows of ``x`` with all of ``y`` (small sets: for checks)."""
    if kind == "poly":
        return (gamma * x @ y.T) ** DEGREE
    return np.exp(-gamma * ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


@lru_cache(maxsize=4)
def _directions(kind: str, n: int, dims: int, seed: int):
    rng = np.random.default_rng([seed, n, dims, KERNELS.index(kind)])
    if kind == "rbf":
        return rng.standard_normal((n, dims // 2))
    return rng.integers(0, dims, (DEGREE, n)), rng.choice([-1.0, 1.0], (DEGREE, n))


def map_rows(x: np.ndarray, kind: str, gamma: float, dims: int, seed: int) -> np.ndarray:
    """Rows of ``dims`` numbers whose dot products approximate the kernel."""
    n = x.shape[1]
    if kind == "rbf":
        t = x @ (_directions(kind, n, dims, seed) * np.sqrt(2.0 * gamma))
        return np.hstack([np.cos(t), np.sin(t)]) * np.sqrt(2.0 / dims)
    place, sign = _directions(kind, n, dims, seed)
    product = 1.0
    for d in range(DEGREE):
        sketch = np.zeros((dims, len(x)))
        np.add.at(sketch, place[d], (x * (sign[d] * np.sqrt(gamma))).T)
        product = product * np.fft.rfft(sketch, axis=0)
    z = np.fft.irfft(product, n=dims, axis=0).T
    # a dimension no product falls into holds the transform's rounding, which a learner that scales features would blow up
    return np.where(np.abs(z) > ROUNDING * np.abs(z).max(axis=1, initial=0.0, keepdims=True), z, 0.0)


class _KernelParams(HasInputCol, HasOutputCol, HasSeed):
    kernel = Param(Params._dummy(), "kernel", "rbf or poly", TypeConverters.toString)
    dims = Param(Params._dummy(), "dims", "dimensions of the mapped vectors", TypeConverters.toInt)


class KernelMap(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fixes gamma from the training vectors (one aggregate) and maps vectors to ``dims`` dense numbers."""

    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel_features", kernel="rbf", gamma="scale", dims=DIMS, seed=42):
        super().__init__()
        if kernel not in KERNELS or dims < 2 or dims % 2:
            raise ValueError(f"kernel {kernel} with {dims} dimensions: one of {KERNELS}, an even number")
        self._set(**{k: str(v) if k == "gamma" else v for k, v in self._input_kwargs.items()})
        self._setDefault(inputCol="features", outputCol="kernel_features", kernel="rbf", gamma="scale", dims=DIMS, seed=42)

    def _fit(self, df: DataFrame) -> "KernelMapModel":
        kind, dims, name = self.getOrDefault("kernel"), self.getOrDefault("dims"), self.getInputCol()
        row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(name)).alias("s")).select("s.*").first()
        mean, var, count = row["mean"].toArray(), row["variance"].toArray(), row["count"]
        n = len(mean)
        if n * dims * 8 > MAP_BYTES:
            raise ValueError(f"{n} features x {dims} dimensions exceed {MAP_BYTES} bytes in each worker")
        gamma = self.getOrDefault("gamma")
        if gamma in ("scale", "auto"):
            spread = float(np.mean(var * (count - 1) / max(count, 1) + (mean - mean.mean()) ** 2)) if n and gamma == "scale" else 1.0
            value = 1.0 / (max(n, 1) * spread) if spread > 0 else 1.0
        else:
            value = float(gamma)
        return KernelMapModel(inputCol=name, outputCol=self.getOutputCol(), kernel=kind, dims=dims, seed=self.getSeed(), width=value)


class KernelMapModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    width = Param(Params._dummy(), "width", "the kernel's gamma", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel_features", kernel="rbf", dims=DIMS, seed=42, width=1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        kind, dims, seed, gamma = (self.getOrDefault(p) for p in ("kernel", "dims", "seed", "width"))

        @F.pandas_udf("array<double>")
        def mapped(v: pd.Series) -> pd.Series:
            if not len(v):
                return v
            return pd.Series(list(map_rows(np.stack(v.to_list()).astype(float), kind, gamma, dims, seed)))

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))
