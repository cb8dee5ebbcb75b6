"""Whitening of vectors on the leading components of their covariance.

Entries become whole numbers x = floor(64 c) + 1000000.  The distinct x vectors
are the fit list.  Two passes over it give exact sums: S per dimension, then the
products of entries less the whole number next to the mean (so the products are
of centred values; what the rounding of the mean left is taken off in whole
numbers), from which V = covariance with divisor n is correct to the last bit.
Its leading eigenpairs come from spectrum slicing (``spectrum.leading``): LDL'
inertia counts isolate each eigenvalue, Rayleigh quotient iteration finds it,
counts certify its number.  A third pass over the fit list measures how far the
covariance of the whitened vectors is from the identity.

Scale: the fit list is one aggregate of packed vectors (two bytes an entry where
they fit; copies collapse before the shuffle); every pass after it sends d (d + 1) / 2
sums a task.  d is at most ``DIMENSIONS``; the driver holds a d x d matrix, never vectors.

Defined results: a vector that is null or empty, or holds a null, a non-finite
entry or one with |64 c| of 2^50 or more, gets no row; nor does one whose length
is not the fit list's most frequent (of equally frequent ones the greatest).
Repeated and null ids each get their rows, ids are returned as given.
Components without variance (eigenvalues that are zero at working precision) are
left out, so that one vector alone, or an empty table, gives no row.
``deviation`` is exact: sum over dimensions of (n x - S)^2, as decimal.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import spectrum
from .common import discard, materialize, prepare_workers

STEP = 64                 # an entry is measured in units of 1 / STEP
OFFSET = 1_000_000        # added to make x
LARGEST = float(1 << 50)  # of |STEP * entry|
COMPONENTS = 16
DIMENSIONS = 4096
CHUNK = 2048              # rows multiplied at a time


# ------------------------------------------------------------------ vectors in batches
def whole(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(64 c) of them) for each length among the usable vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    length = np.diff(offsets)
    length[column.is_null().to_numpy(zero_copy_only=False)] = 0
    values = column.values.to_numpy(zero_copy_only=False).astype(float)     # a null is nan
    out = []
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        c = STEP * values[offsets[rows][:, None] + np.arange(d)]
        good = (np.abs(c) < LARGEST).all(axis=1)
        if good.any():
            out.append((rows[good], np.floor(c[good]).astype(np.int64)))
    return out


def packed(z: np.ndarray) -> list[bytes]:
    """One canonical byte string for each vector: two bytes an entry if they hold all of them."""
    small = np.abs(z).max(axis=1) < 1 << 15
    return [b"s" + r.astype("<i2").tobytes() if s else b"l" + r.astype("<i8").tobytes() for r, s in zip(z, small)]


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    rows = column.to_pylist()
    z = np.empty((len(rows), d), np.int64)
    short = [i for i, b in enumerate(rows) if b[:1] == b"s"]
    if short:
        z[short] = np.frombuffer(b"".join(rows[i][1:] for i in short), "<i2").reshape(-1, d)
    for i in set(range(len(rows))) - set(short):
        z[i] = np.frombuffer(rows[i][1:], "<i8")
    return z


# ------------------------------------------------------------------ fit
def fit_list(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(v, d): each distinct vector once, packed, and its length."""
    prepare_workers(vectors.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, z in whole(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(packed(z), pa.binary()), pa.array(np.full(len(z), z.shape[1], np.int32))], names=["v", "d"])

    return vectors.select(F.col(vector_col).alias("v")).mapInArrow(pack, "v binary, d int").groupBy("v", "d").agg(F.count(F.lit(1)).alias("copies")).select("v", "d")


def _summed(fit: DataFrame, d: int, part) -> dict[int, int]:
    """Exact sums over the fit list of the whole numbers that ``part(z, total)`` adds to a task's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                found = part(unpacked(b.column(0).slice(lo, CHUNK), d))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0))], names=["i", "s"])

    return {r.i: int(r.s) for r in fit.select("v").mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> dict:
    """n, d, S less n * OFFSET (``sums``), eigenvalues, vectors (columns), trace and identity_error."""
    found = materialize(fit_list(vectors, vector_col), "whiten-fit")
    kinds = found.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not kinds:
        return {"n": 0, "d": 0, "sums": [], "values": np.zeros(0), "vectors": np.zeros((0, 0)), "trace": 0.0, "identity_error": 0.0}
    d, n = int(kinds[0].d), int(kinds[0].n)
    if d > DIMENSIONS:
        raise ValueError(f"{d} dimensions: the covariance would exceed {DIMENSIONS} x {DIMENSIONS}")
    one = found.where(F.col("d") == d)
    s = _summed(one, d, lambda z: z.astype(object).sum(axis=0))
    sums = [s[i] for i in range(d)]
    middle = np.array([(2 * x + n) // (2 * n) for x in sums], np.int64)         # the whole number next to each mean
    upper = np.triu_indices(d)

    def products(z: np.ndarray) -> np.ndarray:
        z = z - middle
        if np.abs(z).max() < 1 << 21:            # products of 22 bits, summed over 2048 rows: exact in doubles
            q = (z.T.astype(float) @ z.astype(float)).astype(np.int64).astype(object)
        else:
            q = z.T.astype(object) @ z.astype(object)
        return q[upper]

    q = _summed(one, d, products)
    rest = [x - n * int(m) for x, m in zip(sums, middle)]
    v = np.empty((d, d))
    for at, (i, j) in enumerate(zip(*upper)):
        v[i, j] = v[j, i] = (n * q[at] - rest[i] * rest[j]) / (n * n)           # one rounding
    values, axes = spectrum.leading(v, components)
    some = values > 8 * d * spectrum.EPS * float(np.abs(v).sum(axis=1).max())
    model = {"n": n, "d": d, "sums": sums, "middle": middle, "values": values[some], "vectors": axes[:, some], "trace": float(np.trace(v))}
    model["identity_error"] = _identity_error(one, model)
    discard(found)
    return model


def _projection(model: dict):
    """x - S / n projected on the components, over the roots of their eigenvalues; takes floor(64 c)."""
    n, middle = model["n"], model["middle"]
    off = np.array([(x - n * int(m)) / n for x, m in zip(model["sums"], middle)])
    axes = model["vectors"] / np.sqrt(model["values"])
    return lambda z: ((z - middle) - off) @ axes


def _identity_error(fit_rows: DataFrame, model: dict) -> float:
    """Largest absolute entry of the whitened fit list's covariance (divisor n) less the identity."""
    k, d, n = len(model["values"]), model["d"], model["n"]
    if not k:
        return 0.0
    project = _projection(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = project(unpacked(b.column(0), d))
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "s"])

    got = {r.i: r.s for r in fit_rows.select("v").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    total = np.array([got[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.multiply.outer(total[0], total[0]) - np.eye(k)).max())


# ------------------------------------------------------------------ transform
def transform(vectors: DataFrame, model: dict, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation (decimal), whitened (array of doubles, one a component) of every usable vector."""
    prepare_workers(vectors.sparkSession)
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_v"))
    schema = StructType([d.schema["vec_id"], *StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields])
    if not len(model["values"]):
        return vectors.sparkSession.createDataFrame([], schema)
    project, n, middle = _projection(model), model["n"], model["middle"]
    rest = np.array([x - n * int(m) for x, m in zip(model["sums"], middle)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, z in whole(b.column(1)):
                if z.shape[1] != len(middle):
                    continue
                far = z - middle
                if (n * int(np.abs(far).max()) + int(np.abs(rest).max())) ** 2 * len(middle) < 1 << 63:
                    deviation = ((n * far - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [int(x) for x in ((n * far.astype(object) - rest) ** 2).sum(axis=1)]
                w = project(z)
                deviation = pa.array([Decimal(x) if x < 10 ** 38 else None for x in deviation], pa.decimal128(38, 0))
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return d.mapInArrow(run, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, vector_col, components)
    share = F.array(*[F.lit(float(e) / model["trace"]) for e in model["values"]]) if len(model["values"]) else F.array().cast("array<double>")
    return transform(vectors, model, id_col, vector_col).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened")).select(
        "vec_id", (F.col("component") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("component") + 1).alias("explained"), F.lit(model["identity_error"]).alias("identity_error"))
