"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors at cosine c lie sqrt(2 - 2c) apart.  A hash is a Gaussian
projection plus an offset, divided by a width and floored; K of them make a
table's bucket, and L tables are used.  K follows from the number of vectors
(a bucket should hold about ``OCCUPANCY`` unrelated ones) and L from the recall
wanted at the threshold itself, by the collision probability of p-stable
hashes; nearer pairs are found more often.

Equal vectors are one class before anything is hashed.  In a bucket all pairs
are compared by one matrix product in double precision; a pair that meets in
several tables counts in the first only.  A bucket of more than ``BLOCK``
classes is cut into blocks, and pairs of blocks go to different tasks.  What
leaves a block pair is one row per linked class (its number of links, and the
least class of its local component), never the pairs.

Null, zero or non-finite vectors (also in one component) link with nothing;
so do vectors of different lengths.  A node is a row: rows that share an id, or
have none, stay apart.  Ids are returned as given; a component is named by its
smallest id, null if none of its rows has one.  Other columns, labels too, are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers, materialize
from .components import components

COSINE = 0.95
MISS = 1e-4          # chance to miss a pair right at the threshold, at most
WIDTH = 2.0
OCCUPANCY = 256
BLOCK = 2048
SEED = 17


def normalised(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one p-stable hash agrees on two points ``distance`` apart."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def parameters(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(hashes a table, tables) for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(1, math.floor(math.log(max(2.0, n / OCCUPANCY)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-near ** k))


def signatures(x: np.ndarray, k: int, tables: int, seed: int = SEED, width: float = WIDTH) -> np.ndarray:
    """(vector, table): 64-bit bucket keys of normalised vectors."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * k))
    b = rng.random(tables * k) * width
    h = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    key = np.zeros((len(x), tables), dtype=np.uint64)
    for i in range(k):
        key = (key ^ h[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each index's component, by links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, table: int, cosine: float, same: bool):
    """Pairs (row of x, row of y) at least ``cosine`` alike whose first common table is ``table``."""
    for lo in range(0, len(x), 512):
        near = (x[lo:lo + 512] @ y.T) >= cosine
        if same:
            near &= np.arange(len(y))[None, :] > np.arange(lo, lo + len(near))[:, None]
        i, j = np.nonzero(near)
        i += lo
        new = np.ones(len(i), dtype=bool)
        for t in range(table):
            new &= sx[i, t] != sy[j, t]
        yield i[new], j[new]


def links(classes: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """(cls, weight, root) rows: links counted per block pair, and a linked class to join."""
    spark = classes.sparkSession
    k, tables = parameters(n, cosine)
    stored = np.float32 if classes.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(2).to_pylist()
            out_i, out_s, out_x = [], [], []
            for size in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == size]
                raw = np.array([vecs[i] for i in at], dtype=stored)
                out_i += at
                out_s += list(signatures(normalised(raw), k, tables))
                out_x += [r.tobytes() for r in raw]
            idx = pa.array(out_i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(out_x, pa.binary()), pa.array([r.tobytes() for r in out_s], pa.binary()),
                                              pa.array(out_s, pa.list_(pa.int64()))], names=["cls", "m", "x", "sig", "keys"])

    signed = materialize(classes.mapInArrow(sign, "cls long, m long, x binary, sig binary, keys array<long>"), "lsh-signed")
    hot = materialize(signed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count(F.lit(1)).alias("_n"))
                      .where(F.col("_n") > BLOCK).select(F.col("t").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks")), "lsh-hot", True)
    rows = signed.select("cls", "m", "x", "sig", F.posexplode("keys").alias("t", "key"))
    rows = rows.join(hot, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_k")), "left").drop("_t", "_k")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn(
        "other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
    rows = rows.select("t", "key", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "blk", "cls", "m", "x", "sig")
    cell = ["t", "key", "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells():
            held: list = []
            now = None
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    if r[:4] != now:
                        if len(held) > 1:
                            yield now, held
                        held, now = [], r[:4]
                    held.append(r[4:])
            if len(held) > 1:
                yield now, held

        out = ([], [], [])
        for (t, _, a, b), rs in cells():
            size = {len(r[3]) for r in rs}
            for s in size:
                part = [r for r in rs if len(r[3]) == s]
                left = [r for r in part if r[0] == a]
                right = part[:0] if a == b else [r for r in part if r[0] == b]
                all_rows = left + right
                x = normalised(np.frombuffer(b"".join(r[3] for r in all_rows), dtype=stored).reshape(len(all_rows), -1))
                sig = np.frombuffer(b"".join(r[4] for r in all_rows), dtype=np.int64).reshape(len(all_rows), -1)
                m = np.array([r[2] for r in all_rows], dtype=np.int64)
                cls = np.array([r[1] for r in all_rows], dtype=np.int64)
                n_left = len(left)
                y, sy, base = (x, sig, 0) if a == b else (x[n_left:], sig[n_left:], n_left)
                weight = np.zeros(len(all_rows), dtype=np.int64)
                root = np.arange(len(all_rows))
                for i, j in block_links(x[:n_left], y, sig[:n_left], sy, t, cosine, a == b):
                    if len(i):
                        j = j + base
                        np.add.at(weight, i, m[j])
                        np.add.at(weight, j, m[i])
                        own = np.flatnonzero(root != np.arange(len(root)))
                        root = _least(len(root), np.concatenate([i, own]), np.concatenate([j, root[own]]))
                hit = np.flatnonzero(weight)
                out[0].extend(cls[hit].tolist()), out[1].extend(weight[hit].tolist()), out[2].extend(cls[root[hit]].tolist())
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cls", "weight", "root"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cls", "weight", "root"])

    return rows.repartition(*cell).sortWithinPartitions(*cell, "cls").mapInArrow(compare, "cls long, weight long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector."""
    prepare_workers(vectors.sparkSession)
    v = F.col(vec_col)
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(finite, F.transform(v, lambda c: F.when(c == 0, F.abs(c)).otherwise(c))).alias("v"))
    d = d.withColumn("vkey", F.sha2(F.to_json("v").cast("binary"), 256))
    # a class is a vector, known by its digest: rows that share an id, or have none, stay apart
    grouped = d.where("v IS NOT NULL").groupBy("vkey").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = materialize(grouped.withColumn("cls", F.xxhash64("vkey")), "lsh-classes")
    found = materialize(links(classes.select("cls", "m", "v"), classes.count(), cosine), "lsh-links", True)
    groups = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    weights = found.groupBy("cls").agg(F.sum("weight").alias("weight"))
    per = classes.select("vkey", "cls", "m", "rep").join(weights, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    per = materialize(per.withColumn("group", F.coalesce("component", "cls")), "lsh-per-class", True)
    least = per.where("component IS NOT NULL").groupBy(F.col("group").alias("_group")).agg(F.min("rep").alias("least"))
    per = per.join(least, F.col("group") == F.col("_group"), "left").select(
        F.col("vkey").alias("_vkey"), (F.coalesce("weight", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = d.select("vec_id", "vkey").join(per, F.col("vkey") == F.col("_vkey"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("_vkey").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
