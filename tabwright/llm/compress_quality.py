"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from labelled good text and one
from bad.  A text is cut into blocks of ``BLOCK`` bytes (a dictionary helps a
compressor most at its start), and every block of the whole text is compressed
with each dictionary.  The bytes that the good dictionary saves over the bad
one, per byte of text, are the measure:

    x = (bad size - good size + SHRINK * mean) / (bytes + SHRINK)

where ``mean`` is that ratio over the calibration texts, so that a few words
say little and an empty or null text has x = mean.  A logistic curve, fitted on
labelled texts that neither dictionary has seen and weighted to the classes'
shares among all labels, turns x into the probability of label 1.

Bounds of training: at most ``DICTIONARY_DOCS`` texts a class for a dictionary
and ``CALIBRATION_DOCS`` a class for the curve, the ones with the least hash of
their id; of a text the dictionaries take at most ``PIECES`` pieces, evenly
spread over it.  Scoring has no bound: all texts, each whole.

Labels other than 0 and 1 teach nothing; a document with several labels has
their majority, and none if they tie.  Rows that repeat an id are scored
apart; null ids are scored and taught by no label.  Without both labels every
score is the share of label 1 (0.5 without any label).  Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare_workers

DICTIONARY_DOCS = 1000   # texts per class behind a dictionary
CALIBRATION_DOCS = 2000  # texts per class behind the curve
PIECES = 16              # pieces of one text
PIECE = 1024             # bytes
DICTIONARY_BYTES = 64 << 10
BLOCK = 256              # bytes compressed at a time
LEVEL = 3
SHRINK = 64              # bytes
THRESHOLD = 0.7


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def pieces_of(text: str) -> list[bytes]:
    """At most PIECES pieces of PIECE bytes, evenly spread over the text."""
    b = text.encode()
    starts = range(0, max(len(b), 1), PIECE)
    step = max(1, -(-len(starts) // PIECES))
    return [b[s:s + PIECE] for s in starts[::step]]


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; too few pieces to train one become a raw one."""
    pieces = [p for p in pieces if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


class Sizer:
    """Compressed sizes of texts under each of some dictionaries."""

    def __init__(self, dictionaries: list[bytes]):
        self.compress = []
        for d in dictionaries:
            data = zstandard.ZstdCompressionDict(d or b" ")
            data.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> list[int]:
        """Bytes of the text, then its size under each dictionary."""
        b = (text or "").encode()
        blocks = [b[s:s + BLOCK] for s in range(0, len(b), BLOCK)]
        return [len(b), *(sum(map(len, map(c, blocks))) for c in self.compress)]


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of a weighted logistic regression, by Newton's method.

    A weak pull of the slope, in units of x's spread, keeps it finite where x separates the labels."""
    mid, spread = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    z = np.column_stack([(x - mid) / spread, np.ones_like(x)])
    pull = np.array([1e-3 * weight.sum(), 0.0])
    beta = np.zeros(2)

    def loss(b):
        m = z @ b
        return float((weight * (np.logaddexp(0.0, m) - y * m)).sum() + 0.5 * (pull * b * b).sum())

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -500, 500)))
        slope = z.T @ (weight * (p - y)) + pull * beta
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull) + 1e-12 * np.eye(2)
        step, size, now = np.linalg.solve(bend, slope), 1.0, loss(beta)
        while loss(beta - size * step) > now and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * mid / spread)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          dictionary_docs: int = DICTIONARY_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> dict:
    """{"dictionaries": [good, bad], "mean", "slope", "intercept"}; both frames hold only rows to learn from."""
    prepare_workers(docs.sparkSession)
    marks = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y"))
             .where("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.avg("_y").alias("_y")).where("_y != 0.5")
             .select("_id", (F.col("_y") > 0.5).cast("int").alias("_y")))
    count = {r._y: r.n for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = {"dictionaries": [], "mean": 0.0, "slope": 0.0, "intercept": 0.0}
    if len(count) < 2:
        share = 0.5 if not count else 1.0 - 1e-9 if 1 in count else 1e-9
        return model | {"intercept": float(np.log(share / (1 - share)))}
    # the labels with the least hash of their id, each class: a bounded list of ids, not a scan by label
    order = F.md5(F.concat(F.col("_id").cast("string"), F.lit("|quality")))
    chosen = []
    for y in (1, 0):
        ids = [r[0] for r in marks.where(F.col("_y") == y).orderBy(order, "_id").limit(dictionary_docs + calibration_docs).collect()]
        cut = min(dictionary_docs, (len(ids) + 1) // 2)
        chosen += [(i, y, k < cut) for k, i in enumerate(ids)]
    picked = docs.sparkSession.createDataFrame(chosen, "_id long, _y int, _fit boolean")      # bounded by the two parameters
    texts = docs.select(F.col(id_col).cast("long").alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")) \
        .join(F.broadcast(picked), F.col("_key") == F.col("_id")).select("_id", "_y", "_fit", "_text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pieces_of(t) for t in b.column(3).to_pylist()], pa.list_(pa.binary()))], names=["i", "y", "p"])

    # a repeated id teaches once, by its least text
    rows = texts.where("_fit").mapInArrow(cut_up, "i long, y int, p array<binary>").groupBy("i", "y").agg(F.min("p").alias("p")).orderBy("i").collect()
    dictionaries = [dictionary([bytes(p) for r in rows if r.y == y for p in r.p]) for y in (1, 0)]
    sized = sizes(texts.where("NOT _fit").select("_id", "_y", "_text"), "_text", dictionaries)
    got = sized.groupBy("_id", "_y").agg(F.min(F.struct("n_bytes", "good", "bad")).alias("s")).orderBy("_id").collect()
    a = np.array([[r.s.n_bytes, r.s.good, r.s.bad, r._y] for r in got], float).reshape(-1, 4)
    model["dictionaries"] = dictionaries
    model["mean"] = float((a[:, 2] - a[:, 1]).sum() / max(1.0, a[:, 0].sum()))
    y = a[:, 3]
    total = sum(count.values())
    if len(set(y)) < 2:          # too few labels for a second set: the shares alone
        return model | {"intercept": float(np.log(count[1] / count[0]))}
    weight = np.where(y == 1, count[1] / total / max(1, (y == 1).sum()), count[0] / total / max(1, (y == 0).sum())) * len(y)
    model["slope"], model["intercept"] = fit_curve(measure(a[:, 0], a[:, 1], a[:, 2], model["mean"]), y, weight)
    return model


def measure(n_bytes, good, bad, mean: float):
    return (bad - good + SHRINK * mean) / (n_bytes + SHRINK)


def sizes(docs: DataFrame, text_col: str, dictionaries: list[bytes]) -> DataFrame:
    """The other columns of ``docs`` and n_bytes, good, bad: bytes of the whole text, plain and compressed."""
    at = docs.columns.index(text_col)
    schema = StructType([*(f for f in docs.schema if f.name != text_col), *StructType.fromDDL("n_bytes long, good long, bad long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries)
        for b in batches:
            found = np.array([sizer(t) for t in b.column(at).to_pylist()], np.int64).reshape(-1, 3)
            others = [c for i, c in enumerate(b.columns) if i != at]
            names = [n for i, n in enumerate(b.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*others, *(pa.array(found[:, k]) for k in range(3))], names=[*names, "n_bytes", "good", "bad"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1), predicted, and the measure behind it: n_bytes, saved."""
    prepare_workers(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    if model["dictionaries"]:
        d = sizes(d, "_text", model["dictionaries"])
    else:
        d = d.select("doc_id", F.octet_length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
    x = measure(F.col("n_bytes"), F.col("good"), F.col("bad"), model["mean"])
    p = F.round(1.0 / (1.0 + F.exp(-(x * model["slope"] + model["intercept"]))), 9)
    return d.select("doc_id", p.alias("score"), "n_bytes", (F.col("bad") - F.col("good")).cast("long").alias("saved")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
