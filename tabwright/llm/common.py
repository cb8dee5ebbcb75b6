"""Helpers shared by the corpus operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared
by driver and executors), so they cut lineage and survive lost executors.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import checkpoint_dir

#: One word: a run of characters other than space, tab, line feed, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows up to which a side may be broadcast; larger sides take a shuffled join.
BROADCAST_ROWS = 200_000
#: Most bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 8 << 20


def prepare_workers(spark: SparkSession) -> None:
    """Cap Arrow batches by bytes, so that long texts cannot pile up in a worker, and
    make this package importable there (once per context, as ``--py-files`` would)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_tabwright_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder in ("", "llm"):
            for f in sorted(os.listdir(os.path.join(root, folder))):
                if f.endswith(".py"):
                    z.write(os.path.join(root, folder, f), os.path.join("tabwright", folder, f))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabwright-{uuid.uuid4().hex}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._tabwright_shipped = True


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, light: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage ends here).

    ``light``: rows of a few numbers, written in two files a core at most (files
    are dear on every file system, and on a local one each costs two processes)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    (df.coalesce(2 * max(2, spark.sparkContext.defaultParallelism)) if light else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that no plan reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is broadcast only if its counted rows stay within
    ``max_rows``; a larger side is joined by a shuffle (AQE splits skew).
    ``small`` should be a materialized or literal table, since it is counted."""
    few = small.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(small) if few else small, on, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
