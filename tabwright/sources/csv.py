"""CSV scan with pandas-compatible missing-value tokens and type inference (A1).

Spark's ``nullValue`` takes a single token, so the file is read as strings,
every NA token becomes NULL, and each column's type is inferred from the
cleaned strings in ONE aggregate over all columns (how many non-null values
cast to bigint / double / boolean), then cast.  Header names are trimmed.

Quoted fields may hold line breaks, and one file is still read by many tasks.
Spark's text source deals physical lines out by byte ranges.  Whether a line
starts a record depends on all text before it, but only through one bit: is a
quoted field open?  So each range says, for both cases, in which state it ends
and whether a record starts in it; a window over the ranges of a file composes
these two-state maps into the true state at each start.  With that state known
the ranges are cut into records apart, and the pieces of a record that
crosses ranges (a piece a range) meet by the range it started in.  The records
are stored once; types and values are taken from the store.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import work_dir

# --- fixed values: pandas' default missing-value tokens -------------------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BOOL_TOKENS = ("True", "False", "TRUE", "FALSE", "true", "false")
# ---------------------------------------------------------------------------

_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
BATCH_CHARS = 8 << 20      # of records in one Arrow batch
OPEN_RANGES = 2_000_000    # ranges that start within a field: one entry each is broadcast


def infer_types(df: DataFrame) -> dict[str, str]:
    aggs = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n{i}"), F.count(x.try_cast("bigint")).alias(f"i{i}"),
                 F.count(x.try_cast("double")).alias(f"d{i}"), F.count(F.when(x.isin(*BOOL_TOKENS), 1)).alias(f"b{i}")]
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "double"          # an all-missing column reads as float NaN in pandas
        elif row[f"i{i}"] == n:
            out[c] = "bigint"
        elif row[f"d{i}"] == n:
            out[c] = "double"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def open_after(line: str, is_open: bool) -> bool:
    """Whether a quoted field is open at the end of a line.  A quote opens a field as its
    first character only; after the closing quote the field goes on to the next comma."""
    at = 0
    while True:
        if not is_open:
            if line.startswith('"', at):
                at += 1
            else:
                at = line.find(',"', at) + 2
                if at == 1:
                    return False
        m = _CLOSING.match(line, at)
        if not m:
            return True
        at = line.find(",", m.end()) + 1
        if not at:
            return False
        is_open = False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: the end state and whether a record starts, if no field is open at its start (0) and if one is (1)."""
    rows, key = [], None
    for file, start, line in _runs(batches):
        if (file, start) != key:
            key = (file, start)
            rows.append([file, start, False, True, False, False])
        r = rows[-1]
        r[4], r[5] = r[4] or not r[2], r[5] or not r[3]
        if '"' in line:
            same = r[2] == r[3]
            r[2] = open_after(line, r[2])
            r[3] = r[2] if same else open_after(line, r[3])
    cols = list(zip(*rows)) or [()] * 6
    types = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "start", "end0", "end1", "has0", "has1"])


def range_states(maps: DataFrame) -> DataFrame:
    """file, start, is_open (a field is open there) and owner (the range its record started in).

    A map that sends both states to one fixes the state; the others keep or swap it.  So the
    state is the last fixed one, turned once for each swap since."""
    w = Window.partitionBy("file").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    m = maps.withColumn("turns", F.coalesce(F.sum(F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0)).over(w), F.lit(0)))
    fixed = F.when(F.col("end0") == F.col("end1"), (F.col("end0").cast("int") + F.col("turns")) % 2)
    m = m.withColumns({"fixed": F.last(fixed, True).over(before), "turned": F.coalesce(F.max("turns").over(before), F.lit(0))})
    m = m.withColumn("is_open", (F.coalesce("fixed", F.lit(0)) + F.col("turned")) % 2 == 1)
    has = F.when(F.col("is_open"), F.col("has1")).otherwise(F.col("has0"))
    return m.withColumn("owner", F.last(F.when(has, F.col("start")), True).over(before)).select("file", "start", "is_open", "owner")


def _cutter(sent):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of each range; those that cross a range's edge in pieces, with the range they started in."""
        out: list[tuple] = []
        size = 0
        key, lines, owner, is_open, first = None, [], None, False, False

        def batch():
            names = [("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("first", pa.bool_()), ("text", pa.string())]
            cols = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, names)], names=[n for n, _ in names])

        for file, start, line in _runs(batches):
            if (file, start) != key:
                if lines:           # still open at the edge
                    out.append((*key[:1], owner, key[1], first, "\n".join(lines)))
                key, lines = (file, start), []
                owner = sent.value.get(key)
                is_open, first = owner is not None, False
                fresh = start == 0
            if not is_open:
                owner, first, fresh = start, fresh, False
            headless = owner != start       # the piece of a record of an earlier range
            lines.append(line)
            size += len(line)
            if '"' in line:
                is_open = open_after(line, is_open)
            if not is_open:
                text = "\n".join(lines)
                out.append((file, owner if headless else None, start, first, text))
                lines, first = [], False
            if size > BATCH_CHARS:
                yield batch()
                out.clear()
                size = 0
        if lines:
            out.append((*key[:1], owner, key[1], first, "\n".join(lines)))
        yield batch()
    return cut


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, first (the file's first record), text: the CSV records of all files, whole."""
    conf, name = spark.conf, "spark.sql.files.minPartitionNum"
    before = conf.get(name, None)
    if before is None:      # both scans cut the files alike, also if executors come or go between them
        conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        maps = _lines(spark, path).mapInArrow(_range_maps, "file string, start long, end0 boolean, end1 boolean, has0 boolean, has1 boolean")
        opened = range_states(maps).where("is_open").limit(OPEN_RANGES + 1).collect()
        if len(opened) > OPEN_RANGES:
            raise ValueError(f"over {OPEN_RANGES} byte ranges start within a quoted field: raise spark.sql.files.maxPartitionBytes")
        sent = spark.sparkContext.broadcast({(r.file, r.start): r.owner for r in opened})
        pieces = _lines(spark, path).mapInArrow(_cutter(sent), "file string, owner long, start long, first boolean, text string")
        store = work_dir(spark, f"csv-records-{uuid.uuid4().hex[:10]}")
        pieces.write.parquet(store)
    finally:
        if before is None:
            conf.unset(name)
    pieces = spark.read.parquet(store)
    whole = pieces.where("owner is null").select("file", "first", "text")
    joined = (pieces.where("owner is not null").groupBy("file", "owner")
              .agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
              .select("file", "first", F.array_join(F.col("p.text"), "\n").alias("text")))
    records = whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r\\z", ""))
    return records.where(F.col("first") | (F.col("text") != ""))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Quoted line breaks and doubled quotes are kept within their field, and files are read
    by many tasks all the same.  Each file's first record is its header.  Files without line
    breaks in fields may be read with ``multi_line=False``, which spares the stored records
    and splits a field with a break."""
    plain = (spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"'))
    raw = plain.option("multiLine", multi_line).csv(path)      # of several lines a field: for the header only
    names = raw.columns
    if multi_line and names:
        ddl = ", ".join(f"_{i} string" for i in range(len(names)))
        parsed = read_records(spark, path).where(~F.col("first")).select(
            F.from_csv("text", ddl, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("r"))
        raw = parsed.select("r.*")
    trimmed = [c.strip() for c in names]
    s = raw.toDF(*trimmed)
    s = s.select(*[F.when(F.col(f"`{c}`").isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in trimmed])
    types = infer_types(s)
    cols = []
    for c in trimmed:
        t, x = types[c], F.col(f"`{c}`")
        if t == "boolean":
            cols.append(F.lower(x).isin("true").alias(c))
        elif t == "string":
            cols.append(x)
        else:
            cols.append(x.try_cast(t).alias(c))
    return s.select(*cols)
