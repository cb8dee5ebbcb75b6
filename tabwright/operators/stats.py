"""Column roles and the one-pass column-statistics aggregate.

Every per-column loop of the reference becomes ONE ``agg`` over all columns
(partial aggregation on each task, a single small merge) followed by an
unpivot into the long table ``(table_name, column_name, metric, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import mode_long, quantiles_long, rank_quantiles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType, T.BooleanType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def type_family(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, INTEGER_TYPES):
        return "integer"
    if isinstance(dt, FLOAT_TYPES):
        return "float"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "nested"


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def split_roles(df: DataFrame, target: str | None = None, include_nested: bool = False):
    """(numeric, categorical) feature columns in table order, target excluded."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if is_numeric(f.dataType):
            num.append(f.name)
        elif include_nested or not isinstance(f.dataType, NESTED_TYPES):
            cat.append(f.name)
    return num, cat


def as_double(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.BooleanType):
        c = c.cast("int")
    return c.cast("double")


def _explode_long(row: DataFrame, entries: list[tuple[str, str, str]], table: str | None) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric"),
                             F.col(a).cast("double").alias("value")) for c, m, a in entries])
    out = row.select(F.explode(arr).alias("_e")).select("_e.*")
    if table is not None:
        out = out.select(F.lit(table).alias("table_name"), "*")
    return out


def column_stats(df: DataFrame, table: str | None = None, exact: bool = True,
                 distinct: bool = True, moments: bool = True) -> DataFrame:
    """Long statistics table for every column of ``df`` in one aggregate.

    metrics: ``rows`` (column_name '*'), ``n_null``, ``n_distinct`` (nulls
    ignored; exact or HyperLogLog++), and for numeric columns ``mean``,
    ``std`` (sample), ``min``, ``max``.
    """
    aggs, entries = [F.count(F.lit(1)).alias("_rows")], [("*", "rows", "_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        aggs.append(F.count(F.when(c.isNull(), 1)).alias(f"_n{i}"))
        entries.append((f.name, "n_null", f"_n{i}"))
        if distinct and not isinstance(f.dataType, (T.MapType,)):
            aggs.append((F.countDistinct(c) if exact else F.approx_count_distinct(c)).alias(f"_d{i}"))
            entries.append((f.name, "n_distinct", f"_d{i}"))
        if moments and is_numeric(f.dataType):
            x = as_double(df, f.name)
            aggs += [F.avg(x).alias(f"_a{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                     F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
            entries += [(f.name, "mean", f"_a{i}"), (f.name, "std", f"_s{i}"),
                        (f.name, "min", f"_lo{i}"), (f.name, "max", f"_hi{i}")]
    return _explode_long(df.agg(*aggs), entries, table)


def to_long(df: DataFrame, columns: list[str], value_type: str = "double", keys: list[str] | None = None) -> DataFrame:
    """(keys..., column_name, value) rows for the given columns (nulls kept)."""
    keys = keys or []
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(value_type).alias("value")) for c in columns])
    return df.select(*keys, F.explode(arr).alias("_e")).select(*keys, "_e.column_name", "_e.value")


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], exact: bool = True,
                     accuracy: int = 100_000) -> DataFrame:
    """(column_name, prob, value) for numeric columns (nulls ignored)."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, prob double, value double")
    if exact:
        got = rank_quantiles(df, [as_double(df, c) for c in columns], probs, accuracy)
        rows = [(c, float(p), v) for c, row in zip(columns, got) for p, v in zip(probs, row) if v is not None]
        return df.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")
    long = to_long(df.select(*[as_double(df, c).alias(c) for c in columns]), columns)
    return quantiles_long(long, ["column_name"], "value", probs, exact=False, accuracy=accuracy)


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mode string, mode_count) - ties broken by smallest value."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, mode string, mode_count long")
    # categoricals are strings or temporals: their text form sorts like the values
    long = to_long(df, columns, value_type="string")
    return mode_long(long, ["column_name"], "value")
