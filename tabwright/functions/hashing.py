"""Deterministic hashing used for splits, folds, samples and fingerprints.

Everything is keyed by an explicit row key, never by row position or
partition layout, so results are identical after any repartition and equal
to the same SQL run in another engine:

    unit(key) = conv(substr(md5(cast(key as string) || '|' || seed), 1, 8), 16, 10)

is a uniform integer in [0, 2^32).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_SPACE = 1 << 32
FP_MODULUS = (1 << 61) - 1


def hash_unit(key: Column | str, seed: int) -> Column:
    """Uniform bigint in [0, 2^32) from md5(key|seed)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sql_hash_unit(key_sql: str, seed: int) -> str:
    """The same value in DuckDB SQL."""
    return f"CAST(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT)"


def _hex_float(c: Column) -> Column:
    """All bits of a double as text (hexadecimal float; -0.0 and 0.0 differ)."""
    return F.replace(F.format_string("%a", c.cast("double")), F.lit(".0p"), F.lit("p"))


def canonical_string(df: DataFrame, name: str) -> Column:
    """Engine-independent, lossless text form of one column (for content fingerprints)."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c.isNotNull(), _hex_float(c))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("string")
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.FloatType, T.DoubleType)):
        return F.array_join(F.transform(c, lambda x: F.when(x.isNotNull(), _hex_float(x)).otherwise("null")), ",")
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def field_text(text: Column) -> Column:
    """A field that cannot run into its neighbours: its length before it; ``n`` for null."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint of a table (one row).

    Each row hashes to 128 bits; the two 64-bit halves are summed over all rows
    modulo a Mersenne prime, so the fingerprint is an ordinary partial and
    final aggregate (no sort, no single task holding rows).
    """
    digest = F.md5(F.concat(*[field_text(canonical_string(df, c)) for c in df.columns]))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)")
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(half(1)).alias("_a"), F.sum(half(17)).alias("_b"))
    zero, prime = F.lit(0).cast("decimal(38,0)"), F.lit(FP_MODULUS).cast("decimal(38,0)")
    part = lambda c: F.pmod(F.coalesce(F.col(c), zero), prime).cast("bigint")
    return agg.select("n_rows", part("_a").alias("content_hash"), part("_b").alias("content_hash_2")).select(
        "*", F.substring(F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("content_hash").cast("string"),
                                            F.col("content_hash_2").cast("string")), 256), 1, 16).alias("dataset_signature"))
