"""Dataset understanding (B1-B17) as a catalog job over any number of tables.

Inputs are a *catalog* (one row per column of every table, built from the
schemas - metadata only), null and constant counts (one partial aggregate per
table), target value counts and row digests.  Every
rule of the reference (target hints, task type, PII / sensitive names,
domain and industry, quality and risk scores, specialist tags) is then a
column expression or a small aggregate over those two tables, so profiling
a whole lake is one Spark job, not one pass per column or per table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions.hashing import field_text
from ..options import DEFAULT, Options
from .stats import column_stats, type_family

#: Types whose values fit 64 bits.
SHORT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
CATALOG_SCHEMA = "table_name string, ordinal int, column_name string, family string"


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, i + 1, f.name, type_family(f.dataType))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    cat = spark.createDataFrame(rows, CATALOG_SCHEMA)
    return cat.withColumn("norm_name", N.normalise(F.col("column_name")))


def _canonical(df: DataFrame, name: str):
    """A value that is equal exactly when Spark's grouping equality holds
    (-0.0 folds into 0.0, NaN is one value, nested values as JSON)."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")
    if isinstance(dt, T.BinaryType):
        return F.base64(c)
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def value_digest(df: DataFrame, name: str) -> list:
    """Two longs that tell a column's values apart (null: null) as Spark's grouping does.

    A value of at most 64 bits has a 64-bit hash of its own (xxhash64 maps those one to
    one); any other is known by 128 bits of three hashes of its canonical text."""
    c, dt = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dt, SHORT_TYPES):
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            c = c.cast("double") + F.lit(0.0)
        return [F.when(c.isNotNull(), F.xxhash64(c)), F.lit(0).cast("long")]
    text = _canonical(df, name)
    other = F.shiftleft(F.hash(text).cast("long"), 32).bitwiseXOR(F.crc32(text.cast("binary")))
    return [F.when(text.isNotNull(), F.xxhash64(text)), other]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_stats(tables: dict[str, DataFrame], constant: bool = True) -> DataFrame:
    """(table_name, column_name, n_rows, n_null, constant): one partial aggregate per table.

    ``constant``: at most one distinct value (nulls aside), as minimum = maximum; left out if not wanted.
    No value is shuffled, only a row of counts per task."""
    parts = []
    for t, df in tables.items():
        aggs, entries = [F.count(F.lit(1)).alias("_rows")], []
        for i, f in enumerate(df.schema.fields):
            c = F.col(f"`{f.name}`")
            aggs.append(F.count(c).alias(f"_c{i}"))
            entry = [F.lit(f.name).alias("column_name"), (F.col("_rows") - F.col(f"_c{i}")).alias("n_null")]
            if constant:
                same = _canonical(df, f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c
                aggs.append(F.coalesce(F.min(same) == F.max(same), F.lit(True)).alias(f"_k{i}"))
                entry.append(F.col(f"_k{i}").alias("constant"))
            entries.append(F.struct(*entry))
        parts.append(df.agg(*aggs).select(F.lit(t).alias("table_name"), F.col("_rows").alias("n_rows"), F.explode(F.array(*entries)).alias("e"))
                     .select("table_name", "e.column_name", "n_rows", "e.n_null", *(["e.constant"] if constant else [])))
    return _union(parts)


def distinct_stats(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, column_name, n_distinct), exact up to 128-bit digests, of all or of the named columns.

    A value travels as (column number, 16 bytes), once per task and value; the
    second aggregate counts.  Digests are taken before a row is unfolded, so that
    no text is copied."""
    names, long = [], []
    for t, df in tables.items():
        wanted = df.columns if columns is None else columns.get(t, [])
        if not wanted:
            continue
        entries = []
        for c in wanted:
            h1, h2 = value_digest(df, c)
            entries.append(F.struct(F.lit(len(names)).alias("col"), h1.alias("h1"), h2.alias("h2")))
            names.append((len(names), t, c))
        long.append(df.select(F.explode(F.array(*entries)).alias("e")).where("e.h1 IS NOT NULL").select("e.*"))
    spark = next(iter(tables.values())).sparkSession
    known = spark.createDataFrame(names, "col int, table_name string, column_name string")   # one row per column
    counts = _union(long).groupBy("col", "h1", "h2").agg(F.lit(1).alias("one")).groupBy("col").agg(F.count(F.lit(1)).alias("n_distinct"))
    return known.join(counts, "col", "left").select("table_name", "column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def lake_stats(tables: dict[str, DataFrame], exact: bool = True, moments: bool = False) -> DataFrame:
    """(table_name, column_name, metric, value) for all tables: rows, n_null, n_distinct."""
    if not exact or moments:
        return _union([column_stats(df, table=t, exact=exact, moments=moments) for t, df in tables.items()])
    w = stats_wide(tables)
    cols = w.select("table_name", "column_name", F.explode(F.array(
        F.struct(F.lit("n_null").alias("metric"), F.col("n_null").cast("double").alias("value")),
        F.struct(F.lit("n_distinct").alias("metric"), F.col("n_distinct").cast("double").alias("value")))).alias("m"))
    rows = w.groupBy("table_name").agg(F.max("n_rows").cast("double").alias("value"))
    return cols.select("table_name", "column_name", "m.metric", "m.value").unionByName(
        rows.select("table_name", F.lit("*").alias("column_name"), F.lit("rows").alias("metric"), "value"))


def stats_wide(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, n_rows, n_null, n_distinct)."""
    return null_stats(tables, constant=False).join(distinct_stats(tables), ["table_name", "column_name"])


# ---------------------------------------------------------------- B2, B1
def infer_target(catalog: DataFrame) -> DataFrame:
    """B2 -> (table_name, target).

    pass 1: a hint equal to a normalised name, first hint wins; among columns
    normalising alike the later one wins.  pass 2: first column equal to or
    ending in ``_<hint>``.  pass 3: last column.
    """
    spark = catalog.sparkSession
    hints = spark.createDataFrame([(h, i) for i, h in enumerate(N.TARGET_HINTS)], "hint string, hint_rank int")
    c = catalog.alias("c")
    p1 = c.join(F.broadcast(hints), F.col("c.norm_name") == F.col("hint")) \
        .select("table_name", "column_name", F.lit(1).alias("pass"), F.col("hint_rank").alias("k1"),
                (-F.col("ordinal")).alias("k2"))
    suffix = c.join(F.broadcast(hints), (F.col("c.norm_name") == F.col("hint")) |
                    F.col("c.norm_name").endswith(F.concat(F.lit("_"), F.col("hint")))) \
        .select("table_name", "column_name", F.lit(2).alias("pass"), F.col("ordinal").alias("k1"), F.lit(0).alias("k2"))
    last = c.select("table_name", "column_name", F.lit(3).alias("pass"), (-F.col("ordinal")).alias("k1"), F.lit(0).alias("k2"))
    cand = p1.unionByName(suffix).unionByName(last)
    # one row per column of the catalog at most x3: a min(struct) per table, no window
    best = cand.groupBy("table_name").agg(F.min(F.struct("pass", "k1", "k2", "column_name")).alias("b"))
    return best.select("table_name", F.col("b.column_name").alias("target"))


def column_roles(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """B1 -> (table_name, ordinal, column_name, family, role)."""
    c = catalog.join(targets, "table_name")
    role = (F.when(F.col("column_name") == F.col("target"), "target")
            .when(F.col("family").isin("integer", "float", "boolean"), "numeric")
            .otherwise("categorical"))
    return c.select("table_name", "ordinal", "column_name", "family", role.alias("role"))


# ---------------------------------------------------------------- B3, B13
def task_type_expr(family, n_nonnull, n_distinct, max_distinct: int = 20):
    return (F.when(n_nonnull == 0, "classification")
            .when(family.isin("boolean", "string", "temporal", "nested"), "classification")
            .when((n_distinct <= max_distinct) & (family == "integer"), "classification")
            .when(n_distinct <= F.greatest(F.lit(10), F.floor(n_nonnull * 0.1)), "classification")
            .when(family == "float", "regression")
            .when(n_distinct <= 2, "classification")
            .otherwise("regression"))


def target_profile(catalog: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_name, target, family, n_rows, n_null, n_distinct, task_type, problem_type).

    Only the target columns are read, by their value counts."""
    w = counts.groupBy("table_name").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
                                         F.count("value").alias("n_distinct"))
    t = targets.join(catalog.select("table_name", F.col("column_name").alias("target"), "family"), ["table_name", "target"]).join(w, "table_name")
    nn = F.col("n_rows") - F.col("n_null")
    return t.select("table_name", "target", "family", "n_rows", "n_null", "n_distinct",
                    task_type_expr(F.col("family"), nn, F.col("n_distinct"), DEFAULT.classification_max_distinct).alias("task_type"),
                    F.when(F.col("n_distinct") <= DEFAULT.classification_max_distinct, "classification")
                    .otherwise("regression").alias("problem_type"))


# ---------------------------------------------------------------- B6
def target_counts(tables: dict[str, DataFrame], targets: dict[str, str]) -> DataFrame:
    """(table_name, value string, n): value counts of each table's target, nulls included."""
    parts = [df.groupBy(_canonical(df, targets[t]).alias("value")).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(t).alias("table_name"), "value", "n") for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topk_per_group(df: DataFrame, group: list[str], order: list, k: int, buckets: int = 64,
                   bucket_key: str | None = None) -> DataFrame:
    """Top-k rows per group without ranking a whole group in one task.

    Level 1 keeps the top k inside (group, hash-bucket) partitions; level 2
    ranks at most k*buckets survivors per group.  ``order`` must be a total
    order (include a unique tie-breaker).
    """
    key = bucket_key or df.columns[-1]
    b = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))
    w1 = Window.partitionBy(*group, b).orderBy(*order)
    lvl1 = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return lvl1.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


def target_topk(counts: DataFrame, k: int = 10) -> DataFrame:
    """(table_name, value, n, rank) - count desc, value asc (nulls last)."""
    return topk_per_group(counts, ["table_name"], [F.desc("n"), F.asc_nulls_last("value")], k, bucket_key="value")


def target_moments(tables: dict[str, DataFrame], targets: dict[str, str]) -> DataFrame:
    """B6 regression branch: mean and sample std of each numeric target."""
    parts = []
    for t, df in tables.items():
        c = F.col(targets[t])
        fam = type_family(df.schema[targets[t]].dataType)
        x = c.cast("double") if fam in ("integer", "float", "boolean") else F.lit(None).cast("double")
        parts.append(df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
                     .select(F.lit(t).alias("table_name"), "mean", "std"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- B7
def duplicate_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_duplicates); first occurrences not counted.

    One aggregate for all tables over a 256-bit digest of each row (fields
    null-marked and length-marked): a row repeated a billion times is one row per
    task before the shuffle, and 32 bytes of it travel."""
    parts = []
    for t, df in tables.items():
        fields = [field_text(_canonical(df, c)) for c in df.columns]
        parts.append(df.select(F.lit(t).alias("table_name"), F.unhex(F.sha2(F.concat(*fields), 256)).alias("d")))
    rows = _union(parts).groupBy("table_name", "d").agg(F.count(F.lit(1)).alias("n"))
    found = rows.groupBy("table_name").agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count(F.lit(1))).alias("n_duplicates"))
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(t,) for t in tables], "table_name string")
    return names.join(found, "table_name", "left").select("table_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_duplicates")])


# ---------------------------------------------------------------- B8-B11
def name_flags(catalog: DataFrame) -> DataFrame:
    n = F.col("norm_name")
    return catalog.select(
        "table_name", "ordinal", "column_name",
        N.contains_any(n, N.PROFILE_PII_HINTS).alias("pii"),
        N.contains_any(n, N.PROFILE_SENSITIVE_HINTS).alias("sensitive"),
        N.contains_any(n, N.RISK_PII_HINTS).alias("risk_pii"),
        N.contains_any(n, N.RISK_SENSITIVE_HINTS).alias("risk_sensitive"),
        ((n == "id") | n.endswith("_id")).alias("id_like"))


def duplicate_patterns(catalog: DataFrame, dups: DataFrame) -> DataFrame:
    """(table_name, id_columns, duplicate_patterns), one row per table with all its labels."""
    flags = name_flags(catalog).where("id_like")
    ids = flags.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))),
                                                                   lambda s: s["column_name"]), ",").alias("id_columns"))
    labels = F.array_join(F.array_compact(F.array(
        F.when(F.col("n_duplicates") > 0, F.lit("Exact duplicate rows detected")),
        F.when(F.col("id_columns").isNotNull(), F.lit("Identifier-like columns present")))), "; ")
    return dups.join(ids, "table_name", "left").select("table_name", F.coalesce("id_columns", F.lit("")).alias("id_columns"), labels.alias("duplicate_patterns"))


# ---------------------------------------------------------------- B12
def _first_rule(text, rules, default):
    expr = None
    for label, tokens in rules:
        cond = N.contains_any(text, tokens)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def domain_tags(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """(table_name, business_domain, industry) from the joined lower-case feature names."""
    c = catalog.join(targets, "table_name").where(F.col("column_name") != F.col("target"))
    joined = c.groupBy("table_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.lower("column_name").alias("n")))),
                                 lambda s: s["n"]), " ").alias("names"))
    joined = joined.select("table_name", F.coalesce("names", F.lit("")).alias("names"))
    domain = _first_rule(F.col("names"), N.DOMAIN_RULES, N.DOMAIN_DEFAULT)
    ind = None
    for d, label in N.INDUSTRY_BY_DOMAIN:
        ind = F.when(F.col("business_domain") == d, label) if ind is None else ind.when(F.col("business_domain") == d, label)
    for label, tokens in N.INDUSTRY_TOKEN_RULES:
        ind = ind.when(N.contains_any(F.col("names"), tokens), label)
    ind = ind.otherwise(N.INDUSTRY_DEFAULT)
    return joined.select("table_name", domain.alias("business_domain"), "names").select(
        "table_name", "business_domain", ind.alias("industry"))


# ---------------------------------------------------------------- B14-B17
def table_profile(catalog: DataFrame, nulls: DataFrame, targets: DataFrame, dups: DataFrame,
                  counts: DataFrame, topk: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """One row per table: counts, quality score (B15), risk (B16) and tags."""
    w = nulls
    flags = name_flags(catalog).join(targets, "table_name")
    cols = catalog.join(w, ["table_name", "column_name"]).join(targets, "table_name")
    per_table = cols.groupBy("table_name").agg(
        F.first("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_columns"),
        F.sum("n_null").alias("n_missing"),
        F.count(F.when(F.col("constant"), 1)).alias("n_constant"),
        F.count(F.when((F.col("n_null") / F.greatest(F.col("n_rows"), F.lit(1))) > options.missing_flag_ratio, 1)).alias("n_missing_flag"),
        F.count(F.when(F.col("column_name") != F.col("target"), 1)).alias("feature_count"))
    nf = flags.groupBy("table_name").agg(
        F.count(F.when(F.col("pii"), 1)).alias("n_pii"),
        F.count(F.when(F.col("sensitive"), 1)).alias("n_sensitive"),
        F.count(F.when(F.col("risk_pii"), 1)).alias("n_risk_pii"),
        F.count(F.when(F.col("risk_sensitive"), 1)).alias("n_risk_sensitive"),
        F.max(F.col("id_like").cast("int")).alias("has_id"),
        F.count(F.when((F.col("column_name") != F.col("target")) &
                       N.contains_any(F.lower("column_name"), N.TAG_TIME_TOKENS), 1)).alias("n_time"),
        F.count(F.when((F.col("column_name") != F.col("target")) &
                       N.contains_any(F.lower("column_name"), N.TAG_TEXT_TOKENS), 1)).alias("n_text"),
        F.count(F.when((F.col("column_name") != F.col("target")) &
                       N.contains_any(F.lower("column_name"), N.TAG_RECOMMENDER_TOKENS), 1)).alias("n_rec"))
    imb = topk.groupBy("table_name").agg((F.min("n") / F.greatest(F.sum("n"), F.lit(1))).alias("top10_min_share"))
    tp = target_profile(catalog, counts, targets).select("table_name", "task_type", "problem_type")
    t = per_table.join(nf, "table_name").join(dups, ["table_name", "n_rows"]).join(tp, "table_name") \
        .join(imb, "table_name", "left")

    cells = F.greatest(F.col("n_rows") * F.col("n_columns"), F.lit(1))
    missing_ratio = F.col("n_missing") / cells
    dup_ratio = F.col("n_duplicates") / F.greatest(F.col("n_rows"), F.lit(1))
    quality = F.floor(F.least(F.greatest(
        100 - missing_ratio * 55 - dup_ratio * 35 - F.col("n_constant") * 3 - F.col("n_pii") * 4, F.lit(0.0)), F.lit(100.0)))
    is_cls = F.col("task_type") == "classification"
    imbalanced = is_cls & F.col("top10_min_share").isNotNull() & (F.col("top10_min_share") < 0.2)
    penalty = (F.when(missing_ratio > 0.1, 15).otherwise(0) + F.when(imbalanced, 12).otherwise(0)
               + F.when(F.col("feature_count") > 40, 8).otherwise(0)
               + F.when(F.col("n_risk_pii") > 0, 20).otherwise(0) + F.when(F.col("n_risk_sensitive") > 0, 8).otherwise(0))
    risk_quality = F.greatest(F.lit(0.0), 100.0 - missing_ratio * 100.0 * 0.8 - F.col("n_risk_pii") * 8 - F.col("n_risk_sensitive") * 3)
    t = t.select("*", missing_ratio.alias("missing_ratio"), quality.cast("int").alias("quality_score"),
                 imbalanced.alias("imbalanced"), penalty.cast("double").alias("_pen"), risk_quality.alias("_rq"))
    risk = F.least(F.lit(100.0), F.col("_pen") + (100.0 - F.col("_rq")) * 0.5)
    t = t.select("*", F.round(risk, 2).alias("risk_score"), F.round("_rq", 2).alias("risk_quality"))
    share = F.coalesce(F.col("top10_min_share"), F.lit(1.0))
    tags = F.array_compact(F.array(
        F.when(F.col("n_time") > 0, F.lit("time_series")),
        F.when(F.col("n_text") > 0, F.lit("text")),
        F.when(is_cls & (share < 0.2) & (F.col("risk_score") >= 35), F.lit("fraud")),
        F.when(F.col("n_rec") >= 2, F.lit("recommender")),
        F.when(is_cls & (F.col("risk_score") >= 50), F.lit("anomaly"))))
    tags = F.when(F.size(tags) == 0, F.array(F.lit("generalist"))).otherwise(tags)
    findings = F.array_compact(F.array(
        F.when(missing_ratio > 0.1, F.lit("missing_data")),
        F.when(imbalanced, F.lit("class_imbalance")),
        F.when(F.col("feature_count") > 40, F.lit("many_features")),
        F.when(F.col("n_risk_pii") > 0, F.lit("pii")),
        F.when(F.col("n_risk_sensitive") > 0, F.lit("sensitive"))))
    return t.select("*", tags.alias("tags"), findings.alias("findings")).drop("_pen", "_rq")


class LakeProfile:
    """The profile of a dict of tables.  Parts are computed when first asked for, so a
    question about targets reads target columns only.  Kept parts are a few rows per
    column (``counts``: per target value); ``release`` lets go of them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], options: Options = DEFAULT):
        self.spark, self.tables, self.options, self._kept = spark, tables, options, []
        self.catalog = catalog_of(spark, tables)

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    @cached_property
    def targets(self) -> DataFrame:
        return self._keep(infer_target(self.catalog))

    @cached_property
    def target_map(self) -> dict[str, str]:
        return {r["table_name"]: r["target"] for r in self.targets.collect()}   # one name per table

    @cached_property
    def nulls(self) -> DataFrame:
        return self._keep(null_stats(self.tables))

    @cached_property
    def counts(self) -> DataFrame:
        return self._keep(target_counts(self.tables, self.target_map))

    @cached_property
    def topk(self) -> DataFrame:
        return target_topk(self.counts)

    @cached_property
    def dups(self) -> DataFrame:
        return self._keep(duplicate_counts(self.tables))

    def target_profile(self) -> DataFrame:
        return target_profile(self.catalog, self.counts, self.targets)

    def table_profile(self) -> DataFrame:
        return table_profile(self.catalog, self.nulls, self.targets, self.dups, self.counts, self.topk, self.options)

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()


def profile_lake(spark: SparkSession, tables: dict[str, DataFrame], options: Options = DEFAULT) -> LakeProfile:
    return LakeProfile(spark, tables, options)
