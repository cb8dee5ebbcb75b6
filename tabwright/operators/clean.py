"""Cleaning (C1-C8): infinities, duplicates, null targets, sparse columns,
IQR clipping, median / mode fill, and the cleaning report.

Order is part of the semantics: C1 -> C2 -> C3 -> C4 -> per column (C5 -> C6)
-> C7.  The clip bounds come from the quartiles and the numeric fill value is
the median of the *unclipped* non-null values.

Spark shape: the de-duplicated rows are persisted once (the only shuffle is a
group-by over the whole row with a copy count - partially aggregated map-side,
so a row repeated for a third of the table collapses before the exchange, and
the input row count falls out of the same pass); then three small
aggregates (null counts; quantiles; modes) are collected as statistics rows
and the cleaned table is one projection.  No per-column jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import DEFAULT, Options
from .stats import column_modes, column_quantiles, split_roles

INF = float("inf")


def replace_inf(df: DataFrame) -> DataFrame:
    """+-Inf and NaN -> NULL on floating columns."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c) | c.isin(INF, -INF), F.lit(None)).otherwise(c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows (null == null, -0.0 == 0.0) removed."""
    return df.dropDuplicates()


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """C3."""
    return df.where(F.col(target).isNotNull()) if target in df.columns else df


@dataclass
class CleanPlan:
    """Fitted cleaning parameters (small, held on the driver)."""
    target: str
    dropped: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float] | None] = field(default_factory=dict)
    quartiles: dict[str, tuple[float, float] | None] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    missing_ratio: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class CleanResult:
    data: DataFrame
    report: DataFrame
    plan: CleanPlan
    kept: DataFrame = None      # the persisted de-duplicated rows (unpersist when done)


def _fill_expr(df: DataFrame, plan: CleanPlan) -> list:
    cols = []
    for f in df.schema.fields:
        name, c = f.name, F.col(f.name)
        if name in plan.numeric:
            x = c.cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else c.cast("double")
            b = plan.bounds.get(name)
            if b is not None:
                x = F.least(F.greatest(x, F.lit(b[0])), F.lit(b[1]))
            cols.append(F.coalesce(x, F.lit(float(plan.medians.get(name, 0.0)))).alias(name))
        elif name in plan.categorical:
            m = plan.modes.get(name)
            if m is None:
                cols.append(F.coalesce(c.cast("string"), F.lit("Unknown")).alias(name))
            else:
                cols.append(F.coalesce(c, F.lit(m).cast(f.dataType)).alias(name))
        else:
            cols.append(c)
    return cols


def clean(df: DataFrame, target: str, options: Options = DEFAULT, persist: bool = True,
          materialize: str = "persist", keys: list[str] | None = None) -> CleanResult:
    """``keys`` (row identifiers) pass through unchanged: never clipped, filled or dropped.

    ``materialize="checkpoint"`` writes the de-duplicated rows to the shared
    ``spark.checkpoint.dir`` (survives executor loss without recomputing the
    shuffle); the default persists them (MEMORY_AND_DISK)."""
    spark = df.sparkSession
    c1 = replace_inf(df)
    # C2 as one group-by over the whole row that also keeps the copy count, so the
    # input row count comes from the same (map-side combined) shuffle - one scan
    grouped = c1.groupBy(*c1.columns).agg(F.count(F.lit(1)).alias("_copies"))
    if persist and materialize == "checkpoint":
        grouped = grouped.checkpoint(eager=True)
    elif persist:
        grouped = grouped.persist(StorageLevel.MEMORY_AND_DISK)
    dedup = grouped.drop("_copies")
    has_t = target in df.columns
    t_ok = F.col(target).isNotNull() if has_t else F.lit(True)

    # statistics row 1: rows before/after dedup, null target rows, null counts over kept rows
    aggs = [F.coalesce(F.sum("_copies"), F.lit(0)).alias("_initial"), F.count(F.lit(1)).alias("_dedup"),
            F.count(F.when(t_ok, 1)).alias("_kept")]
    aggs += [F.count(F.when(t_ok & F.col(c).isNull(), 1)).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    row = grouped.agg(*aggs).collect()[0]
    initial_rows, n_dedup, n_kept = row["_initial"], row["_dedup"], row["_kept"]
    nulls = {c: row[f"_n{i}"] for i, c in enumerate(df.columns)}

    kept = drop_null_target(dedup, target)
    plan = CleanPlan(target=target)
    plan.counts = {"initial_rows": initial_rows, "initial_columns": len(df.columns),
                   "duplicates_removed": initial_rows - n_dedup, "target_rows_removed": n_dedup - n_kept,
                   "final_rows": n_kept}
    plan.missing_ratio = {c: (nulls[c] / n_kept if n_kept else float("nan")) for c in df.columns}
    # C4: pandas .mean() of an empty column is NaN and NaN > x is False -> nothing dropped
    keys = set(keys or ())
    plan.dropped = [c for c in df.columns if c != target and c not in keys and n_kept and nulls[c] / n_kept > options.missing_column_threshold]
    kept = kept.drop(*plan.dropped)
    plan.numeric, plan.categorical = ([c for c in cols if c not in keys] for cols in split_roles(kept, target, include_nested=True))
    plan.counts["final_columns"] = len(kept.columns)

    # statistics rows 2/3: quartiles + median of every numeric column, mode of every categorical
    q = column_quantiles(kept, plan.numeric, [0.25, 0.5, 0.75], exact=options.exact,
                         accuracy=options.quantile_accuracy).collect()
    qv = {(r["column_name"], r["prob"]): r["value"] for r in q}
    k = options.outlier_clip_iqr
    for c in plan.numeric:
        if (c, 0.25) in qv:
            q1, med, q3 = qv[(c, 0.25)], qv[(c, 0.5)], qv[(c, 0.75)]
            iqr = q3 - q1
            plan.quartiles[c] = (q1, q3)
            plan.bounds[c] = (q1 - k * iqr, q3 + k * iqr)
            plan.medians[c] = float(med)
        else:  # all null -> no clipping, fill 0.0
            plan.bounds[c] = None
            plan.medians[c] = 0.0
    modes = {r["column_name"]: r["mode"] for r in column_modes(kept, plan.categorical).collect()}
    plan.modes = {c: modes.get(c) for c in plan.categorical}

    data = kept.select(*_fill_expr(kept, plan))
    report = cleaning_report(kept, data, plan, nulls)
    return CleanResult(data=data, report=report, plan=plan, kept=grouped)


def cleaning_report(kept: DataFrame, cleaned: DataFrame, plan: CleanPlan, nulls: dict) -> DataFrame:
    """Long table (column_name, metric, value bigint); table metrics under '*'.

    Per-column ``outliers_clipped`` and ``missing_after`` come from one
    aggregate over the kept rows (never one job per column).
    """
    spark = kept.sparkSession
    aggs = []
    for i, c in enumerate(plan.numeric):
        b = plan.bounds.get(c)
        x = F.col(c).cast("double")
        cond = (x < F.lit(b[0])) | (x > F.lit(b[1])) if b is not None else F.lit(False)
        aggs.append(F.count(F.when(x.isNotNull() & cond, 1)).alias(f"clip_{i}"))
    fill_cols = {c: e for c, e in zip(kept.columns, _fill_expr(kept, plan))}
    for i, c in enumerate(kept.columns):
        aggs.append(F.count(F.when(fill_cols[c].isNull(), 1)).alias(f"after_{i}"))
    row = kept.agg(*aggs).collect()[0]
    rows = [("*", k, int(v)) for k, v in plan.counts.items()]
    for i, c in enumerate(plan.numeric):
        rows.append((c, "outliers_clipped", int(row[f"clip_{i}"])))
        rows.append((c, "missing_values_filled", int(nulls[c])))
    for c in plan.categorical:
        rows.append((c, "missing_values_filled", int(nulls[c])))
    for c in plan.dropped:
        rows.append((c, "column_dropped", 1))
    for i, c in enumerate(kept.columns):
        rows.append((c, "missing_values_after_cleaning", int(row[f"after_{i}"])))
    return spark.createDataFrame(rows, "column_name string, metric string, value long")
