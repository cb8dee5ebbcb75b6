"""Cleaning queries (C1-C8) on the dirty events fixture, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import clean, drop_duplicates, drop_null_target, replace_inf
from ..operators.stats import column_stats
from .fixtures import dirty_events
from .registry import query, r6

FLOATS = ["value", "sparse_col", "value_x2"]
ALL = ["event_id", "user_id", "event_type", "value", "sparse_col", "const_col", "value_x2", "target"]
NUMERIC = ["event_id", "user_id", "value", "const_col", "value_x2"]   # after sparse_col is dropped

DIRTY_CTE = """d AS (
  SELECT event_id, user_id,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 17 = 0 THEN NULL
         WHEN event_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE)
         ELSE value END AS value,
    CASE WHEN event_id % 40 = 0 THEN value END AS sparse_col,
    CAST(1 AS INT) AS const_col,
    value * 2 + 1 AS value_x2,
    CASE WHEN event_id % 29 = 0 THEN NULL
         ELSE CAST(value > 60 AS INT) END AS target
  FROM events),
dirty AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE event_id % 50 = 0)"""

C1_SELECT = "SELECT " + ", ".join(
    f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}" if c in FLOATS else c for c in ALL) + " FROM dirty"

KEPT_CTE = DIRTY_CTE + f""",
c1 AS ({C1_SELECT}),
dedup AS (SELECT DISTINCT * FROM c1),
kept AS (SELECT * FROM dedup WHERE target IS NOT NULL)"""

_qs = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS column_name, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, "
    f"count(*) - count({c}) AS n_null FROM kept" for c in NUMERIC)
_clips = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE CAST({c} AS DOUBLE) < b.lo OR CAST({c} AS DOUBLE) > b.hi) "
    f"AS n_clipped FROM kept, (SELECT lo, hi FROM b WHERE column_name = '{c}') b" for c in NUMERIC)
BOUNDS_CTE = KEPT_CTE + f""",
qs AS ({_qs}),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qs),
clips AS ({_clips}),
m AS (SELECT event_type AS mode FROM kept WHERE event_type IS NOT NULL
      GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)"""


def _dirty(spark, sf_dir):
    return dirty_events(spark, sf_dir)


@query("clean_inf", sql=f"WITH {DIRTY_CTE} {C1_SELECT}")
def q_clean_inf(spark, sf_dir):
    return replace_inf(_dirty(spark, sf_dir))


@query("clean_dedup", sql=f"WITH {DIRTY_CTE}, c1 AS ({C1_SELECT}) SELECT DISTINCT * FROM c1")
def q_clean_dedup(spark, sf_dir):
    return drop_duplicates(replace_inf(_dirty(spark, sf_dir)))


@query("clean_target", sql=f"WITH {KEPT_CTE} SELECT * FROM kept")
def q_clean_target(spark, sf_dir):
    return drop_null_target(drop_duplicates(replace_inf(_dirty(spark, sf_dir))), "target")


_unp = ", ".join(f"count(*) - count({c}) AS {c}" for c in ALL)


@query("clean_sparse_cols", sql=f"""WITH {KEPT_CTE},
n AS (SELECT count(*) AS n_rows, {_unp} FROM kept),
u AS (UNPIVOT n ON {', '.join(ALL)} INTO NAME column_name VALUE n_null)
SELECT column_name, round(CAST(n_null AS DOUBLE) / n_rows, 6) AS missing_ratio,
       (column_name <> 'target' AND CAST(n_null AS DOUBLE) / n_rows > 0.95) AS dropped
FROM u""")
def q_clean_sparse_cols(spark, sf_dir):
    kept = drop_null_target(drop_duplicates(replace_inf(_dirty(spark, sf_dir))), "target")
    st = column_stats(kept, distinct=False, moments=False)
    n = st.where(F.col("metric") == "rows").collect()[0]["value"]   # one scalar
    nn = st.where(F.col("metric") == "n_null")
    ratio = F.col("value") / F.lit(n)
    return nn.select("column_name", r6(ratio).alias("missing_ratio"),
                     ((F.col("column_name") != "target") & (ratio > 0.95)).alias("dropped"))


def _cleaned(spark, sf_dir):
    return clean(_dirty(spark, sf_dir), "target")


@query("clean_clip", sql=f"""WITH {BOUNDS_CTE}
SELECT b.column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower_bound,
       round(hi, 6) AS upper_bound, n_clipped
FROM b JOIN clips USING (column_name)""")
def q_clean_clip(spark, sf_dir):
    res = _cleaned(spark, sf_dir)
    p = res.plan
    clipped = res.report.where(F.col("metric") == "outliers_clipped").select("column_name", F.col("value").alias("n_clipped"))
    rows = [(c, p.quartiles[c][0], p.quartiles[c][1], p.bounds[c][0], p.bounds[c][1]) for c in p.numeric if p.bounds.get(c)]
    b = spark.createDataFrame(rows, "column_name string, q1 double, q3 double, lower_bound double, upper_bound double")
    return b.join(clipped, "column_name").select("column_name", *[r6(c).alias(c) for c in ("q1", "q3", "lower_bound", "upper_bound")], "n_clipped")


@query("clean_median", sql=f"""WITH {BOUNDS_CTE}
SELECT column_name, round(coalesce(med, 0.0), 6) AS fill_value, n_null AS n_filled FROM b""")
def q_clean_median(spark, sf_dir):
    res = _cleaned(spark, sf_dir)
    filled = res.report.where(F.col("metric") == "missing_values_filled")
    med = spark.createDataFrame([(c, float(v)) for c, v in res.plan.medians.items()], "column_name string, fill_value double")
    return med.join(filled.select("column_name", F.col("value").alias("n_filled")), "column_name") \
        .select("column_name", r6("fill_value").alias("fill_value"), "n_filled")


@query("clean_mode", sql=f"""WITH {BOUNDS_CTE}
SELECT 'event_type' AS column_name, coalesce((SELECT mode FROM m), 'Unknown') AS fill_value,
       (SELECT count(*) - count(event_type) FROM kept) AS n_filled""")
def q_clean_mode(spark, sf_dir):
    res = _cleaned(spark, sf_dir)
    filled = res.report.where(F.col("metric") == "missing_values_filled")
    modes = spark.createDataFrame([(c, v if v is not None else "Unknown") for c, v in res.plan.modes.items()],
                                  "column_name string, fill_value string")
    return modes.join(filled.select("column_name", F.col("value").alias("n_filled")), "column_name")


def _clean_cols(rounded: bool = True):
    cols = []
    for c in ["event_id", "user_id", "event_type", "value", "const_col", "value_x2", "target"]:
        if c in NUMERIC:
            e = (f"coalesce(least(greatest(CAST({c} AS DOUBLE), (SELECT lo FROM b WHERE column_name='{c}')), "
                 f"(SELECT hi FROM b WHERE column_name='{c}')), (SELECT med FROM b WHERE column_name='{c}'))")
            cols.append(f"round({e}, 6) AS {c}" if rounded else f"{e} AS {c}")
        elif c == "event_type":
            cols.append("coalesce(event_type, (SELECT mode FROM m)) AS event_type")
        else:
            cols.append(c)
    return ", ".join(cols)


def _clean_data_sql():
    return f"WITH {BOUNDS_CTE} SELECT {_clean_cols()} FROM kept"


CLEANED_CTE = BOUNDS_CTE + f""",
cleaned AS (SELECT {_clean_cols(rounded=False)} FROM kept)"""


@query("clean_data", sql=_clean_data_sql())
def q_clean_data(spark, sf_dir):
    res = _cleaned(spark, sf_dir)
    d = res.data
    return d.select(*[r6(c).alias(c) if c in res.plan.numeric else F.col(c) for c in d.columns])


def _report_sql():
    parts = [
        "SELECT '*' AS column_name, 'initial_rows' AS metric, (SELECT count(*) FROM dirty) AS value",
        "SELECT '*', 'initial_columns', 8",
        "SELECT '*', 'duplicates_removed', (SELECT count(*) FROM dirty) - (SELECT count(*) FROM dedup)",
        "SELECT '*', 'target_rows_removed', (SELECT count(*) FROM dedup) - (SELECT count(*) FROM kept)",
        "SELECT '*', 'final_rows', (SELECT count(*) FROM kept)",
        "SELECT '*', 'final_columns', 7",
        "SELECT column_name, 'outliers_clipped', n_clipped FROM clips",
        "SELECT column_name, 'missing_values_filled', n_null FROM b",
        "SELECT 'event_type', 'missing_values_filled', (SELECT count(*) - count(event_type) FROM kept)",
        "SELECT 'sparse_col', 'column_dropped', 1",
    ]
    parts += [f"SELECT '{c}', 'missing_values_after_cleaning', 0" for c in
              ["event_id", "user_id", "event_type", "value", "const_col", "value_x2", "target"]]
    body = "\n UNION ALL ".join(parts)
    return f"WITH {BOUNDS_CTE} SELECT column_name, metric, CAST(value AS BIGINT) AS value FROM ({body}) t"


@query("clean_report", sql=_report_sql())
def q_clean_report(spark, sf_dir):
    return _cleaned(spark, sf_dir).report
