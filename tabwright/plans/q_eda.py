"""EDA (D1-D7) and split / fold / sample / scoring (E1-E6) queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_unit
from ..operators import eda as D
from ..operators import profile as P
from ..operators import split as S
from ..operators.stats import split_roles
from ..options import DEFAULT
from ..sources.tables import read_table
from .fixtures import dirty_events
from .q_clean import DIRTY_CTE
from .q_profile import BASE, COUNTS, _profile, lake
from .registry import query, r6
from .schemas import SCHEMAS

LI_NUM = [c for c, f in SCHEMAS["lineitem"] if f in ("integer", "float")]
LI_CAT = [c for c, f in SCHEMAS["lineitem"] if f not in ("integer", "float")]


@query("eda_numeric", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, "
    f"round(min(CAST({c} AS DOUBLE)), 4) AS min, round(max(CAST({c} AS DOUBLE)), 4) AS max FROM lineitem" for c in LI_NUM))
def q_eda_numeric(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    num, _ = split_roles(li)
    return D.numeric_summary(li, num)


@query("eda_cardinality", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in LI_CAT))
def q_eda_cardinality(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    _, cat = split_roles(li)
    return D.cardinality(li, cat)


@query("eda_target_dist", sql=f"""WITH {DIRTY_CTE}, c AS (SELECT CAST(target AS VARCHAR) AS value, count(*) AS n FROM dirty GROUP BY 1)
SELECT value, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 4) AS share, n = max(n) OVER () AS is_majority FROM c""")
def q_eda_target_dist(spark, sf_dir):
    return D.target_distribution(dirty_events(spark, sf_dir), "target")


@query("eda_target_describe", sql="""SELECT stat, round(value, 4) AS value FROM (
  SELECT 'count' AS stat, CAST(count(p_retailprice) AS DOUBLE) AS value FROM part
  UNION ALL SELECT 'mean', avg(p_retailprice) FROM part
  UNION ALL SELECT 'std', stddev_samp(p_retailprice) FROM part
  UNION ALL SELECT 'min', min(p_retailprice) FROM part
  UNION ALL SELECT 'max', max(p_retailprice) FROM part
  UNION ALL SELECT '25%', quantile_cont(p_retailprice, 0.25) FROM part
  UNION ALL SELECT '50%', quantile_cont(p_retailprice, 0.5) FROM part
  UNION ALL SELECT '75%', quantile_cont(p_retailprice, 0.75) FROM part) t""")
def q_eda_target_describe(spark, sf_dir):
    return D.describe(read_table(spark, sf_dir, "part"), "p_retailprice")


def _corr_sql(table, cols):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{a}' AS col_a, '{b}' AS col_b, "
        f"round(CASE WHEN isnan(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) THEN NULL "
        f"ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END, 6) AS r FROM {table}"
        for a, b in combinations(cols, 2))


@query("corr_matrix", sql=f"SELECT col_a, col_b, r FROM ({_corr_sql('lineitem', LI_NUM)}) t")
def q_corr_matrix(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    num, _ = split_roles(li)
    return D.corr_long(li, num).select("col_a", "col_b", r6("r").alias("r"))


@query("eda_shape", sql=f"""WITH {BASE}
SELECT c.table_name, max(s.n_rows) AS n_rows, count(*) AS n_columns,
  count(*) FILTER (WHERE c.column_name <> t.target AND c.family IN ('integer', 'float', 'boolean')) AS n_numeric,
  count(*) FILTER (WHERE c.column_name <> t.target AND c.family NOT IN ('integer', 'float', 'boolean')) AS n_categorical,
  max(CASE WHEN c.column_name = t.target THEN s.n_distinct END) AS target_distinct
FROM cat c JOIN targets t USING (table_name) JOIN st s ON s.table_name = c.table_name AND s.column_name = c.column_name
GROUP BY c.table_name""")
def q_eda_shape(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    roles = P.column_roles(p.catalog, p.targets)
    shape = roles.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count(F.when(F.col("role") == "numeric", 1)).alias("n_numeric"),
        F.count(F.when(F.col("role") == "categorical", 1)).alias("n_categorical"))
    return shape.join(p.target_profile(), "table_name").select(
        "table_name", "n_rows", "n_columns", "n_numeric", "n_categorical", F.col("n_distinct").alias("target_distinct"))


FLAG_TABLES = tuple(SCHEMAS)


def _flags_sql():
    from .q_profile import _target_counts_sql  # noqa: F401
    corr_parts = []
    for t in FLAG_TABLES:
        cols = [c for c, f in SCHEMAS[t] if f in ("integer", "float")]
        for a, b in combinations(cols, 2):
            corr_parts.append(
                f"SELECT '{t}' AS table_name, '{a}' AS col_a, '{b}' AS col_b, "
                f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {t}")
    corrs = " UNION ALL ".join(corr_parts)
    tl = ", ".join(f"'{t}'" for t in FLAG_TABLES)
    return f"""WITH {COUNTS},
corrs AS ({corrs}),
cf AS (SELECT c.table_name, bool_or(abs(c.r) > 0.9 AND NOT isnan(c.r)) AS high_corr FROM corrs c JOIN targets t
       ON c.table_name = t.table_name AND c.col_a <> t.target AND c.col_b <> t.target GROUP BY c.table_name),
maj AS (SELECT table_name, max(n) / sum(n) AS majority_share FROM tcounts GROUP BY table_name)
SELECT tp.table_name, round(CASE WHEN tp.task_type = 'classification' THEN majority_share END, 4) AS majority_share,
  coalesce(tp.task_type = 'classification' AND majority_share > 0.75, false) AS imbalanced,
  coalesce(cf.high_corr, false) AS high_corr
FROM tp JOIN maj USING (table_name) LEFT JOIN cf USING (table_name) WHERE tp.table_name IN ({tl})"""


@query("eda_flags", sql=_flags_sql())
def q_eda_flags(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    tp = p.target_profile().where(F.col("table_name").isin(*FLAG_TABLES))
    maj = p.counts.groupBy("table_name").agg((F.max("n") / F.sum("n")).alias("majority_share"))
    parts = []
    for t in FLAG_TABLES:
        num, _ = split_roles(tables[t], p.target_map[t])
        c = D.corr_long(tables[t], num)
        parts.append(c.agg(F.max((F.abs("r") > DEFAULT.correlation_flag).cast("int")).alias("hc")).select(
            F.lit(t).alias("table_name"), F.coalesce(F.col("hc") == 1, F.lit(False)).alias("high_corr")))
    cf = parts[0]
    for x in parts[1:]:
        cf = cf.unionByName(x)
    is_cls = F.col("task_type") == "classification"
    return tp.join(maj, "table_name").join(cf, "table_name", "left").select(
        "table_name", F.round(F.when(is_cls, F.col("majority_share")), 4).alias("majority_share"),
        F.coalesce(is_cls & (F.col("majority_share") > DEFAULT.imbalance_majority), F.lit(False)).alias("imbalanced"),
        F.coalesce("high_corr", F.lit(False)).alias("high_corr"))


# ------------------------------------------------------------------ E
H_ORD = sql_hash_unit("o_orderkey", DEFAULT.seed)


@query("split_random", sql=f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h, o_orderkey)
  <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM (SELECT o_orderkey, {H_ORD} AS h FROM orders) x""")
def q_split_random(spark, sf_dir):
    return S.split_random(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "split")


@query("split_stratified", sql=f"""WITH x AS (SELECT o_orderkey, o_orderstatus, {H_ORD} AS h FROM orders),
c AS (SELECT o_orderstatus AS cls, count(*) AS n, ceil(CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM orders)) AS total FROM orders GROUP BY 1),
e AS (SELECT cls, total, total * n / (SELECT count(*) FROM orders) AS exact FROM c),
a AS (SELECT cls, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, cls)
        <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_test FROM e)
SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) <= n_test
  THEN 'test' ELSE 'train' END AS split FROM x JOIN a ON cls = o_orderstatus""")
def q_split_stratified(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.split_stratified(o, "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus", "split")


@query("fold_assign", sql=f"""SELECT o_orderkey, CAST((row_number() OVER (ORDER BY h, o_orderkey) - 1) % 5 AS INT) AS fold
FROM (SELECT o_orderkey, {H_ORD} AS h FROM orders) x""")
def q_fold_assign(spark, sf_dir):
    return S.fold_assign(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5).select("o_orderkey", "fold")


@query("fold_stratified", sql=f"""WITH x AS (SELECT o_orderkey, o_orderstatus, {H_ORD} AS h FROM orders),
k AS (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus) c)
SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (ORDER BY o_orderstatus, h, o_orderkey) - 1)
  % (SELECT k FROM k) AS INT) AS fold FROM x""")
def q_fold_stratified(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k, strat = S.choose_folds("classification", 0, S.min_class_count(o, "o_orderstatus"))
    return S.fold_stratified(o, "o_orderkey", "o_orderstatus", k).select("o_orderkey", "o_orderstatus", "fold")


@query("sample_topn", sql=f"""SELECT event_id, user_id, event_type, value FROM events
ORDER BY {sql_hash_unit('event_id', DEFAULT.seed)}, event_id LIMIT 200""")
def q_sample_topn(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return S.sample_topn(e, "event_id", DEFAULT.explain_rows)


@query("scoring_choice", sql=f"""WITH {COUNTS},
mc AS (SELECT table_name, CAST(min(n) AS DOUBLE) / sum(n) AS minority_share FROM tcounts WHERE value IS NOT NULL GROUP BY table_name)
SELECT tp.table_name, CASE WHEN tp.task_type = 'regression' THEN 'r2'
  WHEN minority_share < 0.35 THEN 'f1_weighted' ELSE 'accuracy' END AS scoring
FROM tp LEFT JOIN mc USING (table_name)""")
def q_scoring_choice(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    tp = p.target_profile()
    sc = S.scoring_choice(p.counts)
    return tp.join(sc, "table_name", "left").select(
        "table_name", F.when(F.col("task_type") == "regression", "r2")
        .otherwise(F.coalesce(F.col("scoring"), F.lit("accuracy"))).alias("scoring"))
