"""Feature-engineering queries (F1-F9): selection on the cleaned events
fixture, imputers on its raw kept rows, polynomial / scaling / one-hot on part."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.dictionary import encode, level_dictionary
from ..operators import features as FE
from ..operators.clean import clean, drop_duplicates, drop_null_target, replace_inf
from ..options import DEFAULT
from ..sources.tables import read_table
from .fixtures import dirty_events
from .q_clean import CLEANED_CTE, KEPT_CTE
from .registry import query, r6

CLEAN_COLS = [("event_id", "numeric"), ("user_id", "numeric"), ("event_type", "categorical"),
              ("value", "numeric"), ("const_col", "numeric"), ("value_x2", "numeric")]
CLEAN_NUM = [c for c, r in CLEAN_COLS if r == "numeric"]
PART_NUM = ["p_partkey", "p_size", "p_retailprice"]
PART_CAT = ["p_brand", "p_type"]

_ND = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{r}' AS role, {i} AS ord, count(DISTINCT {c}) AS n_distinct FROM cleaned"
                         for i, (c, r) in enumerate(CLEAN_COLS))
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM cleaned"
                            for a, b in combinations(CLEAN_NUM, 2))
SEL_CTE = CLEANED_CTE + f""",
nd AS ({_ND}),
allpairs AS ({_PAIRS}),
pairs AS (SELECT p.* FROM allpairs p JOIN nd a ON a.column_name = p.col_a JOIN nd b ON b.column_name = p.col_b
          WHERE a.n_distinct > 1 AND b.n_distinct > 1 AND abs(p.r) > 0.98 AND NOT isnan(p.r))"""


def _cleaned(spark, sf_dir):
    return clean(dirty_events(spark, sf_dir), "target").data


def _kept(spark, sf_dir):
    return drop_null_target(drop_duplicates(replace_inf(dirty_events(spark, sf_dir))), "target")


@query("feat_low_variance", sql=f"WITH {SEL_CTE} SELECT column_name, n_distinct, n_distinct <= 1 AS low_variance FROM nd")
def q_feat_low_variance(spark, sf_dir):
    d = _cleaned(spark, sf_dir)
    cols = [c for c in d.columns if c != "target"]
    row = d.agg(*[F.countDistinct(c).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for c in cols])
    return row.select(F.explode(arr).alias("e")).select("e.*").withColumn("low_variance", F.col("n_distinct") <= 1)


@query("feat_correlated", sql=f"WITH {SEL_CTE} SELECT col_a, col_b, round(r, 6) AS r FROM pairs")
def q_feat_correlated(spark, sf_dir):
    sel = FE.select_features(_cleaned(spark, sf_dir), "target")
    return spark.createDataFrame(sel.correlated_pairs, "col_a string, col_b string, r double").select(
        "col_a", "col_b", r6("r").alias("r"))


_LINE = "SELECT l_quantity, l_tax, l_extendedprice, l_extendedprice * 1.07 + 3 AS gross, -l_tax AS refund, 1 AS one, l_linestatus FROM lineitem"
_LINE_NUM = ["l_quantity", "l_tax", "l_extendedprice", "gross", "refund"]


@query("feat_selection", sql=f"WITH l AS ({_LINE}), pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM l"
    for i, a in enumerate(_LINE_NUM) for b in _LINE_NUM[i + 1:]) + f"""), gone AS (SELECT DISTINCT col_b FROM pairs WHERE abs(r) > {DEFAULT.correlation_drop})
SELECT 'one' AS column_name, 'low_variance' AS action UNION ALL SELECT col_b, 'correlated' FROM gone
UNION ALL SELECT c, 'numeric' FROM (VALUES {', '.join(f"('{c}')" for c in _LINE_NUM)}) t(c) WHERE c NOT IN (SELECT col_b FROM gone)""")
def q_feat_selection(spark, sf_dir):
    """F1, F2, F9 on columns of which one is constant and two are copies of others."""
    line = read_table(spark, sf_dir, "lineitem").selectExpr(*_LINE.removeprefix("SELECT ").removesuffix(" FROM lineitem").split(", "))
    return spark.createDataFrame(FE.select_features(line, "l_linestatus").report_rows(), "column_name string, action string")


@query("feat_report", sql=f"""WITH {SEL_CTE}
SELECT column_name, 'low_variance' AS action FROM nd WHERE n_distinct <= 1
UNION ALL SELECT DISTINCT col_b, 'correlated' FROM pairs
UNION ALL SELECT column_name, role FROM nd WHERE n_distinct > 1 AND column_name NOT IN (SELECT col_b FROM pairs)""")
def q_feat_report(spark, sf_dir):
    sel = FE.select_features(_cleaned(spark, sf_dir), "target")
    return spark.createDataFrame(sel.report_rows(), "column_name string, action string")


KEPT_NUM = ["event_id", "user_id", "value", "sparse_col", "const_col", "value_x2"]


@query("feat_impute_num", sql=f"WITH {KEPT_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0.0), 6) AS median FROM kept" for c in KEPT_NUM))
def q_feat_impute_num(spark, sf_dir):
    med = FE.fit_medians(_kept(spark, sf_dir), KEPT_NUM)
    return spark.createDataFrame(list(med.items()), "column_name string, median double").select("column_name", r6("median").alias("median"))


@query("feat_impute_cat", sql=f"""WITH {KEPT_CTE}
SELECT 'event_type' AS column_name, coalesce((SELECT event_type FROM kept WHERE event_type IS NOT NULL
  GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1), 'Unknown') AS mode""")
def q_feat_impute_cat(spark, sf_dir):
    m = FE.fit_modes(_kept(spark, sf_dir), ["event_type"])
    return spark.createDataFrame(list(m.items()), "column_name string, mode string")


_TERMS = FE.poly_terms(PART_NUM)


def _term_sql(parts):
    return " * ".join(f"CAST({c} AS DOUBLE)" for c in parts)


@query("feat_poly", sql=" UNION ALL ".join(
    f"SELECT p_partkey, '{n}' AS term, round({_term_sql(parts)}, 6) AS value FROM part" for n, parts in _TERMS))
def q_feat_poly(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    arr = F.array(*[F.struct(F.lit(n).alias("term"), F.aggregate(
        F.array(*[F.col(c).cast("double") for c in parts]), F.lit(1.0), lambda a, x: a * x).alias("value"))
        for n, parts in _TERMS])
    return p.select("p_partkey", F.explode(arr).alias("e")).select("p_partkey", "e.term", r6("e.value").alias("value"))


def _part_pre(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p, FE.fit_preprocessor(p, PART_NUM, PART_CAT)


@query("feat_scale", sql=" UNION ALL ".join(
    f"""SELECT p_partkey, '{n}' AS term, round((({_term_sql(parts)}) - avg({_term_sql(parts)}) OVER ())
   / CASE WHEN stddev_pop({_term_sql(parts)}) OVER () = 0 THEN 1 ELSE stddev_pop({_term_sql(parts)}) OVER () END, 6) AS value
   FROM part""" for n, parts in _TERMS))
def q_feat_scale(spark, sf_dir):
    p, pre = _part_pre(spark, sf_dir)
    t = pre.transform(p)
    arr = F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"`numeric__{n}`").alias("value")) for n in pre.numeric_terms])
    return t.select("p_partkey", F.explode(arr).alias("e")).select("p_partkey", "e.term", r6("e.value").alias("value"))


@query("feat_onehot", sql="""SELECT p_partkey, 'categorical__p_brand_' || p_brand AS feature FROM part
UNION ALL SELECT p_partkey, 'categorical__p_type_' || p_type FROM part""")
def q_feat_onehot(spark, sf_dir):
    p, pre = _part_pre(spark, sf_dir)
    names = FE.feature_names_df(spark, pre)     # bounded by the number of features
    n_num = len(pre.numeric_terms)
    t = pre.transform(p).select("p_partkey", F.posexplode(vector_to_array("features")).alias("idx", "v"))
    nz = t.where((F.col("idx") >= n_num) & (F.col("v") != 0))
    return nz.join(F.broadcast(names), "idx").select("p_partkey", "feature")


@query("feat_assemble")
def q_feat_assemble(spark, sf_dir):
    p, pre = _part_pre(spark, sf_dir)
    t = pre.transform(p)
    return t.select("p_partkey", F.size(vector_to_array("features")).alias("n_features"),
                    vector_to_array("features").alias("features"))


@query("feat_dictionary", sql="""WITH l AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS idx FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS level
  FROM orders WHERE o_orderkey % 4 <> 0))
SELECT o_orderkey, idx, (SELECT count(*) FROM l) AS n_levels FROM orders LEFT JOIN l ON CAST(o_custkey AS VARCHAR) = level""")
def q_feat_dictionary(spark, sf_dir):
    """customers as levels, numbered on three quarters of the orders and looked up on all;
    those only in the last quarter are unseen (no number, a vector of zeros)."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    levels = level_dictionary(orders.where("o_orderkey % 4 <> 0"), "o_custkey")
    out = encode(orders, "o_custkey", levels, "idx", "hot")
    return out.select("o_orderkey", "idx", F.lit(levels.size).cast("long").alias("n_levels"))
