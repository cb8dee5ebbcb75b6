"""Explanation queries (I1-I8).  Exact SQL oracles use linear or rule models
(OLS on part, the order-status rule tree); trained tree models are rows-only."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_unit
from ..operators import explain as X
from ..operators import features as FE
from ..operators import select as SEL
from ..operators import trees as T
from ..operators.split import sample_topn
from ..options import DEFAULT
from ..sources.tables import read_table
from .q_models import doc_trainset, part_trainset
from .q_runs import ORDER_RULES
from .registry import query, r6

SEED = DEFAULT.seed
PART_RULE = "CAST(900 + p_size * 10 + (p_partkey % 7) * 20 AS DOUBLE)"
TREE_RULE = [e for _, n, e, _ in ORDER_RULES if n == "Decision Tree"][0]
PERM_FEATURES = ["o_orderdate", "o_totalprice", "o_orderpriority"]


#: p_size <= 20: (p_retailprice <= 908: 1, else 4); else (p_retailprice <= 912: 2, else 9)
RULE_TREE = T.Ensemble([T.Tree(*map(np.array, ([0, 1, -1, -1, 1, -1, -1], [20.0, 908.0, np.nan, np.nan, 912.0, np.nan, np.nan])), [None] * 7,
                               *map(np.array, ([1, 2, -1, -1, 5, -1, -1], [4, 3, -1, -1, 6, -1, -1])),
                               np.array([[0.0], [0.0], [1.0], [4.0], [0.0], [2.0], [9.0]]), np.zeros(7))], [1.0], "mean")
_RULE = "(CASE WHEN {s} <= 20 THEN CASE WHEN {r} <= 908 THEN 1.0 ELSE 4.0 END ELSE CASE WHEN {r} <= 912 THEN 2.0 ELSE 9.0 END END)"
_XX, _XZ, _ZX, _ZZ = (_RULE.format(s=f"{a}.p_size", r=f"{b}.p_retailprice") for a in "xz" for b in "xz")
RULE_TREE_SQL = f"""WITH z AS (SELECT p_size, p_retailprice FROM part ORDER BY p_partkey LIMIT {DEFAULT.background_rows}),
phi AS (SELECT x.p_partkey, avg(({_XZ}) - ({_ZZ}) + ({_XX}) - ({_ZX})) / 2 AS a, avg(({_ZX}) - ({_ZZ}) + ({_XX}) - ({_XZ})) / 2 AS b
        FROM part x, z GROUP BY x.p_partkey)
SELECT 'p_size' AS feature, round(avg(abs(a)), 6) AS importance FROM phi UNION ALL SELECT 'p_retailprice', round(avg(abs(b)), 6) FROM phi"""


def _ols_part(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    va = VectorAssembler(inputCols=["p_size"], outputCol="features")
    d = va.transform(p)
    m = LinearRegression(featuresCol="features", labelCol="p_retailprice", regParam=0.0, solver="normal").fit(d)
    return d, m


def _shap_linear(spark, sf_dir):
    d, m = _ols_part(spark, sf_dir)
    mu = X.vector_mean(d, "features", 1)          # the background is every row: one aggregate
    return X.shap_linear(d, "features", list(m.coefficients.toArray()), mu, ["p_size"])


SHAP_LINEAR_SQL = """sl AS (SELECT 'p_size' AS feature, avg(abs((SELECT regr_slope(p_retailprice, p_size) FROM part)
   * (p_size - (SELECT avg(CAST(p_size AS DOUBLE)) FROM part)))) AS importance FROM part)"""


@query("shap_linear", sql=f"WITH {SHAP_LINEAR_SQL} SELECT feature, round(importance, 6) AS importance FROM sl")
def q_shap_linear(spark, sf_dir):
    return _shap_linear(spark, sf_dir).select("feature", r6("importance").alias("importance"))


@query("shap_sampled")
def q_shap_sampled(spark, sf_dir):
    """Sampled permutation Shapley values of the logistic model's probability, a score without a
    closed form; all rows explained (trees have exact values: ``shap_tree``)."""
    s, ts = doc_trainset(spark, sf_dir)
    pre, model = SEL.fit_final(ts, "Logistic Regression", None)
    ts.release()
    rows = pre.transform(s)
    bg = sample_topn(rows, "doc_id", DEFAULT.background_rows)
    two = model.numClasses == 2
    weights, shift = (model.coefficients.toArray(), float(model.intercept)) if two else (None, None)
    return X.shap_sampled(rows, bg, "doc_id", "features", len(pre.feature_names),
                          lambda d: model.transform(d).withColumn("_out", vector_to_array("probability")[1]),
                          pre.feature_names, seed=SEED, predict_rows=(lambda x: 1 / (1 + np.exp(-(x @ weights + shift)))) if two else None)


@query("shap_tree")
def q_shap_tree(spark, sf_dir):
    """Exact interventional Shapley values of the 300-tree forest on document quality, all rows explained."""
    s, ts = doc_trainset(spark, sf_dir)
    pre, model = SEL.fit_final(ts, "Random Forest", None)
    ts.release()
    rows = pre.transform(s)
    bg = sample_topn(rows, "doc_id", DEFAULT.background_rows)
    return T.shapley_importance(model, rows, bg, "doc_id", pre.feature_names)


@query("shap_rule_tree", sql=RULE_TREE_SQL)
def q_shap_rule_tree(spark, sf_dir):
    """Shapley values of a given two-feature tree for every part, against the closed form of two features."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    rows = VectorAssembler(inputCols=["s", "r"], outputCol="features").transform(p)
    bg = rows.orderBy("p_partkey").limit(DEFAULT.background_rows)
    return T.shapley_importance(RULE_TREE, rows, bg, "p_partkey", ["p_size", "p_retailprice"]) \
        .select("feature", r6("importance").alias("importance"))


@query("native_importance")
def q_native_importance(spark, sf_dir):
    s, ts = doc_trainset(spark, sf_dir)
    pre, model = SEL.fit_final(ts, "Random Forest", None)
    ts.release()
    return spark.createDataFrame(X.native_importance(model, pre.feature_names), "feature string, importance double")


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", *PERM_FEATURES)


def _tree_accuracy(frame, group):
    return frame.groupBy(*group).agg(F.avg((F.expr(TREE_RULE) == F.col("o_orderstatus")).cast("double")).alias("score"))


def _perm(spark, sf_dir):
    return X.permutation_importance(_orders(spark, sf_dir), "o_orderkey", PERM_FEATURES, _tree_accuracy,
                                    DEFAULT.permutation_repeats, SEED)


def _perm_sql():
    tags = ", ".join(f"('{f}', {r})" for f in PERM_FEATURES for r in range(DEFAULT.permutation_repeats))
    swapped = ", ".join(f"CASE WHEN feature = '{f}' THEN b.{f} ELSE a.{f} END AS {f}" for f in PERM_FEATURES)
    return f"""base AS (SELECT o_orderkey, o_orderstatus, {', '.join(PERM_FEATURES)}, row_number() OVER (ORDER BY {sql_hash_unit('o_orderkey', SEED)}, o_orderkey) AS r,
        count(*) OVER () AS n FROM orders),
tags(feature, rep) AS (VALUES {tags}),
x AS (SELECT base.*, tags.feature, tags.rep, (r - 1 + 1 + CAST('0x' || substr(md5(tags.feature || ':' || tags.rep || ':{SEED}'), 1, 12) AS BIGINT) % greatest(1, n - 1)) % n + 1 AS other
      FROM base, tags),
j AS (SELECT a.feature, a.rep, a.o_orderstatus, {swapped} FROM x a JOIN base b ON b.r = a.other),
sc AS (SELECT feature, rep, avg(CAST(({TREE_RULE}) = o_orderstatus AS DOUBLE)) AS score FROM j GROUP BY feature, rep),
basesc AS (SELECT avg(CAST(({TREE_RULE}) = o_orderstatus AS DOUBLE)) AS b FROM base),
perm AS (SELECT feature, (SELECT b FROM basesc) - avg(score) AS importance, stddev_pop(score) AS std FROM sc GROUP BY feature)"""


@query("perm_importance", sql=f"WITH {_perm_sql()} SELECT feature, round(importance, 6) AS importance, round(std, 6) AS std FROM perm")
def q_perm_importance(spark, sf_dir):
    return _perm(spark, sf_dir).select("feature", r6("importance").alias("importance"), r6("std").alias("std"))


@query("importance_topk", sql=f"""WITH {_perm_sql()}, {SHAP_LINEAR_SQL},
u AS (SELECT 'permutation' AS kind, feature, importance FROM perm UNION ALL SELECT 'shap', feature, importance FROM sl)
SELECT kind, feature, round(importance, 6) AS importance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY importance DESC, feature) AS rank FROM u) WHERE rank <= 10""")
def q_importance_topk(spark, sf_dir):
    t = X.importance_topk({"permutation": _perm(spark, sf_dir), "shap": _shap_linear(spark, sf_dir)})
    return t.select("kind", "feature", r6("importance").alias("importance"), F.col("rank").cast("long").alias("rank"))


def _pdp_sql():
    parts = []
    for f in ("p_partkey", "p_size"):
        expr = PART_RULE.replace(f, "g.v")
        parts.append(f"""SELECT '{f}' AS feature, g.i AS grid_index, round(g.v, 6) AS grid_value,
  round(avg({expr}), 6) AS average_prediction
FROM part, (SELECT i, lo + (hi - lo) * i / 99 AS v FROM range(100) t(i),
  (SELECT quantile_cont(CAST({f} AS DOUBLE), 0.05) AS lo, quantile_cont(CAST({f} AS DOUBLE), 0.95) AS hi FROM part) q) g
GROUP BY g.i, g.v""")
    return " UNION ALL ".join(parts)


@query("partial_dependence", sql=_pdp_sql())
def q_partial_dependence(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    pd = X.partial_dependence(p, ["p_partkey", "p_size"], lambda d: d.withColumn("prediction", F.expr(PART_RULE)),
                              DEFAULT.pdp_grid_points)
    return pd.select("feature", F.col("grid_index").cast("long").alias("grid_index"), r6("grid_value").alias("grid_value"),
                     r6("average_prediction").alias("average_prediction"))


@query("surrogate_ridge")
def q_surrogate_ridge(spark, sf_dir):
    """Ridge surrogate of the logistic model's predicted class on the hold-out rows."""
    s, ts = doc_trainset(spark, sf_dir)
    pre, model = SEL.fit_final(ts, "Logistic Regression", None)
    ts.release()
    test = s.where(F.col("split") == "test")
    pred = model.transform(pre.transform(test)).select("features", F.col("prediction").alias("_p"))
    sur = X.surrogate_ridge(pred, "features", "_p")
    coefs = [(n, float(c)) for n, c in zip(pre.feature_names, sur.coefficients.toArray())]
    return spark.createDataFrame(coefs + [("intercept", float(sur.intercept))], "feature string, coefficient double")


@query("surrogate_rule", sql=f"""WITH x AS (SELECT CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 7 AS DOUBLE) AS b, {PART_RULE} AS y FROM part),
s AS (SELECT covar_pop(a, a) * count(*) + 1 AS aa, covar_pop(b, b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab,
  covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
c AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb, ma, mb, my FROM s)
SELECT 'p_size' AS feature, round(ca, 6) AS coefficient FROM c UNION ALL SELECT 'part_day', round(cb, 6) FROM c
UNION ALL SELECT 'intercept', round(my - ca * ma - cb * mb, 6) FROM c""")
def q_surrogate_rule(spark, sf_dir):
    """Ridge surrogate of a rule's predictions on two features; closed form in SQL."""
    p = read_table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 7).alias("part_day"), F.expr(PART_RULE).alias("y"))
    sur = X.surrogate_ridge(p, ["p_size", "part_day"], "y")
    rows = [*zip(["p_size", "part_day"], map(float, sur.coefficients.toArray())), ("intercept", sur.intercept)]
    return spark.createDataFrame(rows, "feature string, coefficient double").select("feature", r6("coefficient").alias("coefficient"))


@query("error_topk", sql=f"""SELECT p_partkey, p_retailprice AS actual, {PART_RULE} AS prediction,
  round(p_retailprice - {PART_RULE}, 6) AS error FROM part
ORDER BY abs(p_retailprice - {PART_RULE}) DESC, p_partkey LIMIT 20""")
def q_error_topk(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("actual"),
                                                  F.expr(PART_RULE).alias("prediction"))
    return X.error_table(p, "p_partkey", 20).select("p_partkey", "actual", "prediction", r6("error").alias("error"))
