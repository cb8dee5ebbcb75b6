"""Metric queries (H2-H10) on rule-scored tables derived from orders and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import read_table
from .fixtures import MULTI_ORDERS_SQL, SCORED_ORDERS_SQL, multi_orders, scored_orders
from .registry import query, r6

PROBS_SQL = """SELECT o_orderkey, o_orderstatus AS label, c.class,
  CAST(CASE c.class WHEN 'F' THEN (o_orderkey * 37) % 101 + 1 WHEN 'O' THEN (o_orderkey * 53) % 97 + 1
       ELSE (o_orderkey * 11) % 13 + 1 END AS DOUBLE)
  / CAST(((o_orderkey * 37) % 101 + 1) + ((o_orderkey * 53) % 97 + 1) + ((o_orderkey * 11) % 13 + 1) AS DOUBLE) AS prob
FROM orders, (SELECT unnest(['F', 'O', 'P']) AS class) c"""


def multi_probs(spark, sf_dir):
    """Long (row, class, prob) scores for the three order statuses (sum to 1 per row)."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sf, so, sp = (k * 37) % 101 + 1, (k * 53) % 97 + 1, (k * 11) % 13 + 1
    tot = (sf + so + sp).cast("double")
    arr = F.array(*[F.struct(F.lit(c).alias("class"), (s.cast("double") / tot).alias("prob"))
                    for c, s in (("F", sf), ("O", so), ("P", sp))])
    return o.select("o_orderkey", F.col("o_orderstatus").alias("label"), F.explode(arr).alias("e")) \
        .select("o_orderkey", "label", "e.class", "e.prob")


REG_SQL = """SELECT p_partkey, p_retailprice AS label,
  CAST(900 + p_size * 10 + (p_partkey % 7) * 20 AS DOUBLE) AS prediction FROM part"""


def part_rule(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_retailprice").alias("label"),
                    (900 + F.col("p_size") * 10 + (F.col("p_partkey") % 7) * 20).cast("double").alias("prediction"))


PRF_SQL = f"""t AS ({MULTI_ORDERS_SQL}),
cc AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM t GROUP BY ALL),
a AS (SELECT actual AS class, sum(n) AS n_actual, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM cc GROUP BY 1),
p AS (SELECT predicted AS class, sum(n) AS n_pred FROM cc GROUP BY 1),
j AS (SELECT coalesce(a.class, p.class) AS class, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred,
      coalesce(n_actual, 0) AS n_actual FROM a FULL JOIN p ON a.class = p.class),
m AS (SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS prec,
      CASE WHEN n_actual = 0 THEN 0.0 ELSE tp / n_actual END AS rec FROM j),
f AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM m),
prf AS (SELECT sum(prec * n_actual) / sum(n_actual) AS precision, sum(rec * n_actual) / sum(n_actual) AS recall,
        sum(f1 * n_actual) / sum(n_actual) AS f1_score FROM f)"""


@query("metric_accuracy", sql=f"""SELECT 'binary' AS dataset, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM ({SCORED_ORDERS_SQL}) b
UNION ALL SELECT 'multiclass', round(avg(CAST(label = prediction AS DOUBLE)), 6) FROM ({MULTI_ORDERS_SQL}) m""")
def q_metric_accuracy(spark, sf_dir):
    b = M.accuracy(scored_orders(spark, sf_dir)).select(F.lit("binary").alias("dataset"), r6("accuracy").alias("accuracy"))
    m = M.accuracy(multi_orders(spark, sf_dir)).select(F.lit("multiclass").alias("dataset"), r6("accuracy").alias("accuracy"))
    return b.unionByName(m)


@query("metric_prf", sql=f"WITH {PRF_SQL} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM prf")
def q_metric_prf(spark, sf_dir):
    r = M.prf_weighted(multi_orders(spark, sf_dir))
    return r.select(r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1_score"))


@query("confusion_matrix", sql=f"""WITH t AS ({MULTI_ORDERS_SQL}),
cc AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM t GROUP BY ALL),
ls AS (SELECT DISTINCT actual AS c FROM cc UNION SELECT DISTINCT predicted FROM cc)
SELECT a.c AS actual, p.c AS predicted, coalesce(cc.n, 0) AS n FROM ls a JOIN ls p ON true
LEFT JOIN cc ON cc.actual = a.c AND cc.predicted = p.c""")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion(multi_orders(spark, sf_dir))


_AUC_SQL = """g AS (SELECT score, sum(label) AS np, sum(1 - label) AS nn FROM t GROUP BY score),
c AS (SELECT *, coalesce(sum(nn) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"""


@query("metric_auc", sql=f"""WITH t AS ({SCORED_ORDERS_SQL}), {_AUC_SQL}
SELECT round(sum(np * (below + 0.5 * nn)) / (CAST(sum(np) AS DOUBLE) * sum(nn)), 6) AS auc FROM c""")
def q_metric_auc(spark, sf_dir):
    return M.auc(scored_orders(spark, sf_dir), "label", "score").select(r6("auc").alias("auc"))


@query("metric_auc_ovr", sql=f"""WITH t AS ({PROBS_SQL}),
g AS (SELECT class, prob, sum(CAST(label = class AS INT)) AS np, sum(1 - CAST(label = class AS INT)) AS nn FROM t GROUP BY class, prob),
c AS (SELECT *, coalesce(sum(nn) OVER (PARTITION BY class ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT class, sum(np * (below + 0.5 * nn)) / (CAST(sum(np) AS DOUBLE) * sum(nn)) AS auc, sum(np) AS sup FROM c GROUP BY class)
SELECT round(sum(auc * sup) / sum(sup), 6) AS auc_ovr FROM a""")
def q_metric_auc_ovr(spark, sf_dir):
    return M.auc_ovr_weighted(multi_probs(spark, sf_dir)).select(r6("auc_ovr").alias("auc_ovr"))


@query("metric_regression", sql=f"""SELECT round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse,
  round(avg(abs(label - prediction)), 6) AS mae,
  round(1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(label)), 6) AS r2
FROM ({REG_SQL}) r""")
def q_metric_regression(spark, sf_dir):
    r = M.regression_metrics(part_rule(spark, sf_dir))
    return r.select(*[r6(c).alias(c) for c in ("rmse", "mae", "r2")])


@query("primary_metric", sql=f"""WITH {PRF_SQL}
SELECT 'orders_status_rule' AS run, 'classification' AS task_type, round(coalesce(f1_score, 0.0), 6) AS primary_metric FROM prf
UNION ALL SELECT 'part_price_rule', 'regression',
  round(1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(label)), 6) FROM ({REG_SQL}) r""")
def q_primary_metric(spark, sf_dir):
    prf = M.prf_weighted(multi_orders(spark, sf_dir))
    acc = M.accuracy(multi_orders(spark, sf_dir))
    reg = M.regression_metrics(part_rule(spark, sf_dir))
    long = (prf.select(F.lit("orders_status_rule").alias("run"), F.lit("classification").alias("task_type"),
                       F.lit("f1_score").alias("metric"), F.col("f1").alias("value"))
            .unionByName(acc.select(F.lit("orders_status_rule").alias("run"), F.lit("classification").alias("task_type"),
                                    F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))
            .unionByName(reg.select(F.lit("part_price_rule").alias("run"), F.lit("regression").alias("task_type"),
                                    F.lit("r2_score").alias("metric"), F.col("r2").alias("value"))))
    return M.primary_metric(long).select("run", "task_type", r6("primary_metric").alias("primary_metric"))
