"""Leaderboard, champion, vote, run registry and governance queries
(G9, G13, G14, A3-A5, J1-J3).

The runs are computed from the data: hand-written rule classifiers of the
order status are cross-validated on ``orders`` (hash folds) and rule
regressors of the part price are scored on ``part``; each becomes one run
with its dataset's content signature (A7) and risk score (B16).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import fingerprint, sql_hash_unit
from ..operators import governance as G
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import rank as R
from ..operators.split import fold_assign
from ..options import DEFAULT
from ..sources import registry as REG
from ..sources.tables import read_table
from .q_profile import TABLE_PROFILE, fingerprint_sql
from .registry import query, r6

# (candidate_no, name, Spark predicate-free SQL expression, features used)
ORDER_RULES = [
    (0, "Status by Date", "CASE WHEN o_orderdate < TIMESTAMP '1998-04-25 00:00:00' THEN 'F' ELSE 'O' END", 1),
    (1, "Status by Price", "CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END", 1),
    (2, "Status by Priority", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' ELSE 'O' END", 1),
    (3, "Decision Tree", "CASE WHEN o_orderdate < TIMESTAMP '1998-04-25 00:00:00' THEN 'F' "
                         "WHEN o_totalprice > 250000 THEN 'P' ELSE 'O' END", 2),
    (4, "Majority Class", "'P'", 0),
]
PART_RULES = [
    (0, "Linear Regression", "CAST(900 + p_size * 10 + (p_partkey % 7) * 20 AS DOUBLE)", 2),
    (1, "Mean Price", "CAST(1500.0 AS DOUBLE)", 0),
]
BASE_TS = "2026-01-01 00:00:00"


# ------------------------------------------------------------------ Spark side
def order_fold_scores(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority")
    f = fold_assign(o, "o_orderkey", DEFAULT.cv_folds)
    per = f.groupBy("fold").agg(*[F.avg((F.expr(e) == F.col("o_orderstatus")).cast("double")).alias(f"s{i}")
                                  for i, _, e, _ in ORDER_RULES])
    arr = F.array(*[F.struct(F.lit(i).alias("candidate_no"), F.lit(n).alias("model"), F.col(f"s{i}").alias("score"))
                    for i, n, _, _ in ORDER_RULES])
    return per.select("fold", F.explode(arr).alias("e")).select("e.candidate_no", "e.model", "fold", "e.score")


def order_board(spark, sf_dir):
    return R.leaderboard(order_fold_scores(spark, sf_dir))


def rule_runs(spark, sf_dir):
    """One row per rule run: metrics, winner, signature, risk and timestamp."""
    board = order_board(spark, sf_dir)
    cls = board.select(F.lit("orders").alias("dataset"), "candidate_no", F.col("model").alias("winner"),
                       F.lit("classification").alias("task_type"), F.lit(None).cast("double").alias("f1_score"),
                       F.col("mean_score").alias("accuracy"), F.lit(None).cast("double").alias("r2_score"))
    p = read_table(spark, sf_dir, "part")
    reg_parts = []
    for i, n, e, _ in PART_RULES:
        m = M.regression_metrics(p.select(F.col("p_retailprice").alias("label"), F.expr(e).alias("prediction")))
        reg_parts.append(m.select(F.lit("part").alias("dataset"), F.lit(i).alias("candidate_no"), F.lit(n).alias("winner"),
                                  F.lit("regression").alias("task_type"), F.lit(None).cast("double").alias("f1_score"),
                                  F.lit(None).cast("double").alias("accuracy"), F.col("r2").alias("r2_score")))
    runs = cls
    for x in reg_parts:
        runs = runs.unionByName(x)
    feats = spark.createDataFrame([("orders", i, k) for i, _, _, k in ORDER_RULES] + [("part", i, k) for i, _, _, k in PART_RULES],
                                  "dataset string, candidate_no int, n_top_features int")
    tables = {"orders": read_table(spark, sf_dir, "orders"), "part": p}
    sig = fingerprint(tables["orders"]).select(F.lit("orders").alias("dataset"), "dataset_signature").unionByName(
        fingerprint(p).select(F.lit("part").alias("dataset"), "dataset_signature"))
    prof = P.profile_lake(spark, tables)
    risk = prof.table_profile() \
        .select(F.col("table_name").alias("dataset"), "risk_score")
    runs = runs.join(feats, ["dataset", "candidate_no"]).join(sig, "dataset").join(risk, "dataset")
    primary = F.when(F.col("task_type") == "classification", F.coalesce("f1_score", "accuracy", F.lit(0.0))) \
        .otherwise(F.coalesce("r2_score", F.lit(0.0)))
    return runs.select(
        F.concat_ws(":", "dataset", "winner").alias("run_id"), "dataset", "dataset_signature", "task_type", "winner",
        r6("f1_score").alias("f1_score"), r6("accuracy").alias("accuracy"), r6("r2_score").alias("r2_score"),
        r6(primary).alias("primary_metric"), "risk_score", "n_top_features",
        (F.to_timestamp(F.lit(BASE_TS)) + F.make_interval(mins=F.col("candidate_no"))).alias("timestamp"))


# ------------------------------------------------------------------ SQL side
_H = sql_hash_unit("o_orderkey", DEFAULT.seed)
BOARD_CTE = f"""fo AS (SELECT *, (row_number() OVER (ORDER BY h, o_orderkey) - 1) % 5 AS fold
                FROM (SELECT *, {_H} AS h FROM orders) o),
per AS (SELECT fold, {', '.join(f"avg(CAST(({e}) = o_orderstatus AS DOUBLE)) AS s{i}" for i, _, e, _ in ORDER_RULES)}
        FROM fo GROUP BY fold),
u AS ({' UNION ALL '.join(f"SELECT {i} AS candidate_no, '{n}' AS model, fold, s{i} AS score FROM per" for i, n, _, _ in ORDER_RULES)}),
lb0 AS (SELECT candidate_no, model, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM u GROUP BY ALL),
lb AS (SELECT *, row_number() OVER (ORDER BY round(mean_score, 12) DESC, candidate_no) AS rank FROM lb0)"""

RUNS_CTE = TABLE_PROFILE + f""",
{BOARD_CTE},
reg AS ({' UNION ALL '.join(
    f"SELECT {i} AS candidate_no, '{n}' AS winner, 1 - sum((p_retailprice - ({e})) * (p_retailprice - ({e}))) "
    f"/ (var_pop(p_retailprice) * count(p_retailprice)) AS r2 FROM part" for i, n, e, _ in PART_RULES)}),
feats(dataset, candidate_no, n_top_features) AS (VALUES {', '.join(
    [f"('orders', {i}, {k})" for i, _, _, k in ORDER_RULES] + [f"('part', {i}, {k})" for i, _, _, k in PART_RULES])}),
sig AS ({fingerprint_sql('orders')} UNION ALL {fingerprint_sql('part')}),
r0 AS (SELECT 'orders' AS dataset, candidate_no, model AS winner, 'classification' AS task_type,
         CAST(NULL AS DOUBLE) AS f1_score, mean_score AS accuracy, CAST(NULL AS DOUBLE) AS r2_score FROM lb
       UNION ALL SELECT 'part', candidate_no, winner, 'regression', NULL, NULL, r2 FROM reg),
runs AS (SELECT r0.dataset || ':' || r0.winner AS run_id, r0.dataset, sig.dataset_signature, r0.task_type, r0.winner,
   round(r0.f1_score, 6) AS f1_score, round(r0.accuracy, 6) AS accuracy, round(r0.r2_score, 6) AS r2_score,
   round(CASE WHEN r0.task_type = 'classification' THEN coalesce(r0.f1_score, r0.accuracy, 0.0)
         ELSE coalesce(r0.r2_score, 0.0) END, 6)
     AS primary_metric, risk.risk_score, feats.n_top_features,
   TIMESTAMP '{BASE_TS}' + to_minutes(CAST(r0.candidate_no AS BIGINT)) AS timestamp
   FROM r0 JOIN feats ON feats.dataset = r0.dataset AND feats.candidate_no = r0.candidate_no
   JOIN sig ON sig.table_name = r0.dataset JOIN risk ON risk.table_name = r0.dataset)"""


@query("leaderboard", sql=f"""WITH {BOARD_CTE}
SELECT candidate_no, model, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, rank FROM lb""")
def q_leaderboard(spark, sf_dir):
    b = order_board(spark, sf_dir)
    return b.select("candidate_no", "model", r6("mean_score").alias("mean_score"), r6("std_score").alias("std_score"),
                    F.col("rank").cast("long").alias("rank"))


@query("champion", sql=f"WITH {BOARD_CTE} SELECT model AS champion, round(mean_score, 6) AS mean_score FROM lb WHERE rank = 1")
def q_champion(spark, sf_dir):
    return R.champion(order_board(spark, sf_dir)).select("champion", r6("mean_score").alias("mean_score"))


@query("weighted_vote", sql=f"""WITH {BOARD_CTE},
b AS (SELECT rank, model AS candidate, 4 - rank AS vote,
      greatest(0.55, least(0.99, CASE WHEN mean_score <= 1 THEN mean_score ELSE mean_score / 100 END)) AS confidence
      FROM lb WHERE rank <= 3),
pc AS (SELECT candidate, sum(vote) AS votes, sum(confidence * vote) AS weighted, min(rank) AS first_seen FROM b GROUP BY candidate)
SELECT (SELECT candidate FROM pc ORDER BY weighted DESC, first_seen LIMIT 1) AS winner,
  round(least(0.99, (SELECT max(weighted) FROM pc) / greatest(1, (SELECT sum(abs(votes)) FROM pc))), 3) AS confidence""")
def q_weighted_vote(spark, sf_dir):
    return R.weighted_vote(R.ballots_from_board(order_board(spark, sf_dir)))


@query("run_best", sql=f"""WITH {RUNS_CTE}
SELECT dataset_signature, run_id, primary_metric FROM (SELECT *, row_number() OVER (PARTITION BY dataset_signature
  ORDER BY primary_metric DESC NULLS LAST, timestamp, run_id) AS rn FROM runs) WHERE rn = 1""")
def q_run_best(spark, sf_dir):
    return R.best_run(rule_runs(spark, sf_dir)).select("dataset_signature", "run_id", "primary_metric")


def _gates_sql():
    g = G
    return f"""WITH {RUNS_CTE},
x AS (SELECT run_id,
  list_filter([CASE WHEN coalesce(risk_score, 0.0) >= 60 THEN '{g.ISSUE_RISK}' END,
    CASE WHEN task_type = 'classification' AND coalesce(f1_score, accuracy, 0.0) < 0.8 THEN '{g.ISSUE_CLS}' END,
    CASE WHEN task_type = 'regression' AND coalesce(r2_score, 0.0) < 0.75 THEN '{g.ISSUE_REG}' END,
    CASE WHEN winner IN ('Decision Tree', 'Decision Tree Regressor') THEN '{g.ISSUE_TREE}' END,
    CASE WHEN coalesce(n_top_features, 0) = 0 THEN '{g.ISSUE_EXPLAIN}' END], lambda s: s IS NOT NULL) AS i,
  list_filter([CASE WHEN task_type = 'classification' AND coalesce(f1_score, accuracy, 0.0) < 0.8 THEN '{g.SUGGEST_CLS}' END,
    CASE WHEN task_type = 'regression' AND coalesce(r2_score, 0.0) < 0.75 THEN '{g.SUGGEST_REG}' END,
    CASE WHEN winner IN ('Decision Tree', 'Decision Tree Regressor') THEN '{g.SUGGEST_TREE}' END,
    CASE WHEN coalesce(n_top_features, 0) = 0 THEN '{g.SUGGEST_EXPLAIN}' END], lambda s: s IS NOT NULL) AS s FROM runs)
SELECT run_id, CAST(len(i) AS INT) AS n_issues,
  CASE WHEN len(i) = 0 THEN '{g.NO_ISSUES}' ELSE array_to_string(i, '|') END AS issues,
  CASE WHEN len(s) = 0 THEN '{g.SUGGEST_DEFAULT}' ELSE array_to_string(s, '|') END AS suggestions,
  CASE WHEN len(i) >= 3 THEN 'high' WHEN len(i) >= 1 THEN 'medium' ELSE 'low' END AS severity FROM x"""


@query("run_gates", sql=_gates_sql())
def q_run_gates(spark, sf_dir):
    g = G.run_gates(rule_runs(spark, sf_dir))
    return g.select("run_id", "n_issues", F.array_join("issues", "|").alias("issues"),
                    F.array_join("suggestions", "|").alias("suggestions"), "severity")


@query("run_recommendation", sql=f"""WITH {RUNS_CTE}
SELECT run_id, CASE WHEN task_type = 'classification' AND coalesce(f1_score, accuracy, 0.0) < 0.8 THEN '{G.REC_CLS}'
  WHEN task_type <> 'classification' AND coalesce(r2_score, 0.0) < 0.75 THEN '{G.REC_REG}'
  WHEN coalesce(n_top_features, 0) = 0 THEN '{G.REC_EXPLAIN}' ELSE '{G.REC_OK}' END AS recommendation FROM runs""")
def q_run_recommendation(spark, sf_dir):
    return G.run_recommendation(rule_runs(spark, sf_dir))


def _registry_path(spark):
    return REG.default_registry(spark, f"runs-{uuid.uuid4().hex[:8]}")


@query("run_registry")
def q_run_registry(spark, sf_dir):
    """A3: append the runs (twice, as two sessions would) and scan the registry back."""
    path = _registry_path(spark)
    runs = rule_runs(spark, sf_dir)
    REG.append_runs(runs, path)
    REG.append_runs(runs, path)
    return REG.read_runs(spark, path)


@query("run_compare")
def q_run_compare(spark, sf_dir):
    """A4: registry scan ranked per dataset (best first)."""
    path = _registry_path(spark)
    REG.append_runs(rule_runs(spark, sf_dir), path)
    return REG.compare_runs(REG.read_runs(spark, path))


@query("run_history")
def q_run_history(spark, sf_dir):
    """A5: winners / datasets history and the prior winner per signature."""
    path = _registry_path(spark)
    REG.append_runs(rule_runs(spark, sf_dir), path)
    return REG.history(REG.read_runs(spark, path))
