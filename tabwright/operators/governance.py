"""Run governance (J1, J2) as column expressions over the runs table.

runs columns used: task_type, risk_score, f1_score, accuracy, r2_score,
winner, n_top_features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values (issue / suggestion / recommendation texts) ---------------
ISSUE_RISK = "The dataset carries moderate to high risk and deserves stricter validation."
ISSUE_CLS = "Classification performance is below a strong production threshold."
SUGGEST_CLS = "Try stronger imbalance handling, feature selection, or calibration."
ISSUE_REG = "Regression performance suggests the signal may be weak or noisy."
SUGGEST_REG = "Experiment with additional engineered features and domain-specific transformations."
ISSUE_TREE = "The final model may be too brittle if the tree is shallowly tuned."
SUGGEST_TREE = "Consider an ensemble or boosting model for better generalization."
ISSUE_EXPLAIN = "Explainability output is thin, which limits trust and auditability."
SUGGEST_EXPLAIN = "Enable more stable model-agnostic attribution methods on future runs."
SUGGEST_DEFAULT = "Keep the current workflow, but monitor drift and retrain on a schedule."
NO_ISSUES = "No major issues detected."
SINGLE_TREES = ("Decision Tree", "Decision Tree Regressor")
REC_CLS = ("Consider collecting more data, revisiting class balance, and expanding feature engineering "
           "for classification performance.")
REC_REG = ("The regression fit can likely improve with richer features, stronger tuning, or additional "
           "domain-specific inputs.")
REC_EXPLAIN = ("Explainability signals were limited; inspect the data pipeline and feature availability "
               "before deployment.")
REC_OK = ("The selected model is suitable for a first production candidate. Monitor drift, retrain "
          "periodically, and track the top features in downstream governance.")
# ---------------------------------------------------------------------------


def _cls_metric():
    return F.coalesce(F.col("f1_score"), F.col("accuracy"), F.lit(0.0))


def run_gates(runs: DataFrame) -> DataFrame:
    """issues[], suggestions[], severity (>=3 high, >=1 medium, else low)."""
    is_cls = F.col("task_type") == "classification"
    is_reg = F.col("task_type") == "regression"
    risky = F.coalesce(F.col("risk_score"), F.lit(0.0)) >= 60
    weak_cls = is_cls & (_cls_metric() < 0.8)
    weak_reg = is_reg & (F.coalesce(F.col("r2_score"), F.lit(0.0)) < 0.75)
    tree = F.col("winner").isin(*SINGLE_TREES)
    thin = F.coalesce(F.col("n_top_features"), F.lit(0)) == 0
    issues = F.array_compact(F.array(F.when(risky, F.lit(ISSUE_RISK)), F.when(weak_cls, F.lit(ISSUE_CLS)),
                                     F.when(weak_reg, F.lit(ISSUE_REG)), F.when(tree, F.lit(ISSUE_TREE)),
                                     F.when(thin, F.lit(ISSUE_EXPLAIN))))
    sugg = F.array_compact(F.array(F.when(weak_cls, F.lit(SUGGEST_CLS)), F.when(weak_reg, F.lit(SUGGEST_REG)),
                                   F.when(tree, F.lit(SUGGEST_TREE)), F.when(thin, F.lit(SUGGEST_EXPLAIN))))
    n = F.size(issues)
    out = runs.select("*", issues.alias("_i"), sugg.alias("_s"))
    return out.select(
        "run_id", F.size("_i").alias("n_issues"),
        F.when(F.size("_i") == 0, F.array(F.lit(NO_ISSUES))).otherwise(F.col("_i")).alias("issues"),
        F.when(F.size("_s") == 0, F.array(F.lit(SUGGEST_DEFAULT))).otherwise(F.col("_s")).alias("suggestions"),
        F.when(F.size("_i") >= 3, "high").when(F.size("_i") >= 1, "medium").otherwise("low").alias("severity"))


def run_recommendation(runs: DataFrame) -> DataFrame:
    """Four-way recommendation text."""
    is_cls = F.col("task_type") == "classification"
    rec = (F.when(is_cls & (_cls_metric() < 0.8), REC_CLS)
           .when(~is_cls & (F.coalesce(F.col("r2_score"), F.lit(0.0)) < 0.75), REC_REG)
           .when(F.coalesce(F.col("n_top_features"), F.lit(0)) == 0, REC_EXPLAIN)
           .otherwise(REC_OK))
    return runs.select("run_id", rec.alias("recommendation"))
