"""Training / comparison / tuning queries.

Binary task: document quality (``labels`` joined to ``documents`` metadata;
the text column is pruned from the scan).  Regression task: part retail
price from size, brand and type.  Model outputs are checked rows-only,
except ordinary least squares which has an exact SQL oracle.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.cross import gram, gram_cross_validate, total
from ..operators import select as SEL
from ..operators.split import split_stratified, split_random
from ..options import DEFAULT
from ..sources.tables import read_table
from .registry import query

DOC_NUM, DOC_CAT = ["n_chars"], ["lang", "source"]
PART_NUM, PART_CAT = ["p_size"], ["p_brand", "p_type"]


def doc_quality(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id")


def part_price(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")


def doc_split(spark, sf_dir):
    return split_stratified(doc_quality(spark, sf_dir), "doc_id", "quality")


def part_split(spark, sf_dir):
    return split_random(part_price(spark, sf_dir), "p_partkey")


def doc_trainset(spark, sf_dir, options=DEFAULT):
    s = doc_split(spark, sf_dir)
    ts = SEL.prepare(s.where(F.col("split") == "train"), "doc_id", "quality", "classification", DOC_NUM, DOC_CAT, options)
    return s, ts


def part_trainset(spark, sf_dir, options=DEFAULT):
    s = part_split(spark, sf_dir)
    ts = SEL.prepare(s.where(F.col("split") == "train"), "p_partkey", "p_retailprice", "regression", PART_NUM, PART_CAT, options)
    return s, ts


def _train_predict(spark, sf_dir, name, task, params=None):
    s, ts = doc_trainset(spark, sf_dir) if task == "classification" else part_trainset(spark, sf_dir)
    pre, model = SEL.fit_final(ts, name, params)
    ts.release()
    return SEL.predict(pre, model, s.where(F.col("split") == "test"), ts).withColumn("model", F.lit(name))


def _register_train(qname, name, task, params=None):
    @query(qname)
    def q(spark, sf_dir):
        return _train_predict(spark, sf_dir, name, task, params)
    q.__name__ = f"q_{qname}"
    return q


_register_train("train_logreg", "Logistic Regression", "classification")
_register_train("train_rf_cls", "Random Forest", "classification")
_register_train("train_rf_reg", "Random Forest Regressor", "regression")
_register_train("train_dt_cls", "Decision Tree", "classification")
_register_train("train_dt_reg", "Decision Tree Regressor", "regression")
_register_train("train_svc", "SVM", "classification")
_register_train("train_svc_poly", "SVM", "classification", {"C": 1.0, "kernel": "poly", "gamma": "scale"})
_register_train("train_huber", "SVR", "regression")
_register_train("train_gbt_cls", "Level-wise Boosting", "classification")
_register_train("train_gbt_reg", "Level-wise Boosting Regressor", "regression")


@query("train_linreg", sql="""SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope,
  round(regr_intercept(p_retailprice, p_size), 6) AS intercept, count(*) AS n_rows FROM part""")
def q_train_linreg(spark, sf_dir):
    """Ordinary least squares (normal equations, no regularisation) on one feature."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    va = VectorAssembler(inputCols=["x"], outputCol="features")
    m = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0, solver="normal").fit(va.transform(p))
    n = m.summary.numInstances
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept), int(n))],
                                 "slope double, intercept double, n_rows long") \
        .select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n_rows")


@query("cv_linreg", sql="""WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey % 5 AS fold FROM lineitem),
m AS (SELECT f.fold, regr_slope(p.y, p.x) AS b, regr_intercept(p.y, p.x) AS a FROM (SELECT DISTINCT fold FROM p) f JOIN p ON p.fold <> f.fold GROUP BY f.fold)
SELECT p.fold, count(*) AS n_rows, round(any_value(b), 6) AS slope,
  round(1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)), 6) AS r2 FROM p JOIN m USING (fold) GROUP BY p.fold""")
def q_cv_linreg(spark, sf_dir):
    """Cross-validated least squares of price on quantity from one scan: a fold's Gram
    statistics are taken off the total, the rest solved, and the fold scored from its own."""
    li = read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_orderkey") % 5).alias("fold"))
    grams = gram(li, ["l_quantity"], "l_extendedprice", "fold")
    scores, whole = gram_cross_validate(grams), total(grams)
    rows = [(f, int(g.n), float((whole - g).solve()[0][0]), float(scores[f])) for f, g in grams.items()]
    return spark.createDataFrame(rows, "fold long, n_rows long, slope double, r2 double").select(
        "fold", "n_rows", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query("model_compare")
def q_model_compare(spark, sf_dir):
    """All seven candidates of the reference, at full size: four learners and three boosters."""
    s, ts = doc_trainset(spark, sf_dir)
    board = SEL.compare_models(ts, "f1_weighted")
    ts.release()
    return board


def _trials(spark, r):
    """A row per point of a search; a point without a score is an error, not a row."""
    if failed := [err for _, sc, err in r.trials if sc is None]:
        raise RuntimeError(f"{len(failed)} of {len(r.trials)} points have no score: {failed[0]}")
    rows = [(r.strategy, json.dumps(m, sort_keys=True), sc, m == r.best_params) for m, sc, _ in r.trials]
    return spark.createDataFrame(rows, "strategy string, params string, mean_score double, best boolean")


@query("tune_grid")
def q_tune_grid(spark, sf_dir):
    s, ts = doc_trainset(spark, sf_dir)
    r = SEL.tune(ts, "Logistic Regression", "f1_weighted")
    ts.release()
    return _trials(spark, r)


@query("tune_random")
def q_tune_random(spark, sf_dir):
    """12 of the 24 points of the forest's space on document quality.  Points that differ in
    trees and depth only share a fit: three chains of up to 400 trees a fold, not twelve forests."""
    s, ts = doc_trainset(spark, sf_dir)
    r = SEL.tune(ts, "Random Forest", "f1_weighted")
    ts.release()
    return _trials(spark, r)


@query("tune_tree")
def q_tune_tree(spark, sf_dir):
    """The regression tree's whole grid on part prices, scored from three deep trees a fold."""
    s, ts = part_trainset(spark, sf_dir)
    r = SEL.tune(ts, "Decision Tree Regressor", "r2")
    ts.release()
    return _trials(spark, r)


@query("tune_svc")
def q_tune_svc(spark, sf_dir):
    """The support-vector space on document quality: penalties, kernels and widths, 12 points."""
    s, ts = doc_trainset(spark, sf_dir)
    r = SEL.tune(ts, "SVM", "f1_weighted")
    ts.release()
    return _trials(spark, r)


@query("predict_batch")
def q_predict_batch(spark, sf_dir):
    """H1: tuned champion -> (key, actual, prediction, score) on the hold-out rows."""
    s, ts = doc_trainset(spark, sf_dir)
    r = SEL.tune(ts, "Logistic Regression", "f1_weighted")
    ts.release()
    return SEL.predict(r.preprocessor, r.model, s.where(F.col("split") == "test"), ts)


@query("automl_run")
def q_automl_run(spark, sf_dir):
    """The whole supervised run on document quality (target inferred as the last column):
    its tables and model are stored, its row is appended to a registry and read back."""
    from ..sources.registry import read_runs, work_dir
    from .automl import automl_run
    d = doc_quality(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "quality")
    base = work_dir(spark, f"automl-{uuid.uuid4().hex[:10]}")
    automl_run(spark, d, "doc_id", "doc_quality", registry_path=f"{base}/registry", output_path=f"{base}/run")
    return read_runs(spark, f"{base}/registry")
