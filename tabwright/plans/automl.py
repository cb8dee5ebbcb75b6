"""End-to-end run: profile -> clean -> EDA -> split -> features -> compare ->
champion / vote -> tune -> evaluate -> explain -> gates -> registry.

The driver only holds statistics rows, candidate names and per-fit scores;
every data step is a Spark job.  The prepared training set is materialised
once (persist, or a reliable checkpoint in ``spark.checkpoint.dir`` with
``materialize="checkpoint"`` so an executor loss does not recompute the
cleaning lineage).
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..operators import eda as D
from ..operators import explain as X
from ..operators import governance as G
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import rank as R
from ..operators import select as SEL
from ..operators import trees as TR
from ..operators.clean import clean
from ..operators.features import select_features
from ..operators.split import min_class_count, sample_topn, split_random, split_stratified
from ..options import DEFAULT, Options
from ..sources import registry as REG
from ..sources import sinks as SK


@dataclass
class RunResult:
    """Tables of a run.  ``eda`` and ``explanation`` map names to small tables."""
    run: DataFrame
    leaderboard: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    importances: DataFrame
    clean_report: DataFrame
    confusion: DataFrame | None = None
    eda: dict = field(default_factory=dict)
    explanation: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)


def _small(df: DataFrame) -> DataFrame:
    """A small result computed now (one row per column, class or grid point), so that it outlives the run's caches."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _class_probabilities(scored: DataFrame, key: str, target: str, labels: list[str]) -> DataFrame:
    """(key, label, class, prob): one row per class and document."""
    p = vector_to_array("probability")
    entries = F.array(*[F.struct(F.lit(c).alias("class"), p[i].alias("prob")) for i, c in enumerate(labels)])
    return scored.select(key, F.col(target).cast("string").alias("label"), F.explode(entries).alias("e")).select(key, "label", "e.class", "e.prob")


def _explore(data: DataFrame, target: str, task: str, num: list[str], cat: list[str]) -> dict[str, DataFrame]:
    """D1-D5 on the cleaned rows."""
    out = {"correlation": _small(D.corr_long(data, num))}
    if num:
        out["numeric"] = _small(D.numeric_summary(data, num))
    if cat:
        out["cardinality"] = _small(D.cardinality(data, cat))
    out["target"] = _small(D.target_distribution(data, target) if task == "classification" else D.describe(data, target))
    return out


def _explain(spark, sample: DataFrame, key: str, target: str, task: str, tr, ts, num: list[str], cat: list[str], options: Options) -> tuple[list, dict]:
    """I1-I8 on a bounded sample of training rows (the reference explains 200)."""
    names, size = tr.preprocessor.feature_names, len(tr.preprocessor.feature_names)
    imps = [("native", n, v) for n, v in X.native_importance(tr.model, names)]
    out: dict = {}
    rows = tr.preprocessor.transform(sample).persist()

    def score_vectors(d):
        p = tr.model.transform(d)
        if task != "classification":
            return p.withColumn("_out", F.col("prediction"))
        return p.withColumn("_out", SEL.positive_score(p) if len(ts.labels) == 2 and ("probability" in p.columns or "rawPrediction" in p.columns) else F.col("prediction"))

    background = sample_topn(rows, key, options.background_rows, options)
    if TR.is_trees(tr.model):              # exact; of other models the sampled values
        shap = TR.shapley_importance(tr.model, rows, background, key, names)
    else:
        shap = X.shap_sampled(rows, background, key, "features", size, score_vectors, names, seed=options.seed)
    imps += [("shap", r["feature"], float(r["importance"])) for r in shap.collect()]

    def score_fn(frame, group):
        p = tr.model.transform(tr.preprocessor.transform(frame))
        if task == "classification":
            p = IndexToString(inputCol="prediction", outputCol="_pl", labels=ts.labels).transform(p)
            return p.groupBy(*group).agg(F.avg((F.col("_pl") == F.col(target).cast("string")).cast("double")).alias("score"))
        e = F.col(target).cast("double") - F.col("prediction")
        return p.groupBy(*group).agg((1 - F.sum(e * e) / (F.var_pop(F.col(target).cast("double")) * F.count(F.lit(1)))).alias("score"))

    if num + cat:
        perm = X.permutation_importance(sample, key, num + cat, score_fn, options.permutation_repeats, options.seed)
        imps += [("permutation", r["feature"], float(r["importance"])) for r in perm.collect()]
    if num:
        out["partial_dependence"] = _small(X.partial_dependence(sample, num, lambda d: tr.model.transform(tr.preprocessor.transform(d)), options.pdp_grid_points))
        out["correlation"] = _small(D.corr_long(sample, num))
    fitted = tr.model.transform(rows).select(key, "features", F.col("prediction").alias("_p"), F.col(target), "prediction")
    surrogate = X.surrogate_ridge(fitted.select("features", "_p"), "features", "_p")
    out["surrogate"] = spark.createDataFrame([*((n, float(c)) for n, c in zip(names, surrogate.coefficients.toArray())),
                                              ("intercept", float(surrogate.intercept))], "feature string, coefficient double")
    actual = F.col(target).cast("double") if task != "classification" else F.array_position(F.array(*map(F.lit, ts.labels)), F.col(target).cast("string")).cast("double") - 1
    out["errors"] = _small(X.error_table(fitted.select(key, actual.alias("actual"), "prediction"), key))
    rows.unpersist()
    return imps, out


def _store(path: str, data: DataFrame, result: dict[str, DataFrame], tr, labels: list[str]) -> None:
    """The run's tables as parquet and its model, under ``path``."""
    SK.write_table(data, f"{path}/cleaned")
    for name, df in result.items():
        SK.write_table(df, f"{path}/{name}")
    SK.save_model(tr.preprocessor.model, tr.model, f"{path}/model", labels)


def automl_run(spark: SparkSession, df: DataFrame, key: str, table_name: str = "dataset", options: Options = DEFAULT,
               registry_path: str | None = None, output_path: str | None = None, materialize: str = "persist", explain: bool = True,
               include_boosters: bool = False) -> RunResult:
    """The whole run.  ``include_boosters``: let the three boosters compete too (in the
    reference they do where their libraries are installed; its published runs have four
    candidates)."""
    timings, began, t0 = {}, time.time(), time.time()

    def lap(name):
        nonlocal t0
        timings[name] = round(time.time() - t0, 3)
        t0 = time.time()

    df = df.persist()                      # read by profile, cleaning and fingerprint
    prof = P.profile_lake(spark, {table_name: df}, options)
    target = prof.target_map[table_name]
    task = prof.target_profile().collect()[0]["task_type"]
    tprof = prof.table_profile().collect()[0]
    prof.release()
    sig = fingerprint(df).collect()[0]["dataset_signature"]
    lap("profile")

    cr = clean(df, target, options, materialize=materialize, keys=[key])
    data = cr.data
    eda = _explore(data, target, task, cr.plan.numeric, cr.plan.categorical)
    lap("clean_eda")

    # split + feature selection on training rows
    if task == "classification" and min_class_count(data, target) >= 2:
        split = split_stratified(data, key, target, options)
    else:
        split = split_random(data, key, options)
    split = split.persist()
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    sel = select_features(train.drop(key), target, options)
    num, cat = sel.numeric, sel.categorical
    lap("split_features")

    # scoring choice + comparison
    if task == "classification":
        counts = train.groupBy(target).count().where(F.col(target).isNotNull())
        mm = counts.agg((F.min("count") / F.sum("count")).alias("s")).collect()[0]["s"]
        scoring = "f1_weighted" if mm is not None and mm < options.minority_f1_ratio else "accuracy"
    else:
        scoring = "r2"
    ts = SEL.prepare(train, key, target, task, num, cat, options, materialize=materialize)
    board = SEL.compare_models(ts, scoring, options, include_boosters)
    board_rows = board.where(F.col("rank").isNotNull())
    champ = R.champion(board_rows).collect()[0]["champion"]
    vote = R.weighted_vote(R.ballots_from_board(board_rows)).collect()[0]
    lap("compare")

    tr = SEL.tune(ts, champ, scoring, options)
    lap("tune")

    pred = SEL.predict(tr.preprocessor, tr.model, test, ts).persist()
    confusion = None
    if task == "classification":
        prf = M.prf_weighted(pred, "actual", "prediction").collect()[0]
        acc = M.accuracy(pred, "actual", "prediction").collect()[0]["accuracy"]
        mets = {"accuracy": acc, "precision": prf["precision"], "recall": prf["recall"], "f1_score": prf["f1"]}
        confusion = _small(M.confusion(pred, "actual", "prediction"))
        if "score" in pred.columns:
            a = M.auc(pred, "actual", "score", positive=ts.labels[1]).collect()
            mets["roc_auc"] = a[0]["auc"] if a else None
        elif len(ts.labels) > 2:
            scored = tr.model.transform(tr.preprocessor.transform(test))
            if "probability" in scored.columns:
                mets["roc_auc"] = M.auc_ovr_weighted(_class_probabilities(scored, key, target, ts.labels)).collect()[0]["auc_ovr"]
    else:
        r = M.regression_metrics(pred, "actual", "prediction").collect()[0]
        mets = {"rmse": r["rmse"], "mae": r["mae"], "r2_score": r["r2"]}
    metrics = spark.createDataFrame([(k, float(v)) for k, v in mets.items() if v is not None], "metric string, value double")
    lap("evaluate")

    imps, explanation = ([], {})
    if explain:
        sample = sample_topn(train, key, options.explain_rows, options).persist()
        imps, explanation = _explain(spark, sample, key, target, task, tr, ts, num, cat, options)
        sample.unpersist()
    importances = spark.createDataFrame(imps or [], "kind string, feature string, importance double")
    kinds = sorted({k for k, _, _ in imps})
    n_top = X.importance_topk({k: importances.where(F.col("kind") == k) for k in kinds}).count() if kinds else 0
    lap("explain")

    primary = (mets.get("f1_score", mets.get("accuracy", 0.0)) if task == "classification" else mets.get("r2_score", 0.0))
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    run_id = f"exp_{now.strftime('%Y%m%dT%H%M%SZ')}_{sig[:8]}"
    if output_path:
        tables = {"leaderboard": board, "metrics": metrics, "predictions": pred, "importances": importances, "clean_report": cr.report,
                  **({"confusion": confusion} if confusion is not None else {}), **{f"eda_{k}": v for k, v in eda.items()},
                  **{f"explain_{k}": v for k, v in explanation.items()}}
        best = [(run_id, champ, f"{output_path}/model", json.dumps(tr.best_params, sort_keys=True), float(primary or 0.0), now)]
        tables["best_model"] = spark.createDataFrame(best, "run_id string, model string, path string, parameters string, primary_metric double, timestamp timestamp")
        _store(output_path, data, tables, tr, ts.labels)
        lap("store")

    row = [(run_id, table_name, sig, target, task, champ, vote["winner"], float(vote["confidence"]), scoring,
            tr.strategy, {k: str(v) for k, v in tr.best_params.items()},
            float(tr.best_score) if tr.best_score == tr.best_score else None,
            mets.get("f1_score"), mets.get("accuracy"), mets.get("r2_score"), float(primary or 0.0),
            float(tprof["risk_score"]), int(tprof["quality_score"]), int(n_top), output_path, round(time.time() - began, 3), now)]
    run = spark.createDataFrame(row, "run_id string, dataset string, dataset_signature string, target string, task_type string, "
                                     "winner string, vote_winner string, vote_confidence double, scoring string, "
                                     "search_strategy string, parameters map<string,string>, best_score double, "
                                     "f1_score double, accuracy double, r2_score double, primary_metric double, "
                                     "risk_score double, quality_score int, n_top_features int, output_path string, "
                                     "execution_seconds double, timestamp timestamp")
    run = run.join(G.run_gates(run), "run_id").join(G.run_recommendation(run), "run_id")
    run = run.withColumn("model_comparison", F.array(*[F.struct(F.lit(r["model"]).alias("name"),
                                                               F.lit(r["mean_score"]).cast("double").alias("mean_score"),
                                                               F.lit(r["std_score"]).cast("double").alias("std_score"),
                                                               F.lit(r["fit_status"]).alias("fit_status")) for r in board.collect()]))
    if registry_path:
        REG.append_runs(run, registry_path)
    predictions = pred if not output_path else SK.read_back(spark, f"{output_path}/predictions")
    for kept in (ts.df, split, cr.kept, df, *([pred] if output_path else [])):
        kept.unpersist()
    lap("finalize")
    return RunResult(run, board, metrics, predictions, importances, cr.report, confusion, eda, explanation, timings)
