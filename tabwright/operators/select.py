"""Cross-validated model comparison, tuning and batch prediction.

One physical training set carries a ``fold`` column (hash-ranked, see
``split``) and is kept once.  For every fold the preprocessor is refitted on
the other folds (as the reference refits it inside each CV split); the
assembled ``(features, label)`` frames of one fold at a time are kept, shared
by all candidates and released when their fits end.  Fits of a fold run on a
small driver thread pool; each is itself a distributed Spark job.  Scores come
back as one number per fit.  The prepared set is partitioned by AQE, the frames
that learners iterate over by what a fit makes of a row (``spread``): a row of a
few bytes becomes 4 kB as a kernel map or as a forest's counts.
"""

from __future__ import annotations

import math
import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark import StorageLevel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import DEFAULT, Options
from . import grown as GR
from .features import Preprocessor, fit_preprocessor
from .kernels import DIMS
from .models import candidates, chains, fallback_candidate, make_estimator, search_space
from .split import choose_folds, fold_assign, fold_stratified, min_class_count
from .trees import load, score_points


@dataclass
class TrainSet:
    df: DataFrame                  # key, features columns, target, label_idx, fold, fold_tune
    key: str
    target: str
    task_type: str
    numeric: list[str]
    categorical: list[str]
    labels: list[str] = field(default_factory=list)   # class names by index
    n: int = 0
    k: int = 5                     # folds of the comparison
    k_tune: int = 5                # folds of the search

    def release(self):
        self.df.unpersist()


def prepare(df: DataFrame, key: str, target: str, task_type: str, numeric: list[str], categorical: list[str],
            options: Options = DEFAULT, materialize: str = "persist") -> TrainSet:
    cols = [key, *numeric, *categorical, target]
    d = df.select(*cols).where(F.col(target).isNotNull())
    labels: list[str] = []
    if task_type == "classification":
        idx = StringIndexer(inputCol="_y", outputCol="label_idx", stringOrderType="alphabetAsc") \
            .fit(d.select(F.col(target).cast("string").alias("_y")))
        labels = list(idx.labels)
        d = idx.transform(d.withColumn("_y", F.col(target).cast("string"))).drop("_y")
        smallest = min_class_count(d, target)
    else:
        d = d.withColumn("label_idx", F.col(target).cast("double"))
        smallest = None
    n = d.count()
    k, strat = choose_folds(task_type, n, smallest, options)
    k_tune, _ = choose_folds(task_type, n, smallest, options, tuning=True)
    deal = (lambda x, folds: fold_stratified(x, key, target, folds, options)) if strat else (lambda x, folds: fold_assign(x, key, folds, options))
    d = deal(d, k)
    d = d.withColumn("fold_tune", F.col("fold")) if k_tune == k else deal(d.withColumnRenamed("fold", "_f"), k_tune).withColumnRenamed(
        "fold", "fold_tune").withColumnRenamed("_f", "fold")
    # iterative learners run a job per iteration over this layout: partitions of the
    # advisory size, not as many as there are cores (AQE decides either way)
    conf = d.sparkSession.conf
    wanted = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true"}
    before = {name: conf.get(name, None) for name in wanted}
    for name, v in wanted.items():
        conf.set(name, v)
    d = d.hint("rebalance")
    if materialize == "checkpoint":
        d = d.checkpoint(eager=True)          # reliable copy in spark.checkpoint.dir; survives executor loss
    else:
        d = d.persist(StorageLevel.MEMORY_AND_DISK)
        d.count()
    for name, v in before.items():
        conf.set(name, v) if v is not None else conf.unset(name)
    return TrainSet(d, key, target, task_type, numeric, categorical, labels, n, k, k_tune)


#: A task's part of a learner's frame: bytes as dense numbers at most, and rows that are worth a task
#: of their own, up to so many tasks.
TASK_BYTES = 64 << 20
TASK_ROWS = 2_000
TASKS = 24


def spread(frame: DataFrame, rows: int, features: int, names: set[str]) -> DataFrame:
    """``frame`` dealt evenly for learners.  The number of tasks depends on the rows and features
    only, not on the cluster, as a forest draws its rows by partition; small frames stay as they are.
    So do those of a regression forest alone: each task sends statistics of all features for every
    node of a level, which outgrow its rows."""
    if names == {"Random Forest Regressor"}:
        return frame
    held = rows * 8 * max(features, DIMS)
    parts = max(min(rows // TASK_ROWS, TASKS), math.ceil(held / TASK_BYTES))
    return frame.repartition(parts) if parts > 1 else frame


def cv_score(pred: DataFrame, task_type: str, scoring: str) -> float:
    """Fold score with Spark's evaluators (one job each): weightedFMeasure is the
    support-weighted F1 over true labels, the same definition as ``prf_weighted``."""
    if task_type == "regression":
        return float(RegressionEvaluator(labelCol="label_idx", predictionCol="prediction", metricName="r2").evaluate(pred))
    metric = "weightedFMeasure" if scoring == "f1_weighted" else "accuracy"
    return float(MulticlassClassificationEvaluator(labelCol="label_idx", predictionCol="prediction",
                                                   metricName=metric).evaluate(pred))


def cross_validate(ts: TrainSet, jobs: list[tuple[str, dict | None]], scoring: str, options: Options = DEFAULT, tuning: bool = False):
    """-> {job index: (fold scores | None, error)}; a job that fails in a fold is not tried in the next.

    Jobs that differ in trees, depth or rounds only are one fit a fold (``models.chains``),
    whose prefixes are scored from its node table in one pass.  A score that is no number is a
    failure.  Learners that grow their trees on binned rows share a fold's bins and are scored
    from their trees, without a Spark model; boosters of any size do so here."""
    k, column = (ts.k_tune, "fold_tune") if tuning else (ts.k, "fold")
    scores: dict[int, list] = {j: [] for j in range(len(jobs))}
    errors: dict[int, str] = {}
    spark, fits = ts.df.sparkSession, chains(jobs, max(2, len(ts.labels)))
    for f in range(k):
        tr, te = ts.df.where(F.col(column) != f), ts.df.where(F.col(column) == f)
        try:
            pre = fit_preprocessor(tr, ts.numeric, ts.categorical, options)
        except Exception as e:
            errors |= {j: repr(e)[:200] for j in scores if j not in errors}
            break
        trx, tex = (spread(pre.transform(x).select("features", "label_idx"), rows, len(pre.feature_names), {name for name, _ in jobs}).persist(StorageLevel.MEMORY_AND_DISK)
                    for x, rows in ((tr, ts.n - ts.n // k), (te, ts.n // k)))
        n_tr = trx.count()
        tex.count()
        lock, held = Lock(), []

        def binned():
            with lock:
                if not held:
                    held.append(GR.bin_rows(trx))
                return held[0]

        def run(chain):
            name, params, members = chain
            try:
                est = make_estimator(name, n_tr, max(2, len(ts.labels)), options, params, boosted_rows=0)
                if GR.grows(est) and binned():
                    got = score_points(GR.ensemble(est, binned()), tex, [p or GR.whole(est) for _, p in members], ts.task_type, scoring)
                elif members[0][1] is None:
                    got = [cv_score(est.fit(trx).transform(tex), ts.task_type, scoring)]
                else:
                    got = score_points(load(spark, est.fit(trx)), tex, [p for _, p in members], ts.task_type, scoring)
                if not all(map(math.isfinite, got)):
                    raise ValueError(f"a score is no number: {got}")
                for (j, _), score in zip(members, got):
                    scores[j].append(score)
            except Exception as e:  # a failing candidate is skipped (G8)
                errors.update({j: repr(e)[:200] for j, _ in members})

        with ThreadPoolExecutor(max_workers=max(1, options.cv_parallelism)) as pool:
            list(pool.map(run, [c for c in fits if c[2][0][0] not in errors]))
        if held and held[0]:
            held[0].release()
        trx.unpersist()
        tex.unpersist()
    return {j: (None, errors[j]) if j in errors else (scores[j], None) for j in scores}


LEADERBOARD_SCHEMA = ("candidate_no int, model string, fold_scores array<double>, mean_score double, "
                      "std_score double, fit_status string, rank int")


def compare_models(ts: TrainSet, scoring: str, options: Options = DEFAULT, include_boosters: bool = True,
                   names: list[str] | None = None) -> DataFrame:
    """Leaderboard (mean, population std, per-fold scores), failures skipped,
    random-forest fallback if nothing fitted, rank by mean desc then candidate order.

    If the fallback fails too, its row says so and no row has a rank."""
    names = names or candidates(ts.task_type, include_boosters)

    def row(j, name, result, status):
        scores, err = result
        if scores is None:
            return (j, name, None, None, None, f"failed: {err}")
        return (j, name, scores, statistics.fmean(scores), statistics.pstdev(scores), status)

    res = cross_validate(ts, [(n, None) for n in names], scoring, options)
    rows = [row(j, name, res[j], "ok") for j, name in enumerate(names)]
    if not any(r[5] == "ok" for r in rows):
        fb = fallback_candidate(ts.task_type)
        rows.append(row(len(rows), fb, cross_validate(ts, [(fb, None)], scoring, options)[0], "fallback"))
    ok = sorted([r for r in rows if r[3] is not None], key=lambda r: (-round(r[3], 12), r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(ok)}
    spark = ts.df.sparkSession
    return spark.createDataFrame([(*r, rank.get(r[0])) for r in rows], LEADERBOARD_SCHEMA)


@dataclass
class TuningResult:
    model: object
    preprocessor: Preprocessor
    best_params: dict
    best_score: float
    strategy: str
    trials: list


def fit_final(ts: TrainSet, name: str, params: dict | None, options: Options = DEFAULT):
    """Preprocessor + estimator refitted on all training rows."""
    pre = fit_preprocessor(ts.df, ts.numeric, ts.categorical, options)
    est = make_estimator(name, ts.n, max(2, len(ts.labels)), options, params)
    frame = spread(pre.transform(ts.df).select("features", "label_idx"), ts.n, len(pre.feature_names), {name}).persist(StorageLevel.MEMORY_AND_DISK)
    model = est.fit(frame)
    frame.unpersist()
    return pre, model


def tune(ts: TrainSet, name: str, scoring: str, options: Options = DEFAULT) -> TuningResult:
    """Grid (<=20 combos, not a booster) or seeded random search; best refitted.
    No grid (linear regression) -> plain fit with a NaN score."""
    strategy, maps = search_space(name, options)
    if not maps:
        pre, model = fit_final(ts, name, None, options)
        return TuningResult(model, pre, {}, float("nan"), "none", [])
    res = cross_validate(ts, [(name, m) for m in maps], scoring, options, tuning=True)
    trials = []
    for j, m in enumerate(maps):
        scores, err = res[j]
        trials.append((m, statistics.fmean(scores) if scores else None, err))
    good = [(i, t) for i, t in enumerate(trials) if t[1] is not None]
    if not good:
        raise RuntimeError(f"no point of the search could be fitted: {trials[0][2]}")
    bi, best = max(good, key=lambda it: (it[1][1], -it[0]))
    pre, model = fit_final(ts, name, best[0], options)
    return TuningResult(model, pre, dict(best[0]), best[1], strategy, trials)


def positive_score(pred: DataFrame) -> F.Column:
    """Score of the class with index 1: probability if present, else the raw margin."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def predict(pre: Preprocessor, model, df: DataFrame, ts: TrainSet, keep: list[str] | None = None) -> DataFrame:
    """H1: (key, actual, prediction[, score]) with class names restored (IndexToString)."""
    keep = keep or []
    out = model.transform(pre.transform(df))
    if ts.task_type == "classification":
        out = IndexToString(inputCol="prediction", outputCol="_pred", labels=ts.labels).transform(out)
        cols = [ts.key, *keep, F.col(ts.target).cast("string").alias("actual"), F.col("_pred").alias("prediction")]
        if len(ts.labels) == 2 and ("probability" in out.columns or "rawPrediction" in out.columns):
            cols.append(positive_score(out).cast("double").alias("score"))
        return out.select(*cols)
    return out.select(ts.key, *keep, F.col(ts.target).cast("double").alias("actual"), F.col("prediction").alias("prediction"))
