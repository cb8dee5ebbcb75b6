"""Candidate learners (G1-G6) and their search spaces (G12) on Spark ML.

Every learner has the reference's size (trees, rounds, iterations).  Mapping:
logistic regression with L2 ``C`` -> ``regParam = 1 / (C * n)``; unbounded
depth -> Spark's maximum 30; support-vector classifier -> random kernel map
(``kernels``, radial unless told otherwise) before a linear margin ``LinearSVC``
(``OneVsRest`` for more than two classes); support-vector regressor -> the same
map before a Huber linear fit; the three boosters -> ``GBTClassifier`` /
``GBTRegressor`` (binary only, so ``OneVsRest`` for multiclass), one grown by
levels, one by leaves (31 leaves -> depth 5) and one of symmetric trees.
"""

from __future__ import annotations

import math
import random
from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

from ..options import DEFAULT, Options
from .forests import LOT_ROWS, LOT_TREES
from .grown import GrownBoostedClassifier, GrownBoostedRegressor, GrownForestClassifier, GrownForestRegressor, GrownLotForest
from .kernels import KernelMap

MAX_DEPTH = 30  # Spark's limit; stands for "unbounded" (None)

# --- fixed values: candidates, sizes and search spaces of the reference ---
CLASSIFIERS = ("Logistic Regression", "Random Forest", "SVM", "Decision Tree")
REGRESSORS = ("Linear Regression", "Random Forest Regressor", "SVR", "Decision Tree Regressor")
LOGISTIC_ITERATIONS = 3000
FOREST_TREES = 300
BOOSTER_ROUNDS = 250
BOOSTER_STEP = 0.08
BOOSTER_DEPTH = 6
BOOSTER_LEAVES = 31
BOOSTER_SAMPLE = 0.85
SPACES = {
    "Logistic Regression": {"C": [0.1, 1.0, 10.0], "solver": ["lbfgs", "saga"]},
    "Random Forest": {"n_estimators": [200, 400], "max_depth": [None, 10, 20], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]},
    "SVM": {"C": [0.5, 1.0, 2.0], "gamma": ["scale", "auto"], "kernel": ["rbf", "poly"]},
    "Decision Tree": {"max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10]},
    "Level-wise Boosting": {"n_estimators": [150, 250, 350], "max_depth": [4, 6, 8], "learning_rate": [0.03, 0.05, 0.1],
                            "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0]},
    "Leaf-wise Boosting": {"n_estimators": [150, 250, 350], "learning_rate": [0.03, 0.05, 0.1], "num_leaves": [15, 31, 63], "max_depth": [-1, 10, 20]},
    "Symmetric Boosting": {"iterations": [150, 250, 350], "depth": [4, 6, 8], "learning_rate": [0.03, 0.05, 0.1]},
    "Linear Regression": {},
}
MAX_GRID = 20
# --- end of fixed values ---

BOOSTERS = ("Level-wise Boosting", "Leaf-wise Boosting", "Symmetric Boosting")
SVM_ITERATIONS = 1000
#: Rows from which forests and boosted chains are grown on binned rows (``grown``), not by Spark's jobs.
FOREST_ROWS = 1_000
BOOSTED_ROWS = 2_000


def family(name: str) -> str:
    """The candidate's name in ``SPACES`` (regressors share their classifier's space)."""
    if name == "SVR":
        return "SVM"
    return name if name in SPACES else name.removesuffix(" Regressor")


def make_estimator(name: str, n_train: int, n_classes: int = 2, options: Options = DEFAULT, params: dict | None = None,
                   features: str = "features", label: str = "label_idx", boosted_rows: int = BOOSTED_ROWS):
    """A Spark ML estimator for a candidate name with the reference defaults, overridden by ``params``."""
    p = dict(params or {})
    n = max(1, n_train)
    seed = options.seed
    cols = dict(featuresCol=features, labelCol=label)
    regressor = name.endswith("Regressor")
    kind = family(name)
    if name == "Linear Regression":
        return LinearRegression(**cols, regParam=0.0, solver="normal", **p)
    if kind == "Logistic Regression":
        c = p.pop("C", 1.0)
        return LogisticRegression(**cols, maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / (c * n), elasticNetParam=0.0,
                                  standardization=False, tol=1e-4, **p)
    if kind == "Random Forest":
        kw = dict(numTrees=FOREST_TREES, maxDepth=MAX_DEPTH, featureSubsetStrategy="all" if regressor else "sqrt", seed=seed) | p
        if not regressor:
            return (GrownForestClassifier if n >= FOREST_ROWS else RandomForestClassifier)(**cols, **kw)
        if n >= LOT_ROWS and kw["numTrees"] > LOT_TREES:
            return GrownLotForest(RandomForestRegressor(**cols, **kw))
        return (GrownForestRegressor if n >= FOREST_ROWS else RandomForestRegressor)(**cols, **kw)
    if kind == "Decision Tree":
        return (DecisionTreeRegressor if regressor else DecisionTreeClassifier)(**cols, **(dict(maxDepth=MAX_DEPTH, seed=seed) | p))
    if kind == "SVM":
        c, mapped = p.pop("C", 1.0), "kernel_features"
        to_kernel = KernelMap(inputCol=features, outputCol=mapped, kernel=p.pop("kernel", "rbf"), gamma=p.pop("gamma", "scale"), seed=seed)
        cols = dict(featuresCol=mapped, labelCol=label)
        fit = dict(regParam=1.0 / (c * n), maxIter=SVM_ITERATIONS, tol=1e-4) | p
        if name == "SVR":
            return Pipeline(stages=[to_kernel, LinearRegression(**cols, loss="huber", elasticNetParam=0.0, **fit)])
        svc = LinearSVC(**cols, standardization=False, **fit)
        return Pipeline(stages=[to_kernel, svc if n_classes <= 2 else OneVsRest(classifier=svc, **cols)])
    if kind in BOOSTERS:
        kw = dict(maxIter=BOOSTER_ROUNDS, stepSize=BOOSTER_STEP, maxDepth=BOOSTER_DEPTH, seed=seed, cacheNodeIds=True)
        if kind == "Level-wise Boosting":
            kw |= dict(subsamplingRate=BOOSTER_SAMPLE, featureSubsetStrategy=str(BOOSTER_SAMPLE))
        if kind == "Leaf-wise Boosting":
            kw |= dict(maxDepth=leaf_depth(BOOSTER_LEAVES))
        kw |= p
        if regressor:
            return (GrownBoostedRegressor if n >= boosted_rows else GBTRegressor)(**cols, **kw)
        gbt = (GrownBoostedClassifier if n >= boosted_rows else GBTClassifier)(**cols, **kw)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt, **cols)
    raise ValueError(f"unknown candidate {name}")


def leaf_depth(leaves: int) -> int:
    """Depth of a level-wise tree with room for so many leaves."""
    return math.ceil(math.log2(leaves + 1))


def candidates(task_type: str, include_boosters: bool = True) -> list[str]:
    """Reference order; the boosters take part unless left out explicitly."""
    if task_type == "classification":
        return [*CLASSIFIERS, *(BOOSTERS if include_boosters else ())]
    return [*REGRESSORS, *(f"{b} Regressor" for b in BOOSTERS if include_boosters)]


def fallback_candidate(task_type: str) -> str:
    return "Random Forest" if task_type == "classification" else "Random Forest Regressor"


def combinations(name: str) -> list[dict]:
    """All points of the reference's search space, in its own terms."""
    space = SPACES[family(name)]
    return [dict(zip(space, vals)) for vals in product(*space.values())] if space else []


def to_spark(name: str, point: dict) -> dict:
    """A point in Spark's terms.  ``solver`` has no counterpart; a minimum of s rows to split a node becomes ceil(s / 2) rows a child."""
    kind = family(name)
    if kind == "SVM":
        return dict(point)
    if kind == "Logistic Regression":
        return {"C": point["C"]}
    if kind in ("Random Forest", "Decision Tree"):
        out = {"maxDepth": point["max_depth"] or MAX_DEPTH,
               "minInstancesPerNode": max(point.get("min_samples_leaf", 1), math.ceil(point["min_samples_split"] / 2))}
        return ({"numTrees": point["n_estimators"]} if kind == "Random Forest" else {}) | out
    out = {"maxIter": point.get("n_estimators", point.get("iterations")), "stepSize": point["learning_rate"]}
    if kind == "Leaf-wise Boosting":
        bound = point["max_depth"] if point["max_depth"] > 0 else MAX_DEPTH
        return out | {"maxDepth": min(bound, leaf_depth(point["num_leaves"]))}
    out["maxDepth"] = point.get("max_depth", point.get("depth"))
    if kind == "Level-wise Boosting":
        out |= {"subsamplingRate": point["subsample"], "featureSubsetStrategy": str(point["colsample_bytree"])}
    return out


def chains(jobs: list[tuple[str, dict | None]], n_classes: int) -> list[tuple[str, dict | None, list[tuple[int, tuple[int, int] | None]]]]:
    """Jobs that one fit answers together: (name, parameters of the fit, [(job, (trees, depth))]).

    A tree grown deep holds the shallower ones, a forest's first trees are a forest and a
    boosted chain's first rounds the shorter chain (``trees``).  Other jobs, and those
    without a partner, come back alone, with None for the point."""
    groups: dict = {}
    for j, (name, params) in enumerate(jobs):
        kind, p = family(name), dict(params or {})
        if kind == "Random Forest" and "numTrees" in p:
            point = (p.pop("numTrees"), p.pop("maxDepth", MAX_DEPTH))
        elif kind == "Decision Tree" and "maxDepth" in p:
            point = (1, p.pop("maxDepth"))
        elif kind in BOOSTERS and "maxIter" in p and (name.endswith("Regressor") or n_classes <= 2):
            point = (p.pop("maxIter"), p.get("maxDepth", MAX_DEPTH))
        else:
            groups[j] = [(j, None)]
            continue
        groups.setdefault((name, tuple(sorted(p.items()))), []).append((j, point))
    out = []
    for members in groups.values():
        name, params = jobs[members[0][0]]
        if len(members) == 1:
            out.append((name, params, [(members[0][0], None)]))
            continue
        trees, depth = max(t for _, (t, _) in members), max(d for _, (_, d) in members)
        size = {"Random Forest": {"numTrees": trees, "maxDepth": depth}, "Decision Tree": {"maxDepth": depth}}.get(family(name), {"maxIter": trees})
        out.append((name, dict(params or {}) | size, members))
    return out


def search_space(name: str, options: Options = DEFAULT) -> tuple[str, list[dict]]:
    """(strategy, param maps).  The reference's own number of combinations decides: a grid
    up to 20 of them and not a booster, else ``min(max_tuning_iterations, total)``
    seeded samples.  Points that are one in Spark's terms are fitted once."""
    points = combinations(name)
    if not points:
        return "none", []
    strategy = "grid_search"
    if len(points) > MAX_GRID or family(name) in BOOSTERS:
        strategy = "random_search"
        points = random.Random(options.seed).sample(points, min(options.max_tuning_iterations, len(points)))
    maps: list[dict] = []
    for point in points:
        m = to_spark(name, point)
        if m not in maps:
            maps.append(m)
    return strategy, maps
