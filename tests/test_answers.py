"""Answers that were once wrong, each against a hand-made case."""
import random

import pytest
from pyspark.sql import functions as F

from tabwright.functions.hashing import fingerprint
from tabwright.operators import metrics as M
from tabwright.operators import models as MO
from tabwright.operators import select as SEL
from tabwright.operators import split as S
from tabwright.operators.clean import clean
from tabwright.operators.profile import duplicate_patterns, catalog_of, duplicate_counts
from tabwright.sources import csv as CSV
from tabwright.sources import sinks as SK
from tabwright.sources.registry import work_dir


def test_row_keys_pass_through_cleaning(spark):
    ids = [*range(1, 101), *range(10 ** 9, 10 ** 9 + 20)]
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in ids], "id long, x double, y int")
    out = clean(df, "y", keys=["id"]).data
    assert dict(out.dtypes)["id"] == "bigint"
    assert sorted(r.id for r in out.collect()) == ids


def signature(spark, rows, ddl="a string, b string"):
    return fingerprint(spark.createDataFrame(rows, ddl)).first().dataset_signature


def test_fingerprint_tells_tables_apart(spark):
    different = [[(None, "x")], [("x", None)], [("x", "")], [("", "x")], [("a|b", "c")], [("a", "b|c")], [("n", "n")], [(None, None)], [("1:x", "")]]
    assert len({signature(spark, t) for t in different}) == len(different)
    floats = [1.0000001, 1.0000004, 2e14, 3e14, 0.1, -0.1, float("inf"), float("nan"), None]
    assert len({signature(spark, [(x,)], "a double") for x in floats}) == len(floats)
    rows = [(str(i), str(i * i)) for i in range(50)]
    assert signature(spark, rows) == signature(spark, random.Random(1).sample(rows, 50))
    assert signature(spark, rows) != signature(spark, rows[:-1]) != signature(spark, rows[:-1] + rows[:1])


def test_stratified_split_takes_80_of_399(spark):
    labels = ["a"] * 101 + ["b"] * 97 + ["c"] * 201
    df = spark.createDataFrame(list(enumerate(labels)), "id long, y string")
    got = S.split_stratified(df, "id", "y").where("split = 'test'").groupBy("y").count().collect()
    assert sum(r["count"] for r in got) == 80
    for r in got:
        assert abs(r["count"] - 80 * labels.count(r.y) / 399) < 1


def test_stratified_folds_are_balanced_overall(spark):
    labels = sum(([c] * n for c, n in zip("abcdefg", (6, 11, 16, 21, 7, 8, 31))), [])
    df = spark.createDataFrame([(i, c if c != "g" else None) for i, c in enumerate(labels)], "id long, y string")
    got = S.fold_stratified(df, "id", "y", 5).toPandas()
    assert len(got) == 100 and set(got.groupby("fold").size()) == {20}
    assert (got.groupby(["y", "fold"], dropna=False).size().unstack(fill_value=0).apply(lambda r: r.max() - r.min(), axis=1) <= 1).all()


def test_regression_comparison_always_has_five_folds():
    assert S.choose_folds("regression", 12, None) == (5, False)
    assert S.choose_folds("regression", 12, None, tuning=True) == (3, False)
    assert S.choose_folds("classification", 12, 1) == (3, False)


def test_null_classes_are_counted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), (None, None)], "label string, prediction string")
    cm = {(r.actual, r.predicted): r.n for r in M.confusion(df).collect()}
    assert sum(cm.values()) == 4 and cm[None, None] == 1 and cm["a", None] == 1 and cm["b", "b"] == 0 and len(cm) == 9
    assert M.accuracy(df).first().accuracy == 0.5
    per = {r["class"]: (r.tp, r.n_pred, r.n_actual) for r in M.per_class(df).collect()}
    assert per == {"a": (1, 1, 2), "b": (0, 1, 0), None: (1, 2, 2)}


def test_csv_keeps_quoted_line_breaks_and_quotes(spark):
    path = work_dir(spark, f"csv-{random.random()}")
    rows = [(1, 'said "no",\nthen left', 2.5), (2, "plain", 3.5)]
    SK.write_table(spark.createDataFrame(rows, "k long, note string, x double"), path, fmt="csv")
    got = CSV.read_csv(spark, path)
    assert dict(got.dtypes) == {"k": "bigint", "note": "string", "x": "double"}
    assert sorted(map(tuple, got.collect())) == rows


def test_one_label_row_for_every_table(spark):
    tables = {"dup": spark.createDataFrame([("x",), ("x",)], "v string"), "ids": spark.createDataFrame([(1, 2)], "user_id int, id int"),
              "none": spark.createDataFrame([(1,)], "v int")}
    got = {r.table_name: (r.id_columns, r.duplicate_patterns) for r in duplicate_patterns(catalog_of(spark, tables), duplicate_counts(tables)).collect()}
    assert got == {"dup": ("", "Exact duplicate rows detected"), "ids": ("user_id,id", "Identifier-like columns present"), "none": ("", "")}


@pytest.fixture(scope="module")
def trainset(spark):
    rows = [(i, float(i % 10), "uv"[i % 2], "yes" if (i % 10) + (i % 3) > 6 else "no") for i in range(120)]
    return SEL.prepare(spark.createDataFrame(rows, "id long, x double, c string, y string"), "id", "y", "classification", ["x"], ["c"])


def test_saved_model_names_classes(spark, trainset):
    pre, model = SEL.fit_final(trainset, "Logistic Regression", None)
    path = work_dir(spark, f"model-{random.random()}")
    SK.save_model(pre.model, model, path, trainset.labels)
    got = SK.load_model(path).transform(trainset.df).select("id", "predicted").collect()
    want = SEL.predict(pre, model, trainset.df, trainset).collect()
    assert sorted(map(tuple, got)) == sorted((r.id, r.prediction) for r in want) and {r.predicted for r in got} == {"yes", "no"}


def test_a_failed_comparison_falls_back_to_a_forest(trainset, monkeypatch):
    monkeypatch.setattr(MO, "FOREST_TREES", 5)
    got = SEL.compare_models(trainset, "accuracy", names=["No Such Learner"]).collect()
    assert [(r.model, r.fit_status.split(":")[0], r["rank"]) for r in got] == [("No Such Learner", "failed", None), ("Random Forest", "fallback", 1)]


def test_a_failed_fallback_is_reported(trainset, monkeypatch):
    monkeypatch.setattr(SEL, "make_estimator", lambda *a, **k: 1 / 0)
    got = SEL.compare_models(trainset, "accuracy", names=["Decision Tree"]).collect()
    assert [r.fit_status.split(":")[0] for r in got] == ["failed", "failed"] and all(r["rank"] is None for r in got)


def test_search_strategy_follows_the_reference_count():
    want = {"Logistic Regression": ("grid_search", 3), "SVM": ("grid_search", 12), "Decision Tree": ("grid_search", 12), "SVR": ("grid_search", 12),
            "Linear Regression": ("none", 0)}
    for name, (strategy, n) in want.items():
        got = MO.search_space(name)
        assert (got[0], len(got[1])) == (strategy, n)
    for name, total in (("Random Forest", 24), ("Random Forest Regressor", 24), ("Level-wise Boosting", 243), ("Leaf-wise Boosting", 81), ("Symmetric Boosting Regressor", 27)):
        strategy, maps = MO.search_space(name)
        assert strategy == "random_search" and 1 <= len(maps) <= 12 and len(MO.combinations(name)) == total


def test_learners_have_the_reference_sizes():
    assert MO.make_estimator("Random Forest", 100).getNumTrees() == 300 and MO.make_estimator("Random Forest", 100).getMaxDepth() == 30
    assert MO.make_estimator("Logistic Regression", 100).getMaxIter() == 3000
    assert [MO.make_estimator(f"{b} Regressor", 100).getMaxIter() for b in MO.BOOSTERS] == [250] * 3
    assert MO.candidates("classification")[4:] == list(MO.BOOSTERS)
