"""Golden facts of the reference's published sample run, on a 30-row table of
the same schema with our own rows."""
import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators import profile as P
from tabwright.operators import rank as R
from tabwright.operators.clean import clean


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(7)
    edu = ["Bachelor", "Master", "PhD"]
    dep = ["Sales", "Engineering", "Support", "Marketing", "Executive"]
    city = ["Austin", "Dallas", "Seattle", "Denver", "Chicago", "Boston", "New York"]
    rows = []
    for i in range(30):
        t = 1 if i < 12 else 0
        rows.append((25 + i, 48000 + 2000 * i + (i % 3) * 50, 2 + (i * 7) % 24, edu[i % 3], dep[i % 5], city[i % 7],
                     10 + (i * 11) % 31, t))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "age int, income int, years_experience int, education_level string, "
                                       "department string, city string, training_hours int, target int")


def test_profile_golden(spark, sample):
    tables = {"sample": sample}
    p = P.profile_lake(spark, tables)
    assert p.target_map["sample"] == "target"
    tp = p.target_profile().collect()[0]
    assert tp.task_type == "classification"
    roles = {r["column_name"]: r["role"] for r in P.column_roles(p.catalog, p.targets).collect()}
    assert sum(v == "numeric" for v in roles.values()) == 4
    assert sum(v == "categorical" for v in roles.values()) == 3
    t = p.table_profile().collect()[0]
    assert t["quality_score"] == 100
    assert t["risk_score"] == 9.5
    assert t["risk_quality"] == 97.0
    assert t["n_duplicates"] == 0
    dom = P.domain_tags(p.catalog, p.targets).collect()[0]
    assert (dom["business_domain"], dom["industry"]) == ("time_series", "operations")
    flags = P.name_flags(p.catalog).collect()
    assert [r["column_name"] for r in flags if r["sensitive"]] == ["income"]
    assert not any(r["pii"] for r in flags)
    dist = {r["value"]: r["n"] for r in p.counts.collect()}
    assert dist == {"0": 18, "1": 12}


def test_clean_golden(sample):
    res = clean(sample, "target")
    counts = {(r["column_name"], r["metric"]): r["value"] for r in res.report.collect()}
    assert counts[("*", "duplicates_removed")] == 0
    assert sum(v for (c, m), v in counts.items() if m == "outliers_clipped") == 0
    assert res.data.count() == 30


def test_vote_golden(spark):
    ballots = spark.createDataFrame([(1, "LR", 3, 0.99), (2, "SVM", 2, 0.99), (3, "RF", 1, 0.96)],
                                    "rank int, candidate string, vote int, confidence double")
    r = R.weighted_vote(ballots).collect()[0]
    assert (r["winner"], r["confidence"]) == ("LR", 0.495)


def test_champion_first_of_ties(spark):
    scores = spark.createDataFrame([(0, "LR", f, 1.0) for f in range(5)] + [(1, "SVM", f, 1.0) for f in range(5)] +
                                   [(2, "RF", f, 0.96) for f in range(5)] + [(3, "DT", f, 0.96) for f in range(5)],
                                   "candidate_no int, model string, fold int, score double")
    board = R.leaderboard(scores)
    assert R.champion(board).collect()[0]["champion"] == "LR"
    ranks = {r["model"]: r["rank"] for r in board.collect()}
    assert ranks == {"LR": 1, "SVM": 2, "RF": 3, "DT": 4}
