"""Compression classifier: sizes by hand, odd rows, held-out accuracy, bounds of training."""

import random

import numpy as np
import pytest
import zstandard

from tabwright.llm import compress_quality as Q

from . import data

GOOD = "the house of water was near a quiet road and they walked along it with some friends before noon".split()
BAD = "buy### now$$$ click%%% here&&& free*** win### cash$$$ offer%%% deal&&& spam***".split()


def _corpus(spark, n=240):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        rows.append((i, " ".join(rnd.choice(GOOD if good else BAD) for _ in range(rnd.randint(20, 200))), "en", "a"))
        labels.append((i, int(good)))
    return data.docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = _corpus(spark)
    return Q.train(docs.where("doc_id < 160"), labels.where("doc_id < 160"))


def test_held_out(spark, model):
    docs, labels = _corpus(spark)
    got = Q.score(docs.where("doc_id >= 160"), model).join(labels, "doc_id").collect()
    assert len(got) == 80 and all(r.predicted == r.quality for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_scores_are_those_of_whole_texts(spark, model):
    rows = data.odd_rows(3)
    got = Q.score(data.docs(spark, rows), model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {}
    for i, t, _, _ in rows:
        b = (t or "").encode()
        sizes = []
        for d in model["dictionaries"]:
            c = zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                         write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(b[k:k + Q.BLOCK])) for k in range(0, len(b), Q.BLOCK)))
        x = (sizes[1] - sizes[0] + Q.SHRINK * model["mean"]) / (len(b) + Q.SHRINK)
        by.setdefault((i, len(b)), 1 / (1 + np.exp(-(x * model["slope"] + model["intercept"]))))
    for r in got:
        assert any(k[0] == r.doc_id and k[1] == r.n_bytes and abs(r.score - p) < 1e-6 for k, p in by.items())


def test_empty_and_null_texts_score_alike(spark, model):
    got = {r.doc_id: r.score for r in Q.score(data.docs(spark, [(1, None, None, None), (2, "", None, None)]), model).collect()}
    assert got[1] == got[2] and 0 <= got[1] <= 1


def test_odd_labels(spark):
    docs, _ = _corpus(spark, 40)
    labels = [(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (99999, 1)]
    m = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert m["dictionaries"] == [] and all(r.score > 0.999 for r in Q.score(docs, m).collect())   # only label 1 is left
    none = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.where("false"), m).count() == 0
    few = Q.train(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))      # one of each: the shares
    assert {r.score for r in Q.score(docs, few).collect()} == {0.5}


def test_repeated_rows_teach_once(spark):
    docs, labels = _corpus(spark, 80)
    one, two = Q.train(docs, labels), Q.train(docs.union(docs), labels.union(labels))
    assert one == two


def test_training_is_bounded(spark):
    docs, labels = _corpus(spark)
    m = Q.train(docs, labels, dictionary_docs=10, calibration_docs=10)
    assert all(len(d) <= Q.DICTIONARY_BYTES for d in m["dictionaries"])
    assert len(Q.pieces_of("x" * 10_000_000)) <= Q.PIECES and Q.pieces_of("") == [b""]


def test_curve():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=4000)
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(2 * x + 1)))).astype(float)
    slope, intercept = Q.fit_curve(x, y, np.ones(4000))
    assert abs(slope - 2) < 0.2 and abs(intercept - 1) < 0.15
    slope, intercept = Q.fit_curve(np.array([0.0, 0.1, 0.9, 1.0]), np.array([0, 0, 1, 1.0]), np.ones(4))    # separable
    assert np.isfinite([slope, intercept]).all() and slope > 0
