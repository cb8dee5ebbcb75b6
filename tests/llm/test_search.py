"""Lexical search against scoring every document."""

import math
import re

import pytest

from tabwright.llm import lexical_search as S

from . import data

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(t):
    return TERM.findall((t or "").translate(data.LOWER))


def brute(docs, items, top=10):
    held = [(i, _terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        ask, found = set(_terms(text)), []
        for i, t in held:
            m = 10 + (90 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10 ** 9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in ask if x in t)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return out


def _key(r):
    return tuple((x is None, x or 0) for x in r)


def _got(spark, docs, items, **kw):
    d = data.docs(spark, [(i, t, "en", "a") for i, t in docs])
    q = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, rank int, score long, doc_id long")
    return sorted((tuple(r) for r in S.search(d, q, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=_key)


@pytest.fixture(scope="module")
def docs():
    return [(r[0], r[1]) for r in data.odd_rows(5, 90)]


ITEMS = [(1, "the House of water"), (2, "ZÜRICH Zürich straße été"), (3, None), (4, ""), (5, "nothing_here xyzzy"), (6, "one two changed 12 a b the of und"),
         (None, "water water WATER"), (7, "the the the"), (1, "maison x1"), (8, "!!! ..."), (9, "full don't go")]


def test_brute_force(spark, docs):
    assert _got(spark, docs, ITEMS) == sorted(brute(docs, ITEMS), key=_key)


@pytest.mark.parametrize("postings,window,batch,short", [(40, 1, 1, 0.0), (200, 4, 2, 0.3), (10 ** 6, 8, 1, 1.0)])
def test_every_way_through_a_segment(docs, postings, window, batch, short, monkeypatch):
    """Small segments and windows, no short lists, short lists only: the same answers."""
    import numpy as np
    monkeypatch.setattr(S, "WINDOW", window)
    monkeypatch.setattr(S, "BATCH_WINDOWS", batch)
    monkeypatch.setattr(S, "SHORT", short)
    held = [(i if i is not None else S.NO_ID, S.terms(t)) for i, t in docs if S.terms(t)]
    vocabulary = sorted({x for _, t in held for x in t})
    number = {x: k for k, x in enumerate(vocabulary)}
    df = [sum(x in t for _, t in held) for x in vocabulary]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df])
    items = [(k, t) for k, (_, t) in enumerate(ITEMS)]
    best, lot, size = {k: [] for k, _ in items}, [], 0

    def close():
        counts = [sorted((number[x], t.count(x)) for x in set(t)) for _, t in lot]
        seg = S.Segment(np.array([i for i, _ in lot]), np.array([len(t) for _, t in lot]), np.array([len(c) for c in counts]),
                        np.array([p for c in counts for p, _ in c]), np.array([f for c in counts for _, f in c]), weight, n_docs, n_terms)
        for k, t in items:
            best[k] = seg.search(np.array([number[x] for x in set(S.terms(t)) if x in number], np.int64), best[k], 10)

    for row in held:
        lot.append(row)
        size += len(set(row[1]))
        if size >= postings:
            close()
            lot, size = [], 0
    if lot:
        close()
    got = [(k, r + 1, None if d == S.NO_ID else d, -s) for k, found in best.items() for r, (s, d) in enumerate(found)]
    assert sorted(got, key=_key) == sorted(brute(docs, items), key=_key)


def test_equal_scores_and_repeated_ids(spark):
    same = [(i, "red green blue") for i in (9, 3, 3, 5, None, 1, 8, 7, 6, 2, 4, 12, 11, 10)] + [(20, "other words only")] * 30
    got = _got(spark, same, [(1, "green")])
    assert [r[2] for r in got] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 9] and len({r[3] for r in got}) == 1


def test_blocks_of_queries(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 30)
    assert _got(spark, docs, ITEMS) == sorted(brute(docs, ITEMS), key=_key)


def test_empty_tables(spark, docs):
    assert _got(spark, docs, []) == [] and _got(spark, [], ITEMS) == [] and _got(spark, [(1, None), (2, "!!")], ITEMS) == []


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + " A_b-C9 don't ÀÉ x　y \U0001F600z"
    assert [t.decode() for t in S.terms(text)] == _terms(text)
