"""Spectrum slicing against a dense eigensolver; whitening against whole-number sums by hand."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tabwright.llm import spectrum, whitening


def _cases():
    rnd = np.random.default_rng(3)
    for d in (1, 2, 5, 24):
        q = np.linalg.qr(rnd.standard_normal((d, d)))[0]
        s = rnd.standard_normal((d, d))
        yield "random", s + s.T
        yield "repeated", q @ np.diag(np.round(rnd.random(d) * 3)) @ q.T
        yield "equal", 2.0 * np.eye(d)
        yield "zero", np.zeros((d, d))
        yield "decay", q @ np.diag(10.0 ** -np.arange(d)) @ q.T
        yield "close", np.diag(1 + 1e-9 * np.arange(d))
        w = rnd.standard_normal((2, d))
        yield "rank two", w.T @ w


@pytest.mark.parametrize("name,a", [pytest.param(n, a, id=f"{n}-{len(a)}") for n, a in _cases()])
def test_leading_pairs(name, a):
    values, vectors = spectrum.leading(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    size = max(1e-300, np.abs(a).sum(axis=1).max())
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_counts():
    rnd = np.random.default_rng(4)
    for d in range(1, 30):
        s = rnd.standard_normal((d, d))
        s = s + s.T
        for shift in rnd.standard_normal(3) * 3:
            assert spectrum.count_above(s, shift) == (np.linalg.eigvalsh(s) > shift).sum()


def _brute(rows, k):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(64 * c) < 2 ** 50 for c in v)]
    xs = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in good]
    kinds = {}
    for x in set(xs):
        kinds[len(x)] = kinds.get(len(x), 0) + 1
    d = max(kinds, key=lambda z: (kinds[z], z))
    fit = [x for x in set(xs) if len(x) == d]
    n = len(fit)
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(sum((x[i] - Fraction(s[i], n)) * (x[j] - Fraction(s[j], n)) for x in fit) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    some = e > 1e-9 * max(1.0, e.max())
    e, u = e[some], u[:, some]
    out = []
    for (i, _), x in zip(good, xs):
        if len(x) == d:
            w = np.array([float(x[j] - Fraction(s[j], n)) for j in range(d)]) @ u / np.sqrt(e)
            out += [(i, c + 1, n, sum((n * x[j] - s[j]) ** 2 for j in range(d)), w[c], e[c] / np.trace(v)) for c in range(len(e))]
    return out


def _rows(seed=1, n=50, d=6):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rnd.standard_normal(d) * np.arange(1, d + 1)]) for i in range(n)]
    return rows + [(100, None), (101, []), (102, [float("nan")] * d), (103, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (104, [float("inf")] * d), (105, [1e30] * d),
                   (106, [0.0] * d), (None, [0.5] * d), (None, rows[3][1]), (7, rows[8][1]), rows[4], rows[4], (107, [1.0, 2.0]), (108, [60.0] * d)]


def _frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, whitened double, label int")


def _same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose(np.abs([r[4] for r in got]), np.abs([r[4] for r in want]), atol=1e-8)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_whitening_is_brute_force(spark):
    rows = _rows()
    got = whitening.whiten(_frame(spark, rows), components=4).collect()
    _same([(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in got], _brute(rows, 4))
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_one_sign_for_all_rows(spark):
    rows = _rows(2, 30, 5)
    got = whitening.whiten(_frame(spark, rows), components=2).where("component = 1 AND vec_id < 7").orderBy("vec_id").collect()
    want = {r[0]: r[4] for r in _brute(rows, 2) if r[1] == 1 and r[0] is not None and r[0] < 7}
    sign = np.sign(got[0].whitened * want[got[0].vec_id])
    assert np.allclose([r.whitened * sign for r in got], [want[r.vec_id] for r in got], atol=1e-8)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(3 ** (i % 20) * 1000 + i), float(-i * 1e9), 0.25 * i]) for i in range(25)]
    got = whitening.whiten(_frame(spark, rows), components=2).collect()
    want = {(r[0], r[1]): r[3] for r in _brute(rows, 2)}
    assert {(r.vec_id, r.component): int(r.deviation) for r in got} == want


def test_degenerate_tables(spark):
    assert whitening.whiten(_frame(spark, [])).count() == 0
    assert whitening.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0        # no variance
    assert whitening.whiten(_frame(spark, [(1, None), (2, [float("nan")])])).count() == 0
    line = whitening.whiten(_frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    square = whitening.whiten(_frame(spark, [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])).collect()   # equal eigenvalues
    assert len(square) == 8 and max(r.identity_error for r in square) < 1e-12


def test_floats_and_packing(spark):
    rows = [(i, [0.1 * i, -0.2 * i * i, 600.0 if i == 4 else 0.0]) for i in range(9)]
    a = whitening.whiten(_frame(spark, rows, "float"), components=3).count()
    assert a == 27
    z = np.array([[1, -2, 3], [40000, 0, -5], [-32768, 32767, 0]])
    import pyarrow as pa
    assert (whitening.unpacked(pa.array(whitening.packed(z), pa.binary()), 3) == z).all()
