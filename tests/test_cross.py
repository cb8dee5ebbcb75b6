"""Correlations and Gram statistics against pandas and numpy."""
import numpy as np
import pandas as pd
import pytest

from tabwright.functions import cross
from tabwright.operators import features as FE
from tabwright.operators.eda import corr_long
from tabwright.operators.explain import surrogate_ridge


def _frame(spark, pdf):
    return spark.createDataFrame([tuple(None if v is None or v != v else float(v) for v in r) for r in pdf.itertuples(index=False)],
                                 ", ".join(f"{c} double" for c in pdf.columns))


def _want(pdf):
    out = {}
    for i, a in enumerate(pdf.columns):
        for b in pdf.columns[i + 1:]:
            both = pdf[[a, b]].dropna()
            flat = len(both) == 0 or both[a].nunique() <= 1 or both[b].nunique() <= 1 or not np.isfinite(both.to_numpy()).all()
            out[a, b] = None if flat else np.corrcoef(both[a], both[b])[0, 1]
    return out


def _same(got, want):
    assert list(got) == list(want)
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or got[k] == pytest.approx(w, abs=1e-9)), (k, got[k], w)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(1)
    n = 400
    p = pd.DataFrame({"a": rng.normal(size=n), "far": 1e9 + rng.normal(size=n), "const": np.full(n, 7.1), "tiny": 3 + 1e-6 * rng.normal(size=n)})
    p["twice"] = 2 * p.a + 1
    p["gaps"] = np.where(np.arange(n) % 3 == 0, np.nan, p.a + rng.normal(size=n))
    p["flat_there"] = np.where(np.arange(n) % 3 == 0, rng.normal(size=n), 5.3)      # constant where ``gaps`` has values
    p["none"] = np.nan
    p["wide"] = np.where(np.arange(n) == 11, np.inf, rng.normal(size=n))
    p["rare"] = np.where(np.arange(n) % 100 == 5, rng.normal(size=n), np.nan)
    return p


def test_pairwise_correlations(spark, odd):
    got = {(r.col_a, r.col_b): r.r for r in corr_long(_frame(spark, odd), list(odd.columns)).collect()}
    _same(got, _want(odd))


def test_wide_tables_take_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(cross, "WIDTH", 4)
    got = {(r.col_a, r.col_b): r.r for r in corr_long(_frame(spark, odd), list(odd.columns)).collect()}
    _same(got, _want(odd))


def test_few_columns_and_rows(spark, odd):
    d = _frame(spark, odd)
    assert corr_long(d, ["a"]).count() == 0 and corr_long(d, []).count() == 0
    assert [tuple(r) for r in corr_long(d.where("false"), ["a", "far"]).collect()] == [("a", "far", None)]


def test_two_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame(rng.normal(size=(60, 200)) @ rng.normal(size=(200, 200)), columns=[f"c{i}" for i in range(200)])
    got = corr_long(_frame(spark, p), list(p.columns)).toPandas()
    want = np.corrcoef(p.to_numpy().T)[np.triu_indices(200, 1)]
    assert len(got) == 19900 and np.abs(got.r.to_numpy() - want).max() < 1e-9


def test_correlated_and_constant_features_go(spark, odd):
    """F1, F2 on columns that must be dropped."""
    p = odd[["a", "twice", "const", "none", "gaps"]].assign(target=(odd.a > 0).astype(float))
    sel = FE.select_features(_frame(spark, p), "target")
    assert sel.low_variance == ["const", "none"] and sel.correlated == ["twice"] and [x[:2] for x in sel.correlated_pairs] == [("a", "twice")]
    assert sel.numeric == ["a", "gaps"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 100, 0.1] + [0, 1e6, 5]
    y = x @ [2.0, -0.03, 7.0] + 4 + rng.normal(size=300)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "fold": np.arange(300) % 4})


def test_least_squares_and_ridge(spark, rows):
    g = cross.gram(_frame(spark, rows), ["a", "b", "c"], "y")[0]
    x, y = rows[["a", "b", "c"]].to_numpy(), rows.y.to_numpy()
    for alpha in (0.0, 1.0, 30.0):
        xc, yc = x - x.mean(axis=0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        coef, intercept = g.solve(alpha)
        assert np.allclose(coef, want, rtol=1e-7) and intercept == pytest.approx(y.mean() - want @ x.mean(axis=0), rel=1e-6)
        assert g.sse(coef, intercept) == pytest.approx(((y - x @ coef - intercept) ** 2).sum(), rel=1e-6)


def test_folds_by_subtraction(spark, rows):
    grams = cross.gram(_frame(spark, rows), ["a", "b", "c"], "y", "fold")
    got = cross.gram_cross_validate(grams)
    assert sorted(got) == [0, 1, 2, 3]
    for f in got:
        tr, te = rows[rows.fold != f], rows[rows.fold == f]
        a = np.column_stack([np.ones(len(tr)), tr[["a", "b", "c"]]])
        beta = np.linalg.lstsq(a, tr.y, rcond=None)[0]
        e = te.y - np.column_stack([np.ones(len(te)), te[["a", "b", "c"]]]) @ beta
        assert got[f] == pytest.approx(1 - (e ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum(), abs=1e-6)


def test_nulls_singular_features_and_no_rows(spark, rows):
    p = rows.assign(twice=2 * rows.a)
    p.loc[5, "a"] = np.nan
    d = _frame(spark, p)
    g = cross.gram(d, ["a", "twice"], "y")[0]
    assert g.n == 299
    coef, _ = g.solve()
    assert np.isfinite(coef).all() and coef[1] == pytest.approx(2 * coef[0], rel=1e-6)       # the shortest solution
    assert cross.gram(d.where("false"), ["a"], "y") == {}
    assert list(surrogate_ridge(d.where("false"), ["a"], "y").coefficients) == []
