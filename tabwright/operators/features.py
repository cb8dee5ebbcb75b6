"""Feature engineering (F1-F9), fitted on training rows only.

Selection (F1 low variance, F2 correlated) is one distinct-count aggregate
and one correlation aggregate.  The fitted preprocessor is an ordinary
``PipelineModel`` so it persists with ``save``/``load`` and runs inside
whole-stage codegen:

* ``SQLTransformer`` carrying the fitted constants: exact median fill (F3),
  degree-2 polynomial terms in linear-then-quadratic order (F4), standard
  scaling with the *population* std, constant -> scale 1 (F5), and the
  most-frequent fill for categoricals (F6);
* ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)``: the
  indexer's metadata ends with an ``__unknown`` slot, which is the one
  dropped, so all real levels are kept (sorted) and an unseen level maps to
  all zeros (F7);
* ``VectorAssembler`` -> ``features`` (F8); names kept in a side list.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations_with_replacement

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import DEFAULT, Options
from .eda import corr_long
from .stats import column_modes, column_quantiles, split_roles


@dataclass
class FeatureSelection:
    target: str
    selected: list[str]
    low_variance: list[str]
    correlated: list[str]
    numeric: list[str]
    categorical: list[str]
    correlated_pairs: list[tuple[str, str, float]] = field(default_factory=list)

    def report_rows(self):
        """(column_name, action)."""
        rows = [(c, "low_variance") for c in self.low_variance] + [(c, "correlated") for c in self.correlated]
        rows += [(c, "numeric") for c in self.numeric] + [(c, "categorical") for c in self.categorical]
        return rows


def select_features(train: DataFrame, target: str, options: Options = DEFAULT) -> FeatureSelection:
    cols = [c for c in train.columns if c != target]
    # one value at most: least equals greatest (both null without any); plain partial aggregates
    same = train.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(f"_s{i}") for i, c in enumerate(cols)]).collect()[0]
    low = [c for i, c in enumerate(cols) if same[f"_s{i}"]]
    sel = [c for c in cols if c not in low]
    num, cat = split_roles(train.select(*sel, target), target)
    dropped, pairs = [], []
    if len(num) >= 2:
        for r in corr_long(train, num).where(F.abs("r") > options.correlation_drop).collect():
            pairs.append((r["col_a"], r["col_b"], r["r"]))
        order = {c: i for i, c in enumerate(num)}
        dropped = sorted({b for a, b, _ in pairs}, key=order.get)
    num = [c for c in num if c not in dropped]
    sel = [c for c in sel if c not in dropped]
    return FeatureSelection(target, sel, low, dropped, num, cat, pairs)


def poly_terms(numeric: list[str]) -> list[tuple[str, list[str]]]:
    """Degree-2 terms without bias: x_i (in order), then x_i * x_j for i <= j."""
    terms = [(c, [c]) for c in numeric]
    for a, b in combinations_with_replacement(numeric, 2):
        terms.append((f"{a}^2" if a == b else f"{a} {b}", [a, b]))
    return terms


def fit_medians(df: DataFrame, columns: list[str], options: Options = DEFAULT) -> dict[str, float]:
    q = column_quantiles(df, columns, [0.5], exact=options.exact, accuracy=options.quantile_accuracy).collect()
    got = {r["column_name"]: r["value"] for r in q}
    return {c: float(got[c]) if got.get(c) is not None else 0.0 for c in columns}


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    got = {r["column_name"]: r["mode"] for r in column_modes(df, columns).collect()}
    return {c: (got.get(c) if got.get(c) is not None else "Unknown") for c in columns}


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v))


@dataclass
class Preprocessor:
    model: PipelineModel
    feature_names: list[str]
    numeric_terms: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    means: dict[str, float]
    scales: dict[str, float]
    poly: bool

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str], options: Options = DEFAULT,
                     output_col: str = "features") -> Preprocessor:
    medians = fit_medians(train, numeric, options) if numeric else {}
    use_poly = options.allow_polynomial_features and 2 <= len(numeric) <= options.max_polynomial_numeric_features
    terms = poly_terms(numeric) if use_poly else [(c, [c]) for c in numeric]
    imputed = {c: f"coalesce(CAST({_q(c)} AS DOUBLE), {_lit(medians[c])})" for c in numeric}
    term_sql = {name: " * ".join(f"({imputed[c]})" for c in parts) for name, parts in terms}
    means, scales = {}, {}
    if terms:
        row = train.selectExpr(*[f"{e} AS {_q('t' + str(i))}" for i, e in enumerate(term_sql.values())]).agg(
            *[F.avg(f"t{i}").alias(f"m{i}") for i in range(len(terms))],
            *[F.stddev_pop(f"t{i}").alias(f"s{i}") for i in range(len(terms))]).collect()[0]
        for i, (name, _) in enumerate(terms):
            means[name] = float(row[f"m{i}"] or 0.0)
            s = row[f"s{i}"]
            scales[name] = float(s) if s not in (None, 0.0) else 1.0
    modes = fit_modes(train, categorical) if categorical else {}
    selects = [f"(({term_sql[n]}) - {_lit(means[n])}) / {_lit(scales[n])} AS {_q('numeric__' + n)}" for n, _ in terms]
    selects += [f"coalesce(CAST({_q(c)} AS STRING), {_lit(modes[c])}) AS {_q('_cat__' + c)}" for c in categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(selects)} FROM __THIS__")] if selects else []
    inputs = ["numeric__" + n for n, _ in terms]
    if categorical:
        stages.append(StringIndexer(inputCols=["_cat__" + c for c in categorical], outputCols=["_idx__" + c for c in categorical],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=["_idx__" + c for c in categorical], outputCols=["_ohe__" + c for c in categorical],
                                    dropLast=True, handleInvalid="error"))
        inputs += ["_ohe__" + c for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output_col, handleInvalid="error"))
    model = Pipeline(stages=stages).fit(train)
    names = list(inputs[:len(terms)])
    if categorical:
        si = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"][0]
        for c, labels in zip(categorical, si.labelsArray):
            names += [f"categorical__{c}_{v}" for v in labels]
    return Preprocessor(model, names, [n for n, _ in terms], medians, modes, means, scales, use_poly)


def feature_names_df(spark, pre: Preprocessor) -> DataFrame:
    """(idx, feature) side table; bounded by the feature count."""
    return spark.createDataFrame(list(enumerate(pre.feature_names)), "idx int, feature string")
