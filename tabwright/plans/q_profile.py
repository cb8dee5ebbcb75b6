"""Profiling queries (A1b, A7, B1-B17) over a lake of all given tables plus the
dirty events fixture; DuckDB oracles generated from the table column lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.hashing import fingerprint
from ..operators import profile as P
from ..sources.tables import TABLES, read_table, read_tables
from .fixtures import dirty_events
from .q_clean import DIRTY_CTE
from .registry import query, r6
from .schemas import SCHEMAS


def lake(spark, sf_dir):
    t = read_tables(spark, sf_dir)
    t["events_dirty"] = dirty_events(spark, sf_dir)
    return t


def _profile(spark, sf_dir):
    tables = lake(spark, sf_dir)
    return tables, P.profile_lake(spark, tables)


# ------------------------------------------------------------------ SQL side
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CAT = "cat(table_name, ordinal, column_name, family) AS (VALUES " + ", ".join(
    f"({_q(t)}, {i + 1}, {_q(c)}, {_q(f)})" for t, cols in SCHEMAS.items() for i, (c, f) in enumerate(cols)) + ")"
_HINTS = "hints(hint, hint_rank) AS (VALUES " + ", ".join(f"({_q(h)}, {i})" for i, h in enumerate(N.TARGET_HINTS)) + ")"
_ST = " UNION ALL ".join(
    f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    f"count(DISTINCT {c}) AS n_distinct FROM {t}" for t, cols in SCHEMAS.items() for c, _ in cols)

BASE = f"""{DIRTY_CTE},
events_dirty AS (SELECT * FROM dirty),
{_CAT},
catn AS (SELECT *, replace(lower(column_name), ' ', '_') AS norm_name FROM cat),
{_HINTS},
st AS ({_ST}),
cand AS (
  SELECT table_name, column_name, 1 AS pass, hint_rank AS k1, -ordinal AS k2 FROM catn JOIN hints ON norm_name = hint
  UNION ALL SELECT table_name, column_name, 2, ordinal, 0 FROM catn JOIN hints
     ON norm_name = hint OR ends_with(norm_name, '_' || hint)
  UNION ALL SELECT table_name, column_name, 3, -ordinal, 0 FROM catn),
targets AS (SELECT table_name, column_name AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY pass, k1, k2) AS rn FROM cand) WHERE rn = 1),
tp AS (SELECT t.table_name, t.target, c.family, s.n_rows, s.n_null, s.n_distinct,
  CASE WHEN s.n_rows - s.n_null = 0 THEN 'classification'
       WHEN c.family IN ('boolean', 'string', 'temporal', 'nested') THEN 'classification'
       WHEN s.n_distinct <= 20 AND c.family = 'integer' THEN 'classification'
       WHEN s.n_distinct <= greatest(10, floor((s.n_rows - s.n_null) * 0.1)) THEN 'classification'
       WHEN c.family = 'float' THEN 'regression'
       WHEN s.n_distinct <= 2 THEN 'classification'
       ELSE 'regression' END AS task_type,
  CASE WHEN s.n_distinct <= 20 THEN 'classification' ELSE 'regression' END AS problem_type
  FROM targets t JOIN cat c ON c.table_name = t.table_name AND c.column_name = t.target
  JOIN st s ON s.table_name = t.table_name AND s.column_name = t.target)"""


def _target_counts_sql():
    parts = []
    for t, cols in SCHEMAS.items():
        for c, _ in cols:
            parts.append(f"SELECT {_q(t)} AS table_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} "
                         f"WHERE (SELECT target FROM targets WHERE table_name = {_q(t)}) = {_q(c)} GROUP BY 2")
    return " UNION ALL ".join(parts)


COUNTS = BASE + f""",
tcounts AS ({_target_counts_sql()}),
topk AS (SELECT table_name, value, n, rank FROM (SELECT *, row_number() OVER (
   PARTITION BY table_name ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM tcounts) WHERE rank <= 10)"""


def _dups_sql():
    return " UNION ALL ".join(
        f"SELECT {_q(t)} AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
        f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS n_duplicates"
        for t in SCHEMAS)


def _contains(expr, tokens):
    return N.sql_contains_any(expr, tokens)


FLAGS = f"""flags AS (SELECT c.table_name, c.ordinal, c.column_name, c.norm_name, t.target,
  {_contains('c.norm_name', N.PROFILE_PII_HINTS)} AS pii,
  {_contains('c.norm_name', N.PROFILE_SENSITIVE_HINTS)} AS sensitive,
  {_contains('c.norm_name', N.RISK_PII_HINTS)} AS risk_pii,
  {_contains('c.norm_name', N.RISK_SENSITIVE_HINTS)} AS risk_sensitive,
  (c.norm_name = 'id' OR ends_with(c.norm_name, '_id')) AS id_like,
  c.column_name <> t.target AND {_contains('lower(c.column_name)', N.TAG_TIME_TOKENS)} AS is_time,
  c.column_name <> t.target AND {_contains('lower(c.column_name)', N.TAG_TEXT_TOKENS)} AS is_text,
  c.column_name <> t.target AND {_contains('lower(c.column_name)', N.TAG_RECOMMENDER_TOKENS)} AS is_rec
  FROM catn c JOIN targets t USING (table_name))"""


def _first_rule_sql(text, rules, default):
    return "CASE " + " ".join(f"WHEN {_contains(text, toks)} THEN {_q(label)}" for label, toks in rules) + f" ELSE {_q(default)} END"


def _industry_sql():
    by_dom = " ".join(f"WHEN business_domain = {_q(d)} THEN {_q(l)}" for d, l in N.INDUSTRY_BY_DOMAIN)
    by_tok = " ".join(f"WHEN {_contains('names', toks)} THEN {_q(l)}" for l, toks in N.INDUSTRY_TOKEN_RULES)
    return f"CASE {by_dom} {by_tok} ELSE {_q(N.INDUSTRY_DEFAULT)} END"


DOMAIN = f"""jn AS (SELECT c.table_name, coalesce(string_agg(lower(c.column_name), ' ' ORDER BY c.ordinal), '') AS names
  FROM cat c JOIN targets t ON c.table_name = t.table_name AND c.column_name <> t.target GROUP BY c.table_name),
dom AS (SELECT table_name, names, {_first_rule_sql('names', N.DOMAIN_RULES, N.DOMAIN_DEFAULT)} AS business_domain FROM jn),
ind AS (SELECT table_name, business_domain, {_industry_sql()} AS industry FROM dom)"""

TABLE_PROFILE = COUNTS + f""",
{FLAGS},
dups AS ({_dups_sql()}),
pt AS (SELECT s.table_name, max(s.n_rows) AS n_rows, count(*) AS n_columns, sum(s.n_null) AS n_missing,
   count(*) FILTER (WHERE s.n_distinct <= 1) AS n_constant,
   count(*) FILTER (WHERE s.column_name <> t.target) AS feature_count
   FROM st s JOIN targets t USING (table_name) GROUP BY s.table_name),
nf AS (SELECT table_name, count(*) FILTER (WHERE pii) AS n_pii, count(*) FILTER (WHERE risk_pii) AS n_risk_pii,
   count(*) FILTER (WHERE risk_sensitive) AS n_risk_sensitive, count(*) FILTER (WHERE is_time) AS n_time,
   count(*) FILTER (WHERE is_text) AS n_text, count(*) FILTER (WHERE is_rec) AS n_rec FROM flags GROUP BY table_name),
imb AS (SELECT table_name, min(n) / greatest(sum(n), 1) AS share FROM topk GROUP BY table_name),
base AS (SELECT pt.*, nf.n_pii, nf.n_risk_pii, nf.n_risk_sensitive, nf.n_time, nf.n_text, nf.n_rec,
   dups.n_duplicates, tp.task_type, imb.share,
   CAST(n_missing AS DOUBLE) / greatest(pt.n_rows * n_columns, 1) AS missing_ratio,
   CAST(n_duplicates AS DOUBLE) / greatest(pt.n_rows, 1) AS dup_ratio
   FROM pt JOIN nf USING (table_name) JOIN dups USING (table_name) JOIN tp USING (table_name)
   LEFT JOIN imb USING (table_name)),
scored AS (SELECT *,
   CAST(floor(least(greatest(100 - missing_ratio * 55 - dup_ratio * 35 - n_constant * 3 - n_pii * 4, 0.0), 100.0)) AS INT) AS quality_score,
   task_type = 'classification' AND share IS NOT NULL AND share < 0.2 AS imbalanced,
   greatest(0.0, 100.0 - missing_ratio * 100.0 * 0.8 - n_risk_pii * 8 - n_risk_sensitive * 3) AS rq
   FROM base),
risk AS (SELECT *, round(least(100.0,
   (CASE WHEN missing_ratio > 0.1 THEN 15 ELSE 0 END + CASE WHEN imbalanced THEN 12 ELSE 0 END
    + CASE WHEN feature_count > 40 THEN 8 ELSE 0 END + CASE WHEN n_risk_pii > 0 THEN 20 ELSE 0 END
    + CASE WHEN n_risk_sensitive > 0 THEN 8 ELSE 0 END) + (100.0 - rq) * 0.5), 2) AS risk_score,
   round(rq, 2) AS risk_quality FROM scored)"""


# ------------------------------------------------------------------ queries
@query("scan_profile", sql=f"""WITH {BASE}
SELECT table_name, column_name, metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT table_name, '*' AS column_name, 'rows' AS metric, max(n_rows) AS value FROM st GROUP BY table_name
  UNION ALL SELECT table_name, column_name, 'n_null', n_null FROM st
  UNION ALL SELECT table_name, column_name, 'n_distinct', n_distinct FROM st) u""")
def q_scan_profile(spark, sf_dir):
    return P.lake_stats(lake(spark, sf_dir))


def fingerprint_sql(t: str) -> str:
    """The same rule in DuckDB: length-marked lossless fields, two 64-bit sums."""
    hexf = "replace(printf('%a', CAST({c} AS DOUBLE)), 'p+', 'p')"

    def text(c, f):
        if f == "float":
            return hexf.format(c=c)
        if f == "nested":
            return f"array_to_string(list_transform({c}, lambda x: coalesce({hexf.format(c='x')}, 'null')), ',')"
        return f"CAST(epoch_us({c}) AS VARCHAR)" if f == "temporal" else f"CAST({c} AS VARCHAR)"

    cols = " || ".join(f"coalesce(CAST(length({text(c, f)}) AS VARCHAR) || ':' || {text(c, f)}, 'n')" for c, f in SCHEMAS[t])
    half = "CAST(CAST('0x' || substr(h, {at}, 16) AS UBIGINT) AS HUGEINT)"
    return f"""SELECT {_q(t)} AS table_name, n_rows, content_hash, content_hash_2,
   substr(sha256(n_rows || ':' || content_hash || ':' || content_hash_2), 1, 16) AS dataset_signature FROM (
   SELECT count(*) AS n_rows, CAST(coalesce(sum({half.format(at=1)}), 0) % 2305843009213693951 AS BIGINT) AS content_hash,
          CAST(coalesce(sum({half.format(at=17)}), 0) % 2305843009213693951 AS BIGINT) AS content_hash_2 FROM (
     SELECT md5({cols}) AS h FROM {t}) x) y"""


@query("fingerprint", sql=" UNION ALL ".join(fingerprint_sql(t) for t in TABLES))
def q_fingerprint(spark, sf_dir):
    out = None
    for t in TABLES:
        part = fingerprint(read_table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("infer_target", sql=f"WITH {BASE} SELECT table_name, target FROM targets")
def q_infer_target(spark, sf_dir):
    tables = lake(spark, sf_dir)
    return P.infer_target(P.catalog_of(spark, tables))


@query("column_roles", sql=f"""WITH {BASE}
SELECT c.table_name, c.column_name, c.family,
  CASE WHEN c.column_name = t.target THEN 'target' WHEN c.family IN ('integer', 'float', 'boolean') THEN 'numeric'
       ELSE 'categorical' END AS role
FROM cat c JOIN targets t USING (table_name)""")
def q_column_roles(spark, sf_dir):
    tables = lake(spark, sf_dir)
    cat = P.catalog_of(spark, tables)
    return P.column_roles(cat, P.infer_target(cat)).drop("ordinal")


@query("task_type", sql=f"WITH {BASE} SELECT table_name, target, task_type FROM tp")
def q_task_type(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    return p.target_profile().select("table_name", "target", "task_type")


@query("problem_type", sql=f"WITH {BASE} SELECT table_name, target, problem_type FROM tp")
def q_problem_type(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    return p.target_profile().select("table_name", "target", "problem_type")


@query("missing_profile", sql=f"""WITH {BASE}
SELECT table_name, column_name, n_null, round(CAST(n_null AS DOUBLE) / greatest(n_rows, 1), 6) AS missing_ratio FROM st""")
def q_missing_profile(spark, sf_dir):
    w = P.null_stats(lake(spark, sf_dir))
    return w.select("table_name", "column_name", "n_null", r6(F.col("n_null") / F.greatest(F.col("n_rows"), F.lit(1))).alias("missing_ratio"))


@query("missing_flag", sql=f"""WITH {BASE}
SELECT table_name, column_name FROM st WHERE CAST(n_null AS DOUBLE) / greatest(n_rows, 1) > 0.2""")
def q_missing_flag(spark, sf_dir):
    w = P.null_stats(lake(spark, sf_dir))
    return w.where(F.col("n_null") / F.greatest(F.col("n_rows"), F.lit(1)) > 0.2).select("table_name", "column_name")


@query("distinct_profile", sql=f"WITH {BASE} SELECT table_name, column_name, n_distinct FROM st")
def q_distinct_profile(spark, sf_dir):
    return P.distinct_stats(lake(spark, sf_dir))


@query("distinct_approx")
def q_distinct_approx(spark, sf_dir):
    """HyperLogLog++ distinct counts (rsd 5%): one pass, fixed memory per column."""
    w = P.lake_stats(lake(spark, sf_dir), exact=False).where("metric = 'n_distinct'")
    return w.select("table_name", "column_name", F.col("value").cast("long").alias("n_distinct_approx"))


@query("constant_columns", sql=f"""WITH {BASE}
SELECT table_name, count(*) FILTER (WHERE n_distinct <= 1) AS n_constant FROM st GROUP BY table_name""")
def q_constant_columns(spark, sf_dir):
    w = P.null_stats(lake(spark, sf_dir))
    return w.groupBy("table_name").agg(F.count(F.when(F.col("constant"), 1)).alias("n_constant"))


@query("target_topk", sql=f"""WITH {COUNTS}
SELECT table_name, value, n, rank FROM topk JOIN tp USING (table_name) WHERE task_type = 'classification'""")
def q_target_topk(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    tp = p.target_profile().where(F.col("task_type") == "classification")
    return p.topk.join(tp.select("table_name"), "table_name").select("table_name", "value", "n", F.col("rank").cast("long").alias("rank"))


_MOM = " UNION ALL ".join(
    f"SELECT {_q(t)} AS table_name, {_q(c)} AS target, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std FROM {t}"
    for t, cols in SCHEMAS.items() for c, f in cols if f in ("integer", "float"))


@query("target_moments", sql=f"""WITH {BASE}, mom AS ({_MOM})
SELECT table_name, round(mean, 4) AS mean, round(std, 4) AS std FROM mom JOIN tp USING (table_name, target)
WHERE task_type = 'regression'""")
def q_target_moments(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    tp = p.target_profile().where(F.col("task_type") == "regression")
    reg = [r["table_name"] for r in tp.select("table_name").collect()]
    m = P.target_moments({t: tables[t] for t in reg}, {t: p.target_map[t] for t in reg})
    return m.select("table_name", r6("mean", 4).alias("mean"), r6("std", 4).alias("std"))


@query("duplicate_count", sql=f"WITH {DIRTY_CTE}, events_dirty AS (SELECT * FROM dirty) {_dups_sql()}")
def q_duplicate_count(spark, sf_dir):
    return P.duplicate_counts(lake(spark, sf_dir))


@query("pii_columns", sql=f"""WITH {BASE}, {FLAGS}
SELECT table_name, column_name, 'profile' AS hint_list FROM flags WHERE pii
UNION ALL SELECT table_name, column_name, 'risk' FROM flags WHERE risk_pii""")
def q_pii_columns(spark, sf_dir):
    f = P.name_flags(P.catalog_of(spark, lake(spark, sf_dir)))
    return f.where("pii").select("table_name", "column_name", F.lit("profile").alias("hint_list")).unionByName(
        f.where("risk_pii").select("table_name", "column_name", F.lit("risk").alias("hint_list")))


@query("sensitive_columns", sql=f"""WITH {BASE}, {FLAGS}
SELECT table_name, column_name, 'profile' AS hint_list FROM flags WHERE sensitive
UNION ALL SELECT table_name, column_name, 'risk' FROM flags WHERE risk_sensitive""")
def q_sensitive_columns(spark, sf_dir):
    f = P.name_flags(P.catalog_of(spark, lake(spark, sf_dir)))
    return f.where("sensitive").select("table_name", "column_name", F.lit("profile").alias("hint_list")).unionByName(
        f.where("risk_sensitive").select("table_name", "column_name", F.lit("risk").alias("hint_list")))


@query("id_columns", sql=f"""WITH {BASE}, {FLAGS}, dups AS ({_dups_sql()}),
ids AS (SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal) AS id_columns FROM flags WHERE id_like GROUP BY table_name)
SELECT d.table_name, coalesce(id_columns, '') AS id_columns, CASE
  WHEN n_duplicates > 0 AND id_columns IS NOT NULL THEN 'Exact duplicate rows detected; Identifier-like columns present'
  WHEN n_duplicates > 0 THEN 'Exact duplicate rows detected' WHEN id_columns IS NOT NULL THEN 'Identifier-like columns present'
  ELSE '' END AS duplicate_patterns FROM dups d LEFT JOIN ids USING (table_name)""")
def q_id_columns(spark, sf_dir):
    tables = lake(spark, sf_dir)
    return P.duplicate_patterns(P.catalog_of(spark, tables), P.duplicate_counts(tables))


@query("domain_tags", sql=f"WITH {BASE}, {DOMAIN} SELECT table_name, business_domain, industry FROM ind")
def q_domain_tags(spark, sf_dir):
    tables = lake(spark, sf_dir)
    cat = P.catalog_of(spark, tables)
    return P.domain_tags(cat, P.infer_target(cat))


def _table_profile(spark, sf_dir):
    tables, p = _profile(spark, sf_dir)
    return p.table_profile()


@query("quality_score", sql=f"WITH {TABLE_PROFILE} SELECT table_name, quality_score FROM risk")
def q_quality_score(spark, sf_dir):
    return _table_profile(spark, sf_dir).select("table_name", "quality_score")


@query("risk_score", sql=f"""WITH {TABLE_PROFILE}
SELECT table_name, risk_score, risk_quality, array_to_string(list_filter([
  CASE WHEN missing_ratio > 0.1 THEN 'missing_data' END, CASE WHEN imbalanced THEN 'class_imbalance' END,
  CASE WHEN feature_count > 40 THEN 'many_features' END, CASE WHEN n_risk_pii > 0 THEN 'pii' END,
  CASE WHEN n_risk_sensitive > 0 THEN 'sensitive' END], lambda x: x IS NOT NULL), ',') AS findings FROM risk""")
def q_risk_score(spark, sf_dir):
    t = _table_profile(spark, sf_dir)
    return t.select("table_name", "risk_score", "risk_quality", F.array_join("findings", ",").alias("findings"))


@query("table_tags", sql=f"""WITH {TABLE_PROFILE}
SELECT table_name, coalesce(nullif(array_to_string(list_filter([
  CASE WHEN n_time > 0 THEN 'time_series' END, CASE WHEN n_text > 0 THEN 'text' END,
  CASE WHEN task_type = 'classification' AND coalesce(share, 1.0) < 0.2 AND risk_score >= 35 THEN 'fraud' END,
  CASE WHEN n_rec >= 2 THEN 'recommender' END,
  CASE WHEN task_type = 'classification' AND risk_score >= 50 THEN 'anomaly' END], lambda x: x IS NOT NULL), ','), ''),
  'generalist') AS tags FROM risk""")
def q_table_tags(spark, sf_dir):
    t = _table_profile(spark, sf_dir)
    return t.select("table_name", F.array_join("tags", ",").alias("tags"))
