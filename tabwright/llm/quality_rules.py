"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the measurements
and one long whose bit ``i`` says that rule ``i`` failed.  A policy is a
versioned set of rules, hence a mask: a document is kept when
``failed & mask = 0``.  Changing a policy or computing an ablation reads the
ledger only, never the texts again.

Null text counts as an empty text (no words).  Columns other than the id and
the text are not read, so extra or clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurement columns."""

    name: str
    fails: str


#: Bit i belongs to RULES[i]; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("capitals", "10 * n_capitals > 6 * word_chars"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "capitals"),
}
LATEST = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def policy_mask(policy: str | tuple[str, ...]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _pieces(text: str, charclass: str) -> Column:
    """Characters of a class in a text: the pieces between them, less one."""
    return F.expr(f"size(split({text}, '{charclass}', -1)) - 1").cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements of every whole text, in one pass without a shuffle.

    Three-word windows are hashed to 64 bits and sorted as (hash, position), which
    brings equal windows together, so a text of n words costs n log n and is
    exact up to a collision of 64 bits (chance 3e-6 in a text of ten million words).
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select("doc_id", "_t", F.array_remove(F.split("_t", GAP), "").alias("_w"),
                 F.array_remove(F.transform(F.split("_t", "\n"), lambda x: F.regexp_replace(x, f"^{GAP}$", "")), "").alias("_l"))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_symbols": _pieces("_t", "[#*$%&|<>]"),
        "n_capitals": _pieces("_t", "\\\\p{Lu}"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    }).drop("_t", "_l")
    d = d.withColumn("_s", F.expr(
        "sort_array(transform(slice(_w, 1, greatest(size(_w) - 2, 0)),"
        " (x, i) -> struct(xxhash64(x, get(_w, i + 1), get(_w, i + 2)) AS h, i AS i)))")).drop("_w")
    d = d.withColumn("_p", F.expr(
        "sort_array(transform(filter(_s, (x, i) ->"
        " coalesce(x.h = get(_s, i + 1).h, false) or coalesce(x.h = get(_s, i - 1).h, false)), x -> x.i))")).drop("_s")
    covered = F.expr(
        "aggregate(transform(_p, (x, i) -> least(3L, coalesce(get(_p, i + 1) - x, 3L))), 0L, (a, x) -> a + x)")
    return d.withColumn("n_repeat_words", covered).select("doc_id", *MEASURES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i is set when RULES[i] failed."""
    bits = " | ".join(f"if({r.fails}, {1 << i}L, 0L)" for i, r in enumerate(RULES))
    return measure(docs, id_col, text_col).withColumn("failed", F.expr(bits))


def apply_policy(led: DataFrame, policy: str | tuple[str, ...] = LATEST, name: str = "kept") -> DataFrame:
    return led.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(led: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """One row per (policy, rule): documents that fail the rule, those that only
    this rule rejects (kept if it were dropped), and those the policy keeps.

    One aggregate over distinct bit patterns: ``failed`` has at most 2^rules
    values, so the partial aggregation leaves almost nothing to shuffle."""
    seen = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p, r, policy_mask(rules), BIT[r]) for p, rules in policies.items() for r in rules]
    spec = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                                        F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"))
                               for p, r, m, b in rows])).alias("x")
    hit = F.col("failed").bitwiseAND(F.col("x.mask"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (seen.select("failed", "n", spec)
            .groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule"))
            .agg(n(F.col("failed").bitwiseAND(F.col("x.bit")) != 0).alias("n_failed"),
                 n(hit == F.col("x.bit")).alias("n_only_this"), n(hit == 0).alias("n_kept")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(regexp_replace(t, '\P{Lu}', '', 'g')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 4 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_capitals > 6 * word_chars) AS kept
FROM b
"""
