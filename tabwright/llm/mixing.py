"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sizes are word counts.  A source whose target is r times its size takes every
document floor(r) times (the certain whole copies) and samples the remaining
R words: document i has inclusion probability lambda_i proportional to the
square root of its size, its rank is the Pareto variable
``U/(1-U) / (lambda/(1-lambda))`` (U from a hash of its id, its text and, of
rows equal in both, its number among them, so reruns agree), and the documents of smallest rank are taken while their words fit R.  One
closing document, the one whose size is nearest to what is then missing, ends
the sample if it brings the sum nearer to the target.

No source is ever sorted as a whole: ranks fall into buckets, bucket sums are
added up per source, and only the bucket in which the sum passes R is ordered.
Per-source parameters are a few numbers a source, joined by ``join_small``.

Null text has size 0 and is never taken; null source is a source of its own.
Rows that are equal are drawn one by one: they are counted, and the count is told
apart again into numbered units, a crowded one in many tasks.  Rows that repeat an
id with other texts, null ids too, are documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, materialize

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_REPEAT = 2
SEED = "mix-1"
ROWS_PER_BUCKET = 500
COPIES_PER_LOT = 50_000   # equal rows told apart by one task


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, s_size, s_n, s_q, target) from (src, size, q): one row per source.

    Sources by code point, null last, weigh ``weights`` in turn.  Targets share
    ``share_percent`` of all words by weight; one above ``max_repeat`` times its
    source's size stops there and its excess is reshared.  With sources ordered
    by the level at which they stop, the level of the others is a running sum.
    """
    per = sized.groupBy("src").agg(F.sum("size").alias("s_size"), F.count(F.lit(1)).alias("s_n"),
                                   F.sum((F.col("q") * F.col("size")).cast("decimal(38,0)")).alias("s_q"))
    order = Window.orderBy(F.col("src").isNull(), "src")
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stop = Window.orderBy((F.col("s_size") * max_repeat / F.col("w")), F.col("src").isNull(), "src")
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumns({
        "_all": F.sum("s_size").over(everything),
        "_capped": F.coalesce(F.sum(F.col("s_size") * max_repeat).over(before), F.lit(0)),
        "_w": F.sum("w").over(rest)})
    level = (F.col("_all") * share_percent / 100 - F.col("_capped")) / F.col("_w")
    own = F.col("s_size") * max_repeat / F.col("w")
    per = per.withColumns({"_level": level, "_free": level <= own})
    # all sources before the first free one stop; the free ones share that one's level
    first = F.min(F.when(F.col("_free"), F.struct("_capped", "_level"))).over(everything)
    per = per.withColumn("_common", first["_level"])
    return per.select("src", "s_size", "s_n", "s_q", F.coalesce(
        F.least(F.col("_common") * F.col("w"), (F.col("s_size") * max_repeat).cast("double")),
        (F.col("s_size") * max_repeat).cast("double")).alias("target"))


def _unit(rep, seed: str):
    """Uniform in (0, 1) from the id, the text's digest and the number of the copy."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("tkey"), F.lit("")), F.lit("|"), rep.cast("string"), F.lit(f"|{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, rows: bool = False) -> DataFrame:
    """doc_id, src, size, q (size measure), tkey (digest of the text), ckey (of the row, or of id, source and
    text), and with ``rows`` the row itself."""
    own = [F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), F.md5(F.col(text_col).cast("binary")).alias("tkey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        *([F.xxhash64(*own, *[c.isNull() for c in own]).alias("ckey"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []))
    if not rows:
        d = d.withColumn("ckey", F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in ("doc_id", "src", "tkey")]))
    return d.withColumn("q", F.ceil(F.sqrt("size")).cast("long"))


def units(light: DataFrame, seed: str, tag: str) -> DataFrame:
    """A row per document: doc_id, src, size, q, tkey, ckey, copies_of (rows equal to it) and u."""
    same = ["doc_id", "src", "tkey", "size", "q", "ckey"]
    counted = light.groupBy(*same).agg(F.count(F.lit(1)).alias("copies_of"))
    # rows of one id, source and text that differ elsewhere go on counting (few: variants of one text)
    before = Window.partitionBy("doc_id", "src", "tkey").orderBy("ckey").rowsBetween(Window.unboundedPreceding, -1)
    counted = materialize(counted.withColumn("start", F.coalesce(F.sum("copies_of").over(before), F.lit(0))), tag)
    lot = F.expr(f"sequence(0L, (copies_of - 1) div {COPIES_PER_LOT})")
    crowded = counted.where(F.col("copies_of") > COPIES_PER_LOT).withColumn("lot", F.explode(lot)).repartition("ckey", "lot")
    every = counted.where(F.col("copies_of") <= COPIES_PER_LOT).withColumn("lot", F.lit(0).cast("long")).unionByName(crowded)
    rep = F.explode(F.expr(f"sequence(lot * {COPIES_PER_LOT}, least(copies_of, (lot + 1) * {COPIES_PER_LOT}) - 1)"))
    return every.withColumn("rep", rep).withColumn("u", _unit(F.col("start") + F.col("rep"), seed)).drop("lot", "rep")


def ranked(rows: DataFrame, per_source: DataFrame, buckets: int) -> DataFrame:
    """Adds the source's parameters, the Pareto rank (null: never sampled) and its bucket."""
    lam = F.least(F.col("need") * F.col("q") / F.col("s_q").cast("double"), F.lit(1.0))
    out = join_small(rows, per_source.withColumnRenamed("src", "_src"), F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    out = (out.withColumn("lam", F.when((F.col("size") > 0) & (F.col("need") > 0), lam))
           .withColumn("rank", F.when(F.col("lam") < 1, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("lam")) / F.col("lam")))
                       .when(F.col("lam") >= 1, F.lit(0.0))))
    return out.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))


def drawn(rows: DataFrame) -> DataFrame:
    """Adds ``inside``: within the documents of smallest rank that fit."""
    key = F.struct(F.col("rank"), F.col("u"))
    inside = (F.col("bucket") < F.col("edge")) | F.col("edge").isNull() | ((F.col("bucket") == F.col("edge")) & (key <= F.col("last")))
    return rows.withColumn("inside", F.col("rank").isNotNull() & F.coalesce(inside, F.lit(False))).withColumn("gap", F.col("need") - F.col("got"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_repeat: int = MAX_REPEAT, seed: str = SEED, rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies: a row per document.

    ``rows``: also ``row``, a struct of the document's own columns (texts are read again, not joined)."""
    light = sized(docs, id_col, text_col, source_col, rows)
    base = materialize(units(light.drop("row") if rows else light, seed, "mix-classes"), "mix-sizes")
    src = materialize(source_targets(base, weights, share_percent, max_repeat), "mix-targets", True)
    size = F.col("s_size").cast("double")
    whole = F.when(F.col("s_size") == 0, F.lit(0.0)).otherwise(F.least(F.floor(F.col("target") / size), F.lit(max_repeat)))
    src = materialize(src.withColumn("whole", whole.cast("long")).withColumn("need", F.col("target") - F.col("whole") * size), "mix-need", True)
    most = src.agg(F.max("s_n")).first()[0] or 1
    buckets = 1 << max(10, math.ceil(math.log2(most / ROWS_PER_BUCKET + 1)))
    known = ranked(base, src, buckets)
    sums = known.where("rank IS NOT NULL").groupBy("src", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("src").orderBy("bucket")))
    # words of all buckets that fit whole, and the bucket in which the sum passes
    cut = materialize(sums.groupBy(F.col("src").alias("_src")).agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))), F.lit(0)).alias("fit"),
        F.min(F.when(F.col("upto") > F.col("need"), F.col("bucket"))).alias("edge")), "mix-cut", True)
    same = F.col("src").eqNullSafe(F.col("_src"))
    near = join_small(known, cut, same).where(F.col("bucket") == F.col("edge"))
    near = near.withColumn("upto", F.col("fit") + F.sum("size").over(Window.partitionBy("src").orderBy("rank", "u")))
    ends = (near.groupBy(F.col("src").alias("_s2")).agg(
        F.max(F.when(F.col("upto") <= F.col("need"), F.struct("rank", "u"))).alias("last"),
        F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))).alias("got")))
    cut = materialize(cut.join(ends, F.col("_src").eqNullSafe(F.col("_s2")), "left").drop("_s2")
                      .withColumn("got", F.coalesce("got", "fit")), "mix-ends", True)
    off = F.abs(F.col("size") - F.col("gap"))
    closing = (drawn(join_small(known, cut, same)).where("rank IS NOT NULL AND NOT inside").where(off < F.col("gap"))
               .groupBy(F.col("src").alias("_s3")).agg(F.min(F.struct(off.alias("off"), "rank", "u")).alias("c")))
    cut = materialize(cut.join(closing, F.col("_src").eqNullSafe(F.col("_s3")), "left").drop("_s3")
                      .withColumn("closing", F.struct("c.rank", "c.u")).drop("c"), "mix-closing", True)
    def taken(x: DataFrame) -> DataFrame:
        y = drawn(join_small(x, cut, same, "left"))
        closes = (F.col("rank") == F.col("closing.rank")) & (F.col("u") == F.col("closing.u")) & ~F.col("inside")
        return y.withColumn("copies", F.col("whole") + F.when(F.col("inside") | F.coalesce(closes, F.lit(False)), F.lit(1)).otherwise(F.lit(0)))

    columns = ["doc_id", "size", F.col("s_size").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"]
    if not rows:
        return taken(known).select(*columns)
    # rows without an equal decide for themselves (a second row of one id and text counts on: ``start``);
    # of equal rows one is read, and takes for all of them
    many = known.where("copies_of > 1 OR start > 0")
    many = materialize(taken(many).groupBy(F.col("ckey").alias("_ckey")).agg(F.count(F.lit(1)).alias("k"), F.sum("copies").alias("all_copies")), "mix-many", True)
    alone = join_small(light, many, F.col("ckey") == F.col("_ckey"), "left")
    one = taken(ranked(alone.where("_ckey IS NULL").withColumn("u", _unit(F.lit(0), seed)), src, buckets)).select(*columns, "row")
    rest = ranked(alone.where("_ckey IS NOT NULL").dropDuplicates(["ckey"]).withColumn("u", F.lit(0.5)), src, buckets)
    rest = rest.withColumn("i", F.explode(F.expr("sequence(0L, k - 1)"))).withColumn(
        "copies", F.expr("all_copies div k + IF(i < all_copies % k, 1L, 0L)"))
    return one.union(rest.select(*columns, "row"))


SQL = rf"""
WITH e0 AS (SELECT doc_id, source AS src, text, coalesce(md5(text), '') AS tkey,
                  row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS rep FROM documents),
d AS (SELECT doc_id, src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tkey || '|' || CAST(rep AS VARCHAR) || '|{SEED}'), 1, 13) AS BIGINT) AS DOUBLE)
                   + 0.5) / 4503599627370496.0 AS u FROM e0),
b AS (SELECT *, CAST(ceil(sqrt(size)) AS BIGINT) AS q FROM d),
p AS (SELECT src, CAST(sum(size) AS BIGINT) AS s_size, CAST(sum(q * size) AS DOUBLE) AS s_q FROM b GROUP BY src),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM p),
o AS (SELECT *, CAST(sum(s_size) OVER () AS DOUBLE) AS total,
             CAST(coalesce(sum(2 * s_size) OVER (ORDER BY 2 * s_size / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped,
             sum(w) OVER (ORDER BY 2 * s_size / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
l AS (SELECT *, (total * 150 / 100 - capped) / ws AS level FROM o),
c AS (SELECT *, arg_min(CASE WHEN level <= 2 * s_size / w THEN level END, CASE WHEN level <= 2 * s_size / w THEN capped END) OVER () AS common FROM l),
t AS (SELECT src, s_size, s_q, coalesce(least(common * w, CAST(2 * s_size AS DOUBLE)), CAST(2 * s_size AS DOUBLE)) AS target FROM c),
n AS (SELECT *, CASE WHEN s_size = 0 THEN 0 ELSE least(floor(target / s_size), 2) END AS whole FROM t),
r AS (SELECT *, target - whole * s_size AS need FROM n),
x AS (SELECT b.*, r.s_size, r.target, r.whole, r.need, least(r.need * b.q / r.s_q, 1.0) AS lam,
             (b.size > 0 AND r.need > 0) AS ok FROM b JOIN r ON b.src IS NOT DISTINCT FROM r.src),
k AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN lam < 1 THEN (u / (1 - u)) * ((1 - lam) / lam) ELSE 0.0 END AS rank FROM x),
s AS (SELECT *, rank IS NOT NULL AND sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY src ORDER BY rank NULLS LAST, u) <= need AS inside FROM k),
g AS (SELECT *, need - coalesce(sum(CASE WHEN inside THEN size END) OVER (PARTITION BY src), 0) AS gap FROM s),
e AS (SELECT *, CASE WHEN rank IS NOT NULL AND NOT inside AND abs(size - gap) < gap THEN row_number() OVER (
        PARTITION BY src ORDER BY CASE WHEN rank IS NOT NULL AND NOT inside AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), rank, u) END AS pick FROM g)
SELECT doc_id, size, s_size AS source_size, target,
       CAST(size * (whole + CASE WHEN inside OR coalesce(pick = 1, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
"""
