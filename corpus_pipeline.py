"""A training-data pipeline: five stages over ``documents``, each an operator of ``tabwright.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``; other columns than doc_id, text, lang and
source are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import jaccard_join, langid, mixing, packing, pii
from tabwright.llm.common import discard, join_small, materialize, read_table

#: A document whose language is less certain than this is rejected.
LEAST_SCORE = 0.5


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts, texts without a letter and undecided ones go.

    Without any labelled document there is nothing to learn, and only the letters decide."""
    d = docs.withColumn("_row", _row(docs))
    model = langid.train(docs)
    found = langid.predict(d, model, keep=("_row",))
    if not model["langs"]:
        return found.where(F.col("_row.text").rlike(r"\p{L}")).select("_row.*")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id (null is -1), of one id that with the smallest row key.

    Rows are told apart by a digest of all their columns (maps aside), never by their id:
    unlike texts without an id, or under the same one, all stay."""
    parts = [F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    key = F.xxhash64(*parts, *[p.isNull() for p in parts])       # a null alone leaves the digest as it is
    keyed = docs.select(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"), "text")
    found = materialize(jaccard_join.near_duplicates(keyed, "key"), "pipeline-groups")
    rows = found.groupBy(F.col("doc_id").alias("_k")).agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    groups = materialize(found.groupBy(F.col("component_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_c"), "pipeline-copied", True)
    copies = materialize(join_small(rows, groups, F.col("c") == F.col("_c")).select("_k", "c", "n"), "pipeline-copies", True)
    first = materialize(join_small(keyed.select("key", "id"), copies, F.col("key") == F.col("_k")).groupBy(F.col("c").alias("_c"))
                        .agg(F.min(F.struct("id", "key")).alias("l")).select("_c", F.col("l.key").alias("_first")), "pipeline-first", True)
    copies = materialize(join_small(copies, first, F.col("c") == F.col("_c")).select("_k", "n", (F.col("_k") == F.col("_first")).alias("stays")), "pipeline-dropped", True)
    kept = join_small(docs.select(key.alias("key"), _row(docs)), copies, F.col("key") == F.col("_k"), "left").where("_k IS NULL OR stays")
    once = kept.where("_k IS NULL OR n = 1").select("_row.*")
    if not copies.where("stays AND n > 1").limit(1).count():
        return once
    return once.union(kept.where("n > 1").dropDuplicates(["key"]).select("_row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    d = docs.withColumn("_row", _row(docs))
    found = pii.detect(d, pii.train(docs), redact=True, keep=("_row",))
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("redacted").isNull(), F.col("_row.n_chars")).otherwise(F.length("redacted")).cast(docs.schema["n_chars"].dataType)
           if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    taken = mixing.mix(docs, rows=True).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can't express language scores, the field's spans or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is dropped when the next is written."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
