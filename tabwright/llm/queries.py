"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bloom_lm, compress_quality, euclid_lsh, jaccard_join, langid, lexical_search, mixing, packing, pii, quality_rules,
               sharding, warc, whitening)
from .common import read_table
from .registry import ORACLES, QUERIES, query


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs, model, keep=("held_out",))


@query("op7_quality_rules", quality_rules.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(read_table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.policy_mask("v1"))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), "kept")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op9_bloom_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", bloom_lm.held_out())
    return bloom_lm.score(docs, docs.where("NOT held_out"), keep=("held_out",), least_pair=1)


@query("op10_mixing", mixing.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("copies")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_arc_to_warc", warc.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).drop("record_id", "refers_to_record")


@query("op3_euclid_lsh")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return euclid_lsh.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query("op11_compression_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = compress_quality.held_out()
    model = compress_quality.train(docs.where(~held_out), labels.where(~held_out))
    return compress_quality.score(docs, model).withColumn("held_out", held_out)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where the deviation is beyond a long (n of hundreds of millions): the operator's is a decimal."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op13_lexical_search", lexical_search.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
