"""Source / sink queries (A1, A2, A6).  Files are written under the shared
``spark.checkpoint.dir`` (one fresh folder per call)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import select as SEL
from ..sources import csv as CSV
from ..sources import sinks as SK
from ..sources.registry import work_dir
from ..sources.tables import read_table
from .q_clean import _clean_data_sql, q_clean_data
from .q_models import doc_trainset
from .registry import query


def _fresh(spark, name):
    return work_dir(spark, f"{name}-{uuid.uuid4().hex[:10]}")


@query("csv_scan", sql="""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  c_name || ', "quoted"' || chr(10) || 'next line' AS note FROM customer""")
def q_csv_scan(spark, sf_dir):
    """customer written as CSV with padded header names and 'NA' / 'null' tokens, scanned back."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    out = c.select(k.alias(" c_custkey "), F.col("c_name").alias("c_name "), F.col("c_nationkey").alias("  c_nationkey"),
                   F.when(k % 11 == 0, F.lit("null")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
                   F.when(k % 7 == 0, F.lit("NA")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
                   F.concat(F.col("c_name"), F.lit(', "quoted"\nnext line')).alias("note"))
    path = _fresh(spark, "csv")
    SK.write_table(out, path, fmt="csv")
    return CSV.read_csv(spark, path)


@query("sink_roundtrip", sql=_clean_data_sql())
def q_sink_roundtrip(spark, sf_dir):
    """The cleaned fixture written as parquet and read back."""
    path = _fresh(spark, "cleaned")
    SK.write_table(q_clean_data(spark, sf_dir), path)
    return SK.read_back(spark, path)


@query("model_store")
def q_model_store(spark, sf_dir):
    """Preprocessing + logistic model saved as one PipelineModel, loaded, applied to the hold-out rows."""
    s, ts = doc_trainset(spark, sf_dir)
    pre, model = SEL.fit_final(ts, "Logistic Regression", None)
    path = _fresh(spark, "model")
    SK.save_model(pre.model, model, path, ts.labels)
    loaded = SK.load_model(path)
    test = s.where(F.col("split") == "test")
    return loaded.transform(test).select("doc_id", F.col("quality").cast("string").alias("actual"),
                                         F.col("predicted").alias("prediction"))


@query("predict_stream")
def q_predict_stream(spark, sf_dir):
    """H1 over a stream: the hold-out documents are landed as parquet files and
    scored by the saved pipeline in a Structured Streaming query (available-now)."""
    from ..streaming.scoring import read_scored, score_stream
    s, ts = doc_trainset(spark, sf_dir)
    pre, model = SEL.fit_final(ts, "Logistic Regression", None)
    base = _fresh(spark, "stream")
    pipe = SK.save_model(pre.model, model, base + "/model", ts.labels)
    landing = s.where(F.col("split") == "test").drop("split")
    landing.repartition(4).write.parquet(base + "/landing")
    score_stream(spark, pipe, base + "/landing", landing.schema, base + "/scored", base + "/checkpoint",
                 ["doc_id", "quality"], max_files_per_trigger=2)
    return read_scored(spark, base + "/scored")
