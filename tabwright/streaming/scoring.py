"""Batch prediction (H1) over a file stream with Structured Streaming.

A fitted ``PipelineModel`` (preprocessing + estimator; every stage is
stateless at transform time) is applied to parquet files as they arrive and
the predictions are appended to a parquet sink.  The streaming checkpoint
lives under the shared ``spark.checkpoint.dir``, so a restarted query (or a
lost executor) resumes exactly-once from the last committed batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType, sink_dir: str,
                 checkpoint_location: str, keep: list[str], available_now: bool = True,
                 max_files_per_trigger: int | None = None):
    """Start (and with ``available_now`` run to completion) the scoring stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    scored = model.transform(stream).select(*keep, F.col("predicted").alias("prediction"))
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def read_scored(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)
