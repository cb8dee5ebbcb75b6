"""Table and model sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.parquet(path)


def read_back(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


def save_model(preprocessor_model: PipelineModel, estimator_model, path: str, labels: list[str] | None = None) -> PipelineModel:
    """One PipelineModel = preprocessing stages + fitted estimator, saved with MLWriter.

    Its column ``predicted`` has the class name, or the number for a regression (no ``labels``)."""
    named = (IndexToString(inputCol="prediction", outputCol="predicted", labels=labels) if labels
             else SQLTransformer(statement="SELECT *, prediction AS predicted FROM __THIS__"))
    model = PipelineModel(stages=[*preprocessor_model.stages, getattr(estimator_model, "spark_model", estimator_model), named])
    model.write().overwrite().save(path)
    return model


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
