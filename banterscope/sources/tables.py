"""Bounded inputs: labelled comments, transcripts, request metadata, stored features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.schema import SCORED_MESSAGE, STT_RESULT, TRAINING


def labelled_comments(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``comment_text,target``; comments may hold quotes and line breaks."""
    reader = spark.read.schema(TRAINING).option("header", True).option("enforceSchema", False)
    return reader.option("multiLine", True).option("escape", '"').csv(path)


def stt_results(spark: SparkSession, path: str) -> DataFrame:
    """One transcription file per row: ``object_name, results``."""
    files = spark.read.schema(STT_RESULT).option("multiLine", True).json(path)
    return files.select(F.col("_metadata.file_name").alias("object_name"), "results")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Request metadata by object name; the JSON stays as it is. Names are compared in lower case."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path)
    return files.select(
        F.lower(F.col("_metadata.file_name")).alias("object_name"), F.col("value").alias("metadata")
    )


def features(spark: SparkSession, path: str) -> DataFrame:
    """Stored ``(text, label)`` examples."""
    return spark.read.parquet(path)


def scored_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The scored table as a stream; every consumer reads this, so scoring runs once."""
    reader = spark.readStream.schema(SCORED_MESSAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def scored_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED_MESSAGE).parquet(path)
