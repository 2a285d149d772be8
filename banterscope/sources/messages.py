"""Raw messages, from a topic or from a drop-zone of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _message_columns(kafka: DataFrame) -> DataFrame:
    place = F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return kafka.select(
        place.alias("message_id"),
        F.decode("value", "UTF-8").alias("value"),
        F.col("timestamp").alias("publish_time"),
        F.concat_ws("/", "topic", F.col("partition").cast("string")).alias("source"),
    )


def topic_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Unbounded messages of a topic. Needs the Kafka connector on the class path.

    Bound a micro-batch with ``maxOffsetsPerTrigger``, and split large topic partitions
    with ``minPartitions``.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return _message_columns(reader.option("subscribe", topic).options(**options).load())


def topic_batch(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A bounded range of a topic, for replay."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers)
    return _message_columns(reader.option("subscribe", topic).options(**options).load())


def _folder() -> Column:
    """The folder of a file: files that are put side by side are one source."""
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("source")


def _file_columns(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("_metadata.file_path").alias("message_id"),
        F.col("value"),
        F.col("_metadata.file_modification_time").alias("publish_time"),
        _folder(),
    )


def drop_zone_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Every new JSON file is one message."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _file_columns(reader.load(path))


def drop_zone_batch(spark: SparkSession, path: str) -> DataFrame:
    return _file_columns(spark.read.format("text").option("wholetext", True).load(path))


def line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files with one JSON message per line, the layout for many messages.

    Lines have no number in a stream: the id is the file and a digest of the line, so
    equal lines of a file share it. Row-local scorers do not mind.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _line_columns(reader.load(path), F.sha2("value", 256))


def line_batch(spark: SparkSession, path: str) -> DataFrame:
    """The same for replay in batch; the id is unique, so any scorer can be used."""
    lines = spark.read.format("text").load(path)
    return _line_columns(lines, F.monotonically_increasing_id().cast("string"))


def _line_columns(lines: DataFrame, line: Column) -> DataFrame:
    return lines.select(
        F.concat_ws("#", F.col("_metadata.file_path"), line).alias("message_id"),
        F.col("value"),
        F.col("_metadata.file_modification_time").alias("publish_time"),
        _folder(),
    )
