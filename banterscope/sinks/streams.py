"""Streaming outputs. File sinks commit each micro-batch once, also after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

AVAILABLE_NOW = {"availableNow": True}

# Starts a stream, given the stream and the folder of its checkpoint.
Sink = Callable[[DataFrame, str], StreamingQuery]


def _writer(stream: DataFrame, kind: str, checkpoint: str, trigger: dict | None) -> DataStreamWriter:
    writer = stream.writeStream.format(kind).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE_NOW))


def files(
    path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), trigger: dict | None = None
) -> Sink:
    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        writer = _writer(stream, kind, checkpoint, trigger)
        return (writer.partitionBy(*partition_by) if partition_by else writer).start(path)

    return start


def topic(servers: str, name: str, trigger: dict | None = None) -> Sink:
    """The stream has ``value`` and may have ``key``. Needs the Kafka connector."""

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        writer = _writer(stream, "kafka", checkpoint, trigger)
        return writer.option("kafka.bootstrap.servers", servers).option("topic", name).start()

    return start


def console(trigger: dict | None = None) -> Sink:
    """A debug tap."""

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return _writer(stream, "console", checkpoint, trigger).option("truncate", False).start()

    return start
