"""Bounded outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banterscope.functions import names, records


def with_event_date(rows: DataFrame, clock: Column) -> DataFrame:
    return rows.withColumn("event_date", F.to_date(clock))


def append_warehouse(rows: DataFrame, path: str) -> None:
    """Append the four warehouse columns, partitioned by day of their timestamp; no day if it is out of range."""
    dated = with_event_date(rows, records.seconds_time(F.col("timestamp")))
    dated.write.mode("append").partitionBy("event_date").parquet(path)


def write_messages(messages: DataFrame, path: str, now: Column) -> None:
    """Put request messages ``(userid, value)`` into the drop-zone as JSON lines.

    The name a message would have as a file of its own becomes the column
    ``object_name``: one small file per message is no layout for many messages.
    """
    named = messages.select(names.message_name(F.col("userid"), now).alias("object_name"), "value")
    named.write.mode("append").json(path)


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """Metadata with its segments, as messages for the text drop-zone.

    ``metadata`` is the request JSON; its ``text`` is replaced by ``segments``.
    """
    record = records.parse_record(F.col("metadata"))
    text = F.create_map(F.lit("text"), F.to_variant_object("segments"))
    merged = F.map_concat(records.without_keys(record, "text"), text)
    transcripts.select(F.to_json(merged).alias("value")).write.mode("append").text(path)


def write_features(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").parquet(path)


def write_outbox(outbox: DataFrame, path: str) -> None:
    """Callbacks that wait for delivery: ``(callback_url, payload)``."""
    outbox.write.mode("append").parquet(path)
