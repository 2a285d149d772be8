"""Loosely typed JSON messages, held as VARIANT so that absent and null stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "map<string,variant>"

# Fixed value: the format of a timestamp that is text.
TEXT_TIME_FORMAT = "yyyyMMdd HH:mm:ss.SSSSSS"

# The first and the last second of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799

# Keys that a scored sentence sets itself, over any incoming key of that name.
SENTENCE_KEYS = ("start_time", "end_time", "score", "score_detail")


def parse_record(value: Column) -> Column:
    """JSON text to a record; NULL for bad JSON and non-objects.

    Of a repeated key the last value counts in a session with ``session.CONF``, as all jobs have it;
    in others the result is NULL.
    """
    return F.try_variant_get(F.try_parse_json(value), "$", RECORD)


def as_variant(value: Column) -> Column:
    return value.cast("variant")


def get_string(record: Column, key: str) -> Column:
    return F.try_variant_get(record[key], "$", "string")


def get_path(document: Column, path: str, kind: str, default: Column | None = None) -> Column:
    """Dotted-path look-up in a VARIANT, with a default where the path is missing."""
    found = F.try_variant_get(document, f"$.{path}", kind)
    return found if default is None else F.coalesce(found, default)


def default_timestamp(record: Column, now: Column) -> Column:
    """Add ``timestamp`` where the key is absent; a null that is present is kept."""
    added = F.map_concat(record, F.create_map(F.lit("timestamp"), as_variant(now)))
    return F.when(F.map_contains_key(record, "timestamp"), record).when(record.isNotNull(), added)


def epoch_timestamp(record: Column) -> Column:
    """``timestamp`` as whole seconds, where it is a number."""
    return F.try_variant_get(record["timestamp"], "$", "bigint")


def seconds_time(seconds: Column) -> Column:
    """Seconds since 1970 as a point in time; NULL outside the years 1 to 9999.

    A sender may put milli- or microseconds there. Without the bound, a cast would stop the job
    or move a stream's clock into the far future.
    """
    return F.when(seconds.between(FIRST_SECOND, LAST_SECOND), F.timestamp_seconds(seconds))


def payload_time(record: Column) -> Column:
    """``timestamp`` as a point in time: seconds (whole or not) or formatted text."""
    seconds = F.try_variant_get(record["timestamp"], "$", "double")
    return F.coalesce(
        seconds_time(seconds),
        F.try_to_timestamp(get_string(record, "timestamp"), F.lit(TEXT_TIME_FORMAT)),
    )


def segments(record: Column) -> Column:
    """``text`` as a list of records: text becomes one segment, a list is taken as it is.

    NULL where ``text`` is missing or neither; a list element that is no object is NULL.
    """
    text = record["text"]
    listed = F.try_variant_get(text, "$", f"array<{RECORD}>")
    single = F.when(F.schema_of_variant(text) == "STRING", F.array(F.create_map(F.lit("text"), text)))
    return F.coalesce(listed, single)


def passthrough(record: Column, strict: bool = True) -> Column:
    """Keys that a sentence takes over from its message.

    The strict rule drops every key that is a piece of the word ``text`` (``t``, ``ex``
    and so on, and the empty key); otherwise only ``text`` itself is dropped.
    """
    if strict:
        return F.map_filter(record, lambda key, _: ~F.contains(F.lit("text"), key))
    return F.map_filter(record, lambda key, _: key != "text")


def without_keys(record: Column, *keys: str) -> Column:
    return F.map_filter(record, lambda key, _: ~key.isin(*keys))


def decode_push_envelope(body: Column) -> Column:
    """The JSON text inside a push request: ``message.data`` is base64."""
    data = F.get_json_object(body, "$.message.data")
    return F.decode(F.try_to_binary(data, F.lit("base64")), "UTF-8")
