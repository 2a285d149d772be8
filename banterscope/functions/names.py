"""Object and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a piece of an address looks like that names an audio file.
AUDIO_NAME = r"[a-zA-Z0-9\-_ ()]+\.(wav|mp3|flac)"


def audio_file_name(url: Column, now: Column) -> Column:
    """A safe file name from an audio address.

    Takes the first piece that looks like an audio file, replaces other characters by
    ``_`` and drops everything before the first letter. A name of digits only therefore
    loses its extension (``123.mp3`` becomes ``mp3``). An address without an audio file
    gives ``noid_{now}.mp3``.
    """
    found = F.regexp_extract(F.lower(url), AUDIO_NAME, 0)
    clean = F.regexp_replace(F.regexp_replace(found, r"[^a-zA-Z0-9.]", "_"), r"^[^a-zA-Z]+", "")
    missing = F.concat(F.lit("noid_"), now.cast("string"), F.lit(".mp3"))
    return F.when(clean == "", missing).otherwise(F.coalesce(clean, missing))


def with_extension(name: Column, extension: str) -> Column:
    """Swap the last lower-case extension; a name without one is left alone."""
    return F.regexp_replace(name, r"\.[a-z0-9]+$", f".{extension}")


def flac_name(audio_name: Column) -> Column:
    return with_extension(F.lower(audio_name), "flac")


def sidecar_name(audio_name: Column) -> Column:
    return with_extension(audio_name, "json")


def long_result_name(object_name: Column) -> Column:
    """Result name of a long recording. Case-sensitive, and any character may precede ``flac``."""
    return F.regexp_replace(object_name, ".flac$", ".json")


def short_metadata_name(object_name: Column) -> Column:
    """Where the request metadata of a short recording lies."""
    return F.replace(F.lower(object_name), F.lit(".flac"), F.lit(".json"))


def short_result_name(object_name: Column, now: Column) -> Column:
    stem = F.replace(object_name, F.lit(".flac"), F.lit(""))
    return F.concat(stem, F.lit("_"), now.cast("string"), F.lit(".json"))


def message_name(userid: Column, now: Column) -> Column:
    """``{lower(userid)}_{now}.json``, or ``{now}.json`` without a user."""
    prefix = F.coalesce(F.concat(F.lower(userid), F.lit("_")), F.lit(""))
    return F.concat(prefix, now.cast("string"), F.lit(".json"))


def is_flac(object_name: Column) -> Column:
    """Case-insensitive, blanks after the name do not matter."""
    return F.lower(object_name).rlike(r"\.flac\s*$")
