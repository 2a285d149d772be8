"""Audio requests and transcripts: naming, routing, regrouping, joining the metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions import names, text
from banterscope.operators.ordering import with_previous

# The language that needs no translation, the times of the single segment of a
# short recording, and the start of the first segment of a long one.
HOME_LANGUAGE = "en-us"
SHORT_START, SHORT_END = "0s", "59s"
FIRST_START = "0s"


def audio_manifest(requests: DataFrame, now: Column, uri: str = "audio_uri") -> DataFrame:
    """Add the file name, the names derived from it, and whether a recogniser takes it."""
    return (
        requests.withColumn("file_name", names.audio_file_name(F.col(uri), now))
        .withColumn("flac_name", names.flac_name(F.col("file_name")))
        .withColumn("sidecar_name", names.sidecar_name(F.col("file_name")))
        .withColumn("is_flac", names.is_flac(F.col("file_name")))
    )


def name_collisions(manifest: DataFrame) -> DataFrame:
    """File names that more than one request maps to (digits-only names, for one)."""
    counts = manifest.groupBy("file_name").agg(F.count(F.lit(1)).alias("requests"))
    return counts.where(F.col("requests") > 1)


def route_audio(requests: DataFrame, cfg: PipelineConfig, seconds: str = "duration") -> DataFrame:
    """``short`` under a minute, ``long`` from a minute on, ``rejected`` where unknown."""
    length = F.col(seconds)
    route = (
        F.when(length.isNull(), F.lit("rejected"))
        .when(length < cfg.short_audio_seconds, F.lit("short"))
        .otherwise(F.lit("long"))
    )
    return requests.withColumn("route", route)


def transcripts_of(results: Column) -> Column:
    """The first alternative of every result; NULL where one is missing."""
    return F.transform(results, lambda r: F.get(r["alternatives"], 0)["transcript"])


def is_broken_result(results: Column) -> Column:
    """A file without results, or with a result that has no alternative."""
    return results.isNull() | F.exists(results, lambda r: F.coalesce(F.size(r["alternatives"]), F.lit(0)) < 1)


def regroup_long(results: Column) -> Column:
    """Segments of a long recording: each starts where the one before ended.

    Repeated transcripts stay; they are separate segments.
    """
    ends = F.transform(results, lambda r: r["resultEndTime"])
    starts = F.slice(F.concat(F.array(F.lit(FIRST_START)), ends), 1, F.size(results))

    def segment(result: Column, start: Column) -> Column:
        return F.struct(
            F.get(result["alternatives"], 0)["transcript"].alias("text"),
            start.alias("start_time"),
            result["resultEndTime"].alias("end_time"),
        )

    return F.zip_with(results, starts, segment)


def regroup_long_rows(
    rows: DataFrame, file: str, position: str, end_time: str, rows_per_slice: int = 65536
) -> DataFrame:
    """The same for results that lie one per row: adds ``start_time``.

    A file of any length is looked back over in slices of its positions.
    """
    slice_of = F.floor(F.col(position) / F.lit(rows_per_slice))
    seen = with_previous(rows, [file], position, slice_of, F.col(end_time), "_before")
    return seen.withColumn("start_time", F.coalesce("_before", F.lit(FIRST_START))).drop("_before")


def merge_short(results: Column) -> Column:
    """All text of a short recording: each transcript once, in order."""
    return text.ordered_distinct_join(transcripts_of(results))


def short_segment(merged: Column) -> Column:
    """The single segment that a short recording gives."""
    return F.array(
        F.struct(
            merged.alias("text"),
            F.lit(SHORT_START).alias("start_time"),
            F.lit(SHORT_END).alias("end_time"),
        )
    )


def detected_language(results: Column) -> Column:
    """Language of the first result, the home language if there is none."""
    return F.coalesce(F.get(results, 0)["languageCode"], F.lit(HOME_LANGUAGE))


def needs_translation(language: Column, enabled: bool) -> Column:
    return F.lit(enabled) & (F.lower(F.coalesce(language, F.lit(HOME_LANGUAGE))) != HOME_LANGUAGE)


def route_language(
    transcripts: DataFrame,
    translations: DataFrame,
    key: str,
    cfg: PipelineConfig,
    language: str = "language",
    original: str = "text",
) -> DataFrame:
    """Replace the text by its translation where the language calls for one.

    ``translations`` has ``(key, pieces ARRAY<STRING>)``. Only the rows that need it go
    through the join, which is on a unique key; the others are never shuffled.
    """
    routed = transcripts.withColumn("needs_translation", needs_translation(F.col(language), cfg.translate))
    if not cfg.translate:
        return routed.withColumn("final_text", F.col(original))
    foreign = routed.where("needs_translation").join(
        translations.select(key, text.join_pieces(F.col("pieces")).alias("_translated")), key, "left"
    )
    translated = foreign.withColumn("final_text", F.coalesce("_translated", original)).drop("_translated")
    home = routed.where(~F.col("needs_translation")).withColumn("final_text", F.col(original))
    return home.unionByName(translated)


def attach_metadata(transcripts: DataFrame, metadata: DataFrame, key: str = "object_name") -> DataFrame:
    """Transcripts with their request metadata; ``error`` tells where that is missing.

    Both sides are keyed by object name, which is unique in a store, so the join spreads
    evenly. Rows without an error are the result, the others yield nothing but the error.
    """
    found = metadata.withColumn("_found", F.lit(True))
    joined = transcripts.join(found, key, "left")
    error = F.when(F.col("_found").isNull(), F.lit("metadata missing"))
    return joined.withColumn("error", error).drop("_found")
