"""Queries over audio requests and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions import names, text
from banterscope.operators import audio
from banterscope.plans import inputs, transcripts_run
from banterscope.plans.inputs import table

TRANSLATING = PipelineConfig(translate=True)


def _line_results() -> Column:
    """The lines of a document as recognition results of seven seconds each."""
    return F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.array(F.struct(line.alias("transcript"))).alias("alternatives"),
            F.concat(((i + 1) * 7).cast("string"), F.lit("s")).alias("resultEndTime"),
            F.lit(audio.HOME_LANGUAGE).alias("languageCode"),
        ),
    )


def stt_long_segments(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "documents").select("doc_id", _line_results().alias("results"))
    regrouped = files.select("doc_id", F.posexplode_outer(audio.regroup_long(F.col("results"))))
    return regrouped.where(F.col("col").isNotNull()).select(
        "doc_id",
        F.col("pos").cast("bigint").alias("position"),
        F.col("col.text").alias("text"),
        F.col("col.start_time").alias("start_time"),
        F.col("col.end_time").alias("end_time"),
    )


def stt_long_regroup(spark: SparkSession, folder: str) -> DataFrame:
    """A conversation is a file, a turn one of its results."""
    end = F.concat(((F.col("turn") + 1) * 7).cast("string"), F.lit("s"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", end.alias("end_time"))
    return audio.regroup_long_rows(rows, "conv_id", "turn", "end_time").select(
        "conv_id", "turn", "start_time", "end_time"
    )


def stt_short_merge(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "documents").select("doc_id", _line_results().alias("results"))
    return files.select("doc_id", audio.merge_short(F.col("results")).alias("text"))


def stt_attach_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is a transcript; the labelled ones have metadata."""
    name = F.concat(F.lit("Rec_"), F.col("doc_id").cast("string"), F.lit(".FLAC"))
    transcripts = table(spark, folder, "documents").select(
        "doc_id", "n_chars", names.short_metadata_name(name).alias("object_name")
    )
    metadata = table(spark, folder, "labels").select(
        F.concat(F.lit("rec_"), F.col("doc_id").cast("string"), F.lit(".json")).alias("object_name"),
        F.col("quality").cast("bigint").alias("quality"),
    )
    return audio.attach_metadata(transcripts, metadata)


def short_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as short recordings, a line each result; the labelled ones have metadata."""
    name = F.concat(F.lit("rec_"), F.col("doc_id").cast("string"), F.lit(".flac"))
    documents = table(spark, folder, "documents").select(name.alias("object_name"), _line_results().alias("results"))
    metadata = table(spark, folder, "labels").select(
        F.concat(F.lit("rec_"), F.col("doc_id").cast("string"), F.lit(".json")).alias("object_name"),
        F.to_json(F.struct(F.col("quality").cast("string").alias("userid"))).alias("metadata"),
    )
    found = transcripts_run.short_transcripts(documents, metadata, TRANSLATING, inputs.now())
    record = F.try_parse_json("metadata")
    return found.select(
        "object_name",
        "result_name",
        F.col("segments")[0]["text"].alias("text"),
        F.try_variant_get(record, "$.userid", "string").alias("userid"),
        F.try_variant_get(record, "$.timestamp", "bigint").alias("timestamp"),
        "error",
    )


def _audio_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses as audio addresses; the ending depends on the length of the address."""
    address = F.split("url", r"\?")[0]
    ending = F.element_at(
        F.array(*map(F.lit, (".MP3", ".wav", ".flac", ".txt"))), (F.length("url") % 4 + 1).cast("int")
    )
    return table(spark, folder, "pages").select("page_id", F.concat(address, ending).alias("audio_uri"))


def audio_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return audio.audio_manifest(_audio_requests(spark, folder), inputs.now()).drop("audio_uri")


def audio_name_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return audio.name_collisions(audio.audio_manifest(_audio_requests(spark, folder), inputs.now()))


def audio_route(spark: SparkSession, folder: str) -> DataFrame:
    """A document takes a tenth of a second per character; the length of German ones is unknown."""
    seconds = F.when(F.col("lang") != "de", F.col("n_chars") / 10)
    requests = table(spark, folder, "documents").select("doc_id", seconds.alias("duration"))
    return audio.route_audio(requests, TRANSLATING).select("doc_id", "route")


def language_route(spark: SparkSession, folder: str) -> DataFrame:
    """German documents have no known language; Spanish ones have a translation."""
    documents = table(spark, folder, "documents")
    lang = F.col("lang")
    known = F.when(lang == "en", "en-US").when(lang != "de", F.concat(lang, F.lit("-"), F.upper(lang)))
    transcripts = documents.select("doc_id", "text", known.alias("language"))
    translations = documents.where(lang == "es").select(
        "doc_id", F.split(F.concat(F.lit(" "), text.ascii_lower(F.col("text"))), "\n").alias("pieces")
    )
    routed = audio.route_language(transcripts, translations, "doc_id", TRANSLATING)
    return routed.select("doc_id", F.col("needs_translation").cast("int").alias("translated"), "final_text")


def object_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of what customers send; events of nobody known have a name without a user."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("userid")
    )
    sent = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    clock = inputs.epoch(F.col("ts"))
    recording = F.concat("event_type", F.lit("."), F.col("event_id").cast("string"), F.lit(".flac"))
    return sent.join(customers, "user_id", "left").select(
        "event_id",
        names.message_name(F.col("userid"), clock).alias("message_name"),
        names.flac_name(F.concat("event_type", F.lit(".MP3"))).alias("flac_name"),
        names.long_result_name(recording).alias("long_name"),
        names.short_result_name(recording, clock).alias("short_name"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        stt_long_segments, stt_long_regroup, stt_short_merge, stt_attach_metadata, short_messages, audio_manifest,
        audio_name_collisions, audio_route, language_route, object_names,
    )
}
