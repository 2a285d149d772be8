"""From recognition results and request metadata to messages in the text drop-zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions import names, records
from banterscope.operators import audio
from banterscope.session import materialise
from banterscope.sinks.batch import write_transcripts
from banterscope.sources import tables


def _broken() -> Column:
    """One missing transcript fails its whole file. Told before the join, so that the raw
    results need not go through it."""
    return F.when(audio.is_broken_result(F.col("results")), F.lit("transcript missing"))


def _joined(spoken: DataFrame, metadata: DataFrame) -> DataFrame:
    found = audio.attach_metadata(spoken, metadata)
    return found.withColumn("error", F.coalesce("_broken", "error")).drop("_broken")


def long_transcripts(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """``object_name, segments, metadata, error`` of long recordings.

    ``results`` has ``(object_name, results)``, ``metadata`` has ``(object_name, metadata)``;
    both go by the same name, whose case does not matter.
    """
    named = results.select(
        F.lower("object_name").alias("object_name"),
        _broken().alias("_broken"),
        audio.regroup_long(F.col("results")).alias("segments"),
    )
    return _joined(named, metadata)


def short_transcripts(
    results: DataFrame,
    metadata: DataFrame,
    cfg: PipelineConfig,
    now: Column | None = None,
    translations: DataFrame | None = None,
) -> DataFrame:
    """The same for short recordings, whose results go by the name of the sound file.

    Only ``.flac`` objects count. Adds the name of the message file as ``result_name``,
    and a timestamp to metadata that has none.
    """
    now = F.unix_timestamp() if now is None else now
    spoken = results.where(names.is_flac(F.col("object_name"))).select(
        F.col("object_name").alias("sound_name"),
        names.short_metadata_name(F.col("object_name")).alias("object_name"),
        _broken().alias("_broken"),
        audio.merge_short(F.col("results")).alias("text"),
        audio.detected_language(F.col("results")).alias("language"),
    )
    if translations is not None:
        renamed = translations.withColumnRenamed("object_name", "sound_name")
        spoken = audio.route_language(spoken, renamed, "sound_name", cfg)
    else:
        spoken = spoken.withColumn("final_text", F.col("text"))
    joined = _joined(spoken, metadata)
    stamped = records.default_timestamp(records.parse_record(F.col("metadata")), now)
    return joined.select(
        "object_name",
        names.short_result_name(F.col("sound_name"), now).alias("result_name"),
        audio.short_segment(F.col("final_text")).alias("segments"),
        F.to_json(stamped, {"ignoreNullFields": "false"}).alias("metadata"),
        "error",
    )


def deliver(found: DataFrame, drop_zone: str, errors: str, delivered: str) -> None:
    """New messages go to the drop-zone, what failed to ``errors``.

    ``delivered`` is a table of the object names that have been written, so a second run over the same files, or over
    more of them, adds only what is new; what failed is tried again, and told once for each reason. Messages are
    written before their names: a run that ends between the two writes its messages once more.
    """
    spark = found.sparkSession
    spark.createDataFrame([], "object_name string, result_name string").write.mode("ignore").parquet(delivered)
    spark.createDataFrame([], "object_name string, error string").write.mode("ignore").parquet(errors)
    fresh = materialise(found.join(spark.read.parquet(delivered), "object_name", "left_anti"), "transcripts")
    told = spark.read.parquet(errors)
    failed = fresh.where(F.col("error").isNotNull()).select("object_name", "error").distinct()
    materialise(failed.join(told, ["object_name", "error"], "left_anti"), "failed").write.mode("append").parquet(errors)
    good = fresh.where(F.col("error").isNull())
    write_transcripts(good, drop_zone)
    good.select("object_name", "result_name").write.mode("append").parquet(delivered)


def run_long(spark: SparkSession, results: str, sidecars: str, drop_zone: str, errors: str, delivered: str | None = None) -> None:
    """Result files and sidecars of long recordings to messages; what failed goes to a table of its own."""
    found = long_transcripts(tables.stt_results(spark, results), tables.sidecars(spark, sidecars))
    deliver(found.withColumn("result_name", F.col("object_name")), drop_zone, errors, delivered or f"{errors.rstrip('/')}_delivered")


def run_short(
    spark: SparkSession, results: str, sidecars: str, drop_zone: str, errors: str, cfg: PipelineConfig,
    delivered: str | None = None, translations: DataFrame | None = None,
) -> None:
    """The same for short recordings; a result file has the name of its sound file."""
    found = short_transcripts(tables.stt_results(spark, results), tables.sidecars(spark, sidecars), cfg, translations=translations)
    deliver(found, drop_zone, errors, delivered or f"{errors.rstrip('/')}_delivered")
