"""From raw JSON messages to scored messages, sentence rows and envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions import records
from banterscope.operators.scoring import Scorer

RowHook = Callable[[DataFrame], DataFrame]


def parse_events(messages: DataFrame, value: str = "value", into: str = "event") -> DataFrame:
    """Add the parsed record; it is NULL for a message that is no JSON object.

    The record comes out of a generator, which no later filter moves across: without it,
    every filter on the record would repeat the parsing on its way down to the scan.
    """
    parsed = F.explode_outer(F.array(records.parse_record(F.col(value))))
    return messages.select("*", parsed.alias(into))


def quarantine(parsed: DataFrame, event: str = "event") -> DataFrame:
    """Messages that could not be parsed, with their raw value."""
    return parsed.where(F.col(event).isNull()).drop(event)


def with_event_columns(
    parsed: DataFrame,
    cfg: PipelineConfig,
    now: Column | None = None,
    publish_time: str | None = "publish_time",
    keep_unparsed: bool = False,
) -> DataFrame:
    """Default the timestamp and lift the typed columns out of the parsed record.

    ``now`` is whole seconds; in a stream it is frozen per micro-batch, in tests a literal.
    Messages that did not parse are dropped, unless the caller wants to store them too.
    """
    now = F.unix_timestamp() if now is None else now
    kept = parsed if keep_unparsed else parsed.where(F.col("event").isNotNull())
    stamped = kept.withColumn("event", records.default_timestamp(F.col("event"), now))
    event = F.col("event")
    clock = records.payload_time(event) if cfg.event_time == "payload" else F.col(publish_time)
    return (
        stamped.withColumn("userid", records.get_string(event, "userid"))
        .withColumn("timestamp", records.epoch_timestamp(event))
        .withColumn("event_time", clock)
        .withColumn("callback_url", records.get_string(event, "callback_url"))
    )


def score_messages(events: DataFrame, scorer: Scorer, cfg: PipelineConfig) -> DataFrame:
    """Score every sentence of every message; row-local for column and pandas scorers.

    Expects ``message_id`` and ``event``. Adds ``is_fallback`` and ``sentences``. One
    sentence that cannot be scored turns the whole message into a single fallback entry,
    which keeps the original text and has no times and no detail. A message that did not
    parse has no sentences at all.
    """
    event = F.col("event")
    segmented = events.withColumn("_segments", records.segments(event))
    texts = F.transform("_segments", lambda s: records.get_string(s, "text"))
    scored = scorer.attach(segmented.withColumn("_texts", texts), texts="_texts", into="_scores")

    # A NULL list means that scoring failed; an empty one is a message without sentences.
    failed = (
        F.col("_segments").isNull()
        | F.exists("_texts", lambda t: t.isNull())
        | F.col("_scores").isNull()
        | F.exists("_scores", lambda s: s["score"].isNull())
    )
    flagged = scored.withColumn("is_fallback", event.isNotNull() & F.coalesce(failed, F.lit(True)))

    def time_of(segment: Column, key: str) -> Column:
        present = F.map_contains_key(segment, key)
        return F.when(present, records.get_string(segment, key)).otherwise("")

    def sentence(part: Column) -> Column:
        return F.struct(
            time_of(part["_segments"], "start_time").alias("start_time"),
            time_of(part["_segments"], "end_time").alias("end_time"),
            part["_texts"].alias("text"),
            part["_scores"]["score"].alias("score"),
            part["_scores"]["detail"].alias("detail"),
        )

    parts = F.arrays_zip("_segments", "_texts", "_scores")
    nothing = F.lit(None).cast("string")
    fallback = F.array(
        F.struct(
            nothing.alias("start_time"),
            nothing.alias("end_time"),
            event["text"].cast("string").alias("text"),
            F.lit(cfg.fallback_score).alias("score"),
            F.lit(None).cast("map<string,double>").alias("detail"),
        )
    )
    return flagged.withColumn(
        "sentences",
        F.when(F.col("is_fallback"), fallback).when(event.isNotNull(), F.transform(parts, sentence)),
    ).drop("_segments", "_texts", "_scores")


def with_envelope(scored: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Add ``envelope``: one JSON array per message, with one object per sentence.

    Each object has the message's other keys, the sentence's own ones, and
    ``score_detail``. Keys whose value is null are written.
    """
    event = F.col("event")
    others = records.without_keys(
        records.passthrough(event, cfg.strict_key_filter), *records.SENTENCE_KEYS, "text"
    )

    # The other keys are written once per message, and each sentence once by itself; joined
    # as text they give the objects. Far cheaper than building each object whole.
    keep_nulls = {"ignoreNullFields": "false"}
    once = scored.withColumn("_others", F.to_json(others, keep_nulls))
    written = F.col("_others")
    head = F.when(written == "{}", F.lit("{")).otherwise(
        F.concat(F.substr(written, F.lit(1), F.length(written) - 1), F.lit(","))
    )

    def body(sentence: Column) -> Column:
        detail = F.struct(sentence["score"].alias("score"), sentence["detail"].alias("detail"))
        own = F.struct(
            sentence["start_time"].alias("start_time"),
            sentence["end_time"].alias("end_time"),
            sentence["text"].alias("text"),
            sentence["score"].alias("score"),
            detail.alias("score_detail"),
        )
        return F.substr(F.to_json(own, keep_nulls), F.lit(2))

    bodies = F.transform("sentences", body)
    # By name, as the Python function takes no column for what goes between.
    joined = F.call_function("array_join", bodies, F.concat(F.lit(","), head))
    objects = F.concat(F.lit("["), head, joined, F.lit("]"))

    plain = F.struct(F.lit(cfg.fallback_score).alias("score"))
    whole_event = F.map_concat(
        records.without_keys(event, "score", "score_detail"),
        F.create_map(
            F.lit("score"), records.as_variant(F.lit(cfg.fallback_score)),
            F.lit("score_detail"), F.to_variant_object(plain),
        ),
    )
    envelope = (
        F.when(F.col("is_fallback"), F.to_json(F.array(whole_event), keep_nulls))
        .when(F.size("sentences") == 0, F.lit("[]"))
        .when(event.isNotNull(), objects)
    )
    return once.withColumn("envelope", envelope).drop("_others")


def as_bytes(envelopes: DataFrame, column: str = "envelope", into: str = "value") -> DataFrame:
    """The UTF-8 bytes that a topic takes."""
    return envelopes.withColumn(into, F.encode(F.col(column), "UTF-8"))


def explode_sentences(scored: DataFrame) -> DataFrame:
    """One row per sentence; a message without sentences gives no row.

    ``explode`` would first filter on the size of the list and so compute it twice;
    ``explode_outer`` does not, and its empty rows are dropped after it.
    """
    exploded = scored.withColumn("sentence", F.explode_outer("sentences")).drop("sentences")
    return exploded.where(F.col("sentence").isNotNull())


def warehouse_rows(scored: DataFrame) -> DataFrame:
    """The four warehouse columns, one row per sentence."""
    return explode_sentences(scored).select(
        F.col("userid"),
        F.col("timestamp"),
        F.col("sentence.text").alias("text"),
        F.col("sentence.score").alias("score"),
    )


def keyed_scores(scored: DataFrame) -> DataFrame:
    """``(userid, event_time, score)`` for windows; a message without user has no place there."""
    return explode_sentences(scored.where(F.col("userid").isNotNull())).select(
        "userid", "event_time", F.col("sentence.score").alias("score")
    )


def alert_rows(scored: DataFrame) -> DataFrame:
    """``(userid, source, event_time, publish_time, score)``: what alerts by the sources' clocks need."""
    return explode_sentences(scored.where(F.col("userid").isNotNull())).select(
        "userid", "source", "event_time", "publish_time", F.col("sentence.score").alias("score")
    )


def without_user(scored: DataFrame) -> DataFrame:
    """Messages that are scored and published but cannot be put into user windows."""
    return scored.where(F.col("userid").isNull())


def post_process(scored: DataFrame, hook: RowHook | None = None) -> DataFrame:
    """The user's extension point before publishing; does nothing by default."""
    return scored if hook is None else scored.transform(hook)


def callback_outbox(envelopes: DataFrame, envelope: str = "envelope") -> DataFrame:
    """One ``(callback_url, payload)`` row per envelope entry that names a callback."""
    entries = F.try_variant_get(F.try_parse_json(F.col(envelope)), "$", "array<variant>")
    exploded = envelopes.select(F.explode_outer(entries).alias("entry"))
    return exploded.select(
        F.try_variant_get("entry", "$.callback_url", "string").alias("callback_url"),
        F.to_json("entry").alias("payload"),
    ).where(F.col("callback_url").isNotNull())
