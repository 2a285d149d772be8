"""Queries over messages: parsing, scoring, windows, alerts."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions import probability, records, text
from banterscope.operators import events, windows
from banterscope.operators.scoring import LEXICON, LexiconScorer, PandasScorer, analysis_request
from banterscope.plans import inputs
from banterscope.plans.inputs import epoch, table
from banterscope.schema import FLAG
from banterscope.session import shared_folder
from banterscope.sinks.streams import files
from banterscope.streaming import jobs
from banterscope.streaming.alerts import AlertJob

HOURS = PipelineConfig(window_seconds=6 * 3600, slide_seconds=3600)
# The given events are one bounded input, in which nothing comes late.
HALF_HOUR = PipelineConfig(window_seconds=1800, slide_seconds=300, watermark_delay="0 seconds")
# Three sources, one of which lags by a day; nothing is forgotten.
SOURCES = PipelineConfig(window_seconds=1800, slide_seconds=300, watermark_delay="1 hour", idle_seconds=7200, correct_seconds=-1)
ARRIVALS = 4
PAYLOAD = PipelineConfig(event_time="payload")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _windows_out(found: DataFrame) -> DataFrame:
    return found.select(
        "userid",
        epoch(F.col("window_start")).alias("window_start"),
        epoch(F.col("window_end")).alias("window_end"),
        F.round("score", 6).alias("score"),
    )


def toxic_flags(spark: SparkSession, folder: str) -> DataFrame:
    scores = inputs.chat_scores(spark, folder)
    return _windows_out(windows.toxic_flags(windows.user_window_scores(scores, HOURS), HOURS))


def event_flags(spark: SparkSession, folder: str) -> DataFrame:
    scores = inputs.event_scores(spark, folder)
    return _windows_out(windows.toxic_flags(windows.user_window_scores(scores, HALF_HOUR), HALF_HOUR))


def window_user_avg(spark: SparkSession, folder: str) -> DataFrame:
    return _windows_out(windows.user_window_scores(inputs.event_scores(spark, folder), HALF_HOUR))


def window_user_avg_panes(spark: SparkSession, folder: str) -> DataFrame:
    scores = inputs.event_scores(spark, folder)
    return _windows_out(windows.user_window_scores(scores, HALF_HOUR, panes=True))


def _as_alerts(found: DataFrame) -> DataFrame:
    return found.select("userid", epoch(F.col("window_end")).alias("window_end"), F.round("score", 6).alias("score"))


def _job_session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that the settings of a stream stay with it."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", str(session.sparkContext.defaultParallelism))
    return session


def toxic_flags_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same alerts from the streaming job, with those of the windows that are open when the input ends."""
    root, session = shared_folder(spark, "flags"), _job_session(spark)
    schema = table(spark, folder, "events").schema
    arriving = session.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    rows = arriving.select(
        F.col("user_id").cast("string").alias("userid"),
        F.lit("events").alias("source"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("ts").cast("timestamp").alias("publish_time"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
    )
    job = AlertJob(HALF_HOUR, f"{root}/alerts")
    query = job.start(rows, f"{root}/checkpoint")
    query.awaitTermination()
    open_ones = job.still_open(spark, job.last_version(query))
    return _as_alerts(job.corrected(spark).unionByName(open_ones))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """Events as three sources send them: the second one day late, the third with clocks that err now and then.

    ``arrival`` is the quarter of a day's order in which a row comes in.
    """
    events_in = table(spark, folder, "events")
    source = F.col("event_id") % 3
    ts = F.col("ts").cast("timestamp")
    published = F.when(source == 1, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)
    wrong = (
        F.when(F.col("event_id") % 97 == 2, F.lit(253402000000).cast("timestamp"))  # the year 9999
        .when(F.col("event_id") % 101 == 2, F.timestamp_seconds(F.unix_millis(ts)))  # milliseconds for seconds
        .when(F.col("event_id") % 103 == 2, F.lit(None).cast("timestamp"))
    )
    known = F.coalesce(F.col("event_id") % 97 == 2, F.lit(False)) | (F.col("event_id") % 101 == 2) | (F.col("event_id") % 103 == 2)
    return events_in.select(
        F.col("user_id").cast("string").alias("userid"),
        F.concat(F.lit("s"), source.cast("string")).alias("source"),
        F.when((source == 2) & known, wrong).otherwise(ts).alias("event_time"),
        published.alias("publish_time"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
    )


def _arrived(spark: SparkSession, folder: str) -> tuple[AlertJob, int]:
    """Runs the alert stream over the three sources, in several batches by the time of publishing.

    What has arrived is one batch, in however many files it was written: the steps' number doesn't grow with the input.
    """
    root, session = shared_folder(spark, "sources"), _job_session(spark)
    rows = _sources(spark, folder)
    low, high = rows.agg(F.min("publish_time"), F.max("publish_time")).first()
    arriving = session.readStream.schema(rows.schema).option("recursiveFileLookup", True)
    job, version = AlertJob(SOURCES, f"{root}/alerts"), -1
    for part in range(ARRIVALS if low else 0):
        start, stop = (low + (high - low) * k / ARRIVALS for k in (part, part + 1))
        came = F.col("publish_time") >= F.lit(start)
        came &= F.col("publish_time") < F.lit(stop) if part + 1 < ARRIVALS else F.lit(True)
        rows.where(came).write.parquet(f"{root}/rows/{part}")
        query = job.start(arriving.parquet(f"{root}/rows"), f"{root}/checkpoint")
        query.awaitTermination()
        version = max(version, job.last_version(query))
    return job, version


def alerts_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of three sources with clocks of their own, corrected for what came late."""
    job, version = _arrived(spark, folder)
    return _as_alerts(job.corrected(spark).unionByName(job.still_open(spark, version)))


def rows_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the rows of each source: taken into windows, on time or late, or set aside."""
    job, _ = _arrived(spark, folder)
    taken = job.counts(spark).select("source", F.lit("taken").alias("became"), (F.col("on_time") + F.col("late")).alias("messages"))
    aside = job.out_of_range(spark).select("source", F.lit("set aside").alias("became"), F.lit(1).cast("bigint").alias("messages"))
    return taken.unionByName(aside).groupBy("source", "became").agg(F.sum("messages").cast("bigint").alias("messages"))


def score_text(spark: SparkSession, folder: str) -> DataFrame:
    scored = inputs.scored_documents(spark, folder)
    return scored.select(
        "doc_id",
        F.round("score", 6).alias("score"),
        *[F.round(a.lower(), 6).alias(a.lower()) for a in probability.ATTRIBUTES],
    )


def _python_lexicon():
    """A Python model: the default scorer once more, for texts in batches."""
    groups = [frozenset(words) for words in LEXICON.values()]

    def score(texts: pd.Series) -> pd.DataFrame:
        found = [re.findall("[a-z]+", t.translate(ASCII_LOWER)) for t in texts]
        frame = pd.DataFrame(
            {
                name: [min(0.05 + 0.30 * sum(w in group for w in words), 0.95) for words in found]
                for name, group in zip(LEXICON, groups)
            }
        )
        yes, no = frame.prod(axis=1), (1 - frame).prod(axis=1)
        return frame.assign(score=yes / (yes + no))

    return score


def score_text_pandas(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    listed = documents.select("doc_id", F.array("text").alias("texts"))
    scored = PandasScorer(_python_lexicon).attach(listed, "texts", "scores")
    found = F.col("scores")[0]
    return scored.select(
        "doc_id",
        F.round(found["score"], 6).alias("score"),
        *[F.round(found["detail"][a], 6).alias(a.lower()) for a in probability.ATTRIBUTES],
    )


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    found = turns.select("conv_id", "turn", F.posexplode_outer(text.split_sentences(F.col("text"))))
    return found.where(F.col("col").isNotNull()).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("position"), F.col("col").alias("sentence")
    )


def _scored_conversations(spark: SparkSession, folder: str) -> DataFrame:
    parsed = events.parse_events(inputs.conversation_messages(spark, folder))
    typed = events.with_event_columns(parsed, PAYLOAD, inputs.now())
    return events.score_messages(typed, LexiconScorer(), PAYLOAD)


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = events.warehouse_rows(_scored_conversations(spark, folder))
    return rows.withColumn("score", F.round("score", 6))


def scored_rows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The warehouse rows from the streaming jobs: scored table first, then the consumer."""
    layout = jobs.Layout(shared_folder(spark, "warehouse"))
    jobs.stage_messages(inputs.conversation_messages(spark, folder).select("value"), layout)
    jobs.start_scoring(
        jobs.staged_stream(spark, layout), LexiconScorer(), PAYLOAD, layout, now=inputs.now()
    ).awaitTermination()
    jobs.start_warehouse(spark, layout).awaitTermination()
    return jobs.warehouse(spark, layout).withColumn("score", F.round("score", 6))


def scored_envelope(spark: SparkSession, folder: str) -> DataFrame:
    published = events.with_envelope(_scored_conversations(spark, folder), PAYLOAD)
    return published.select(
        "conv_id",
        "turn",
        F.size("sentences").cast("bigint").alias("sentences"),
        F.round(F.array_max(F.transform("sentences", lambda s: s["score"])), 6).alias("max_score"),
        F.json_array_length("envelope").cast("bigint").alias("entries"),
    )


def parse_events(spark: SparkSession, folder: str) -> DataFrame:
    """Errors are cut-off JSON, views a list: neither is a message."""
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.expr("left(props, length(props) - 1)"))
        .when(kind == "view", F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.col("props"))
    )
    parsed = events.parse_events(table(spark, folder, "events").select("event_id", raw.alias("value")))
    return parsed.select(
        "event_id",
        F.when(F.col("event").isNull(), "quarantined").otherwise("parsed").alias("status"),
        F.try_variant_get(F.col("event")["k"], "$", "bigint").alias("k"),
    )


def default_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    """The timestamp is absent for errors, null for views, given otherwise."""
    kind = F.col("event_type")
    seconds = epoch(F.col("ts"))
    body = (
        F.when(kind == "error", F.to_json(F.struct("user_id")))
        .when(kind == "view", F.lit('{"timestamp":null}'))
        .otherwise(F.to_json(F.struct("user_id", seconds.alias("timestamp"))))
    )
    parsed = events.parse_events(table(spark, folder, "events").select("event_id", body.alias("value")))
    typed = events.with_event_columns(parsed, PAYLOAD, inputs.now())
    return typed.select(
        "event_id", "timestamp", F.unix_timestamp("event_time").alias("event_time")
    )


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Users send text, others a list of sentences."""
    sentences = F.transform(inputs.pieces(F.col("text")), lambda s: F.struct(s.alias("text")))
    body = F.when(F.col("role") == "user", F.to_json(F.struct("text"))).otherwise(
        F.to_json(F.struct(sentences.alias("text")))
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", body.alias("value"))
    found = events.parse_events(turns).withColumn("found", records.segments(F.col("event")))
    lengths = F.transform("found", lambda s: F.length(records.get_string(s, "text")).cast("bigint"))
    return found.select(
        "conv_id",
        "turn",
        F.size("found").cast("bigint").alias("segments"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("characters"),
    )


def passthrough_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every message has keys that look like pieces of the word text; clicks have more."""
    click = F.col("event_type") == "click"
    body = F.to_json(
        F.struct(
            F.col("user_id").alias("userid"),
            F.lit("x").alias("te"),
            F.col("event_type").alias("text"),
            F.when(click, F.lit("y")).alias("ext"),
            F.when(click, F.lit("https://callback.example")).alias("callback_url"),
        )
    )
    parsed = events.parse_events(table(spark, folder, "events").select("event_id", body.alias("value")))
    kept = F.array_sort(F.map_keys(records.passthrough(F.col("event"))))
    return parsed.select(
        "event_id", F.size(kept).cast("bigint").alias("kept"), F.array_join(kept, ",").alias("keys")
    )


def _responses(spark: SparkSession, folder: str, insult: Column, identity: Column) -> DataFrame:
    """Attribute responses; signups get none of the scores, views miss one."""

    def attribute(value: Column) -> Column:
        return F.struct(F.struct(value.alias("value")).alias("summaryScore"))

    kind = F.col("event_type")
    scores = F.struct(
        attribute(identity).alias("IDENTITY_ATTACK"),
        F.when(kind != "view", attribute(insult)).alias("INSULT"),
        attribute(F.lit(0.25)).alias("SEXUALLY_EXPLICIT"),
    )
    body = F.to_json(F.struct(F.when(kind != "signup", scores).alias("attributeScores")))
    return table(spark, folder, "events").select("event_id", F.try_parse_json(body).alias("response"))


def attribute_extract(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value") / 1000
    found = _responses(spark, folder, insult=value, identity=1 - value)
    named = zip(probability.ATTRIBUTES, probability.attribute_probabilities(F.col("response")))
    return found.select("event_id", *[F.round(p, 6).alias(name.lower()) for name, p in named])


def fallback_score(spark: SparkSession, folder: str) -> DataFrame:
    """Errors contradict themselves: one probability is 0, another 1."""
    value = F.col("value") / 1000
    error = F.col("event_type") == "error"
    found = _responses(
        spark,
        folder,
        insult=F.when(error, F.lit(1.0)).otherwise(value),
        identity=F.when(error, F.lit(0.0)).otherwise(value),
    )
    score = probability.conflate(probability.attribute_probabilities(F.col("response")))
    fallback = F.lit(PAYLOAD.fallback_score)
    return found.select("event_id", F.round(F.coalesce(score, fallback), 6).alias("score"))


def sequential_score(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    scored = LexiconScorer().score_rows(turns).select("conv_id", "role", "turn", "score")
    part = F.floor(F.col("turn") / F.lit(65536))
    found = windows.sequential_scores(scored, ["conv_id", "role"], "turn", part)
    return found.select(
        "conv_id",
        "role",
        "turn",
        F.col("position").cast("bigint").alias("position"),
        F.round("sequential_score", 6).alias("sequential_score"),
    )


def callback_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Push envelopes around scored messages; the outbox has what names a callback."""
    published = events.with_envelope(_scored_conversations(spark, folder), PAYLOAD)
    data = F.base64(F.encode("envelope", "UTF-8"))
    pushed = published.select(
        F.to_json(F.struct(F.struct(data.alias("data")).alias("message"))).alias("body")
    )
    decoded = pushed.select(records.decode_push_envelope(F.col("body")).alias("envelope"))
    outbox = events.callback_outbox(decoded)
    return outbox.select(
        "callback_url",
        F.get_json_object("payload", "$.userid").alias("userid"),
        F.get_json_object("payload", "$.text").alias("text"),
    )


def analysis_requests(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    asked = documents.withColumn("request", F.try_parse_json(analysis_request(F.col("text"))))
    wanted = F.try_variant_get("request", "$.requestedAttributes", "map<string,variant>")
    return asked.select(
        "doc_id",
        F.try_variant_get("request", "$.comment.text", "string").alias("text"),
        F.array_join(F.array_sort(F.map_keys(wanted)), ",").alias("attributes"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        toxic_flags, event_flags, toxic_flags_stream, alerts_of_sources, rows_of_sources, window_user_avg, window_user_avg_panes,
        score_text, score_text_pandas, sentence_split, scored_rows, scored_rows_stream, scored_envelope, parse_events,
        default_timestamp, normalize_text, passthrough_keys, attribute_extract, fallback_score,
        sequential_score, callback_decode, analysis_requests,
    )
}
