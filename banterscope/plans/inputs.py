"""How the given tables stand in for messages, transcripts and labelled comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.functions import text
from banterscope.operators.scoring import LexiconScorer

# Stands for the present wherever a result depends on it.
NOW = 1700000000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("bigint")


def epoch(clock: Column) -> Column:
    """Whole seconds of a timestamp."""
    return F.unix_timestamp(clock)


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id`` and its scores. The text is used up here and goes into no shuffle."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return LexiconScorer().score_rows(documents).drop("text")


def chat_scores(spark: SparkSession, folder: str) -> DataFrame:
    """``(userid, event_time, score)``: documents are what users said at their events."""
    said = scored_documents(spark, folder).select(F.col("doc_id").alias("event_id"), "score")
    who = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return who.join(said, "event_id").select(
        F.col("user_id").cast("string").alias("userid"), F.col("ts").alias("event_time"), "score"
    )


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    """``(userid, event_time, score)``: a hundredth of an event's value, at most 1."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("userid"),
        F.col("ts").alias("event_time"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
    )


def speaker() -> Column:
    return F.concat_ws("-", "role", F.col("conv_id").cast("string"))


def pieces(said: Column) -> Column:
    """What was said as a list of pieces, none of which is lost but empty ones."""
    return F.filter(F.split(said, text.SENTENCE_BREAK), lambda s: F.length(s) > 0)


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON message per turn, its text a list of sentences.

    ``callback_url`` is missing where the speaker is the system.
    """
    turns = table(spark, folder, "conversations")
    sentences = F.transform(pieces(F.col("text")), lambda s: F.struct(s.alias("text")))
    url = F.when(F.col("role") != "system", F.concat(F.lit("https://callback.example/"), "role"))
    body = F.to_json(
        F.struct(
            speaker().alias("userid"),
            (F.col("turn") * 60).alias("timestamp"),
            url.alias("callback_url"),
            sentences.alias("text"),
        )
    )
    return turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        "conv_id",
        "turn",
        body.alias("value"),
    )


def training_examples(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, comment_text, target``: the labelled documents."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("target"))
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("comment_text"))
    return documents.join(labels, "doc_id")
