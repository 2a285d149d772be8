"""A corpus made ready for training, stage by stage.

Every stage takes the rows that its predecessor kept and works on all of them; what it returns is written as
Parquet to the shared folder and read again. The first four return the columns of ``documents``; the last one
returns the encoded corpus.

1. ``language``: texts whose language isn't found go.
2. ``near_copies``: of documents linked by five-word runs (similarity 0.8 or more), one of each group stays.
3. ``decontamination``: documents that contain a benchmark item go.
4. ``secrets``: secrets in texts are replaced by a mark, and ``n_chars`` follows.
5. ``encode``: token ids by byte-pair encoding, and the digest of the ids decoded again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.llm import bpe, jaccard, language, leaks, secrets
from banterscope.llm.queries import table, vocabulary
from banterscope.llm.samples import fold
from banterscope.session import materialise, small_batches


def find_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, texts without letters and texts without a likely language go; all others stay unchanged."""
    return language.keep_known(docs, language.fit(docs.where(fold("doc_id", 5) != 0)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays; texts without words are no copies of anything."""
    return jaccard.one_of_each(docs, width=5, share=80, parts=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with four fifths of the five-word runs of a benchmark item go."""
    return leaks.without_items(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are marked. A null text stays null."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded_sha256`` of every document."""
    coded = bpe.encode(docs, vocabulary(), decoded=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """The stage in a session whose batches are small: executors keep what earlier stages made them reserve."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language", _lean(find_language)),
    ("near_copies", _lean(drop_near_copies)),
    ("decontamination", _lean(decontaminate)),
    ("secrets", _lean(redact_secrets)),
    ("encode", _lean(encode)),
]

# Trained and hashed stages can't be told in SQL; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
