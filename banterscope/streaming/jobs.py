"""The streaming jobs.

``start_scoring`` scores each message once and commits it to the scored table. The
consumers (scored topic, warehouse, alerts, outbox) are independent streams over that
table, each with its own checkpoint, so one can fail, lag or be replayed by itself.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banterscope.config import PipelineConfig
from banterscope.functions import records
from banterscope.operators import events, windows
from banterscope.operators.scoring import Scorer
from banterscope.schema import FLAG, SCORED_MESSAGE, WAREHOUSE
from banterscope.sinks.batch import with_event_date
from banterscope.sinks.streams import Sink, files
from banterscope.sources.messages import line_stream
from banterscope.sources.tables import scored_stream
from banterscope.streaming.alerts import AlertJob
from banterscope.streaming.state import flag_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Layout:
    """Folders of one deployment, all on shared storage."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/checkpoints/{name}"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with incremental checkpoints to shared storage."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def scored_messages(
    messages: DataFrame, scorer: Scorer, cfg: PipelineConfig, now: Column | None = None
) -> DataFrame:
    """Messages to the stored form; the same for streams and for replay in batch.

    Messages that are no JSON objects are kept aside in the same table, so that the source
    is read and parsed once.
    """
    # Messages from elsewhere may have neither a time of publishing nor a source.
    absent = {"publish_time": F.lit(None).cast("timestamp"), "source": F.lit(None).cast("string")}
    parsed = events.parse_events(messages.withColumns({k: v for k, v in absent.items() if k not in messages.columns}))
    typed = events.with_event_columns(parsed, cfg, now, keep_unparsed=True)
    scored = events.with_envelope(events.score_messages(typed, scorer, cfg), cfg)
    unparsed = F.col("event").isNull()
    marked = scored.withColumn("is_quarantined", unparsed).withColumn("raw", F.when(unparsed, F.col("value")))
    return marked.select(*SCORED_MESSAGE.fieldNames())


def start_scoring(
    messages: DataFrame, scorer: Scorer, cfg: PipelineConfig, layout: Layout,
    trigger: dict | None = None, now: Column | None = None,
) -> StreamingQuery:
    """Parse and score a stream into the scored table. Only row-local scorers can stream."""
    scored = scored_messages(messages, scorer, cfg, now)
    return files(layout.table("scored"), trigger=trigger)(scored, layout.checkpoint("scored"))


def stage_messages(messages: DataFrame, layout: Layout) -> None:
    """Put ``value`` rows where ``staged_stream`` picks them up: the backfill of a stream."""
    messages.select("value").write.mode("append").text(layout.table("staged"))


def staged_stream(spark: SparkSession, layout: Layout) -> DataFrame:
    return line_stream(spark, layout.table("staged"))


def warehouse(spark: SparkSession, layout: Layout) -> DataFrame:
    """The warehouse table as it stands."""
    found = spark.read.schema(WAREHOUSE).parquet(layout.table("warehouse"))
    return found.select(*WAREHOUSE.fieldNames())


def start_quarantine(
    spark: SparkSession, layout: Layout, trigger: dict | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """Messages that are no JSON objects."""
    bad = scored_stream(spark, layout.table("scored"), files_per_batch).where("is_quarantined").select("message_id", "raw")
    return files(layout.table("quarantine"), trigger=trigger)(bad, layout.checkpoint("quarantine"))


def start_without_user(
    spark: SparkSession, layout: Layout, trigger: dict | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """Scored messages that name no user and so have no part in alerts."""
    good = scored_stream(spark, layout.table("scored"), files_per_batch).where("not is_quarantined")
    lost = events.without_user(good).select("message_id", "event_time", "envelope")
    return files(layout.table("without_user"), trigger=trigger)(lost, layout.checkpoint("without_user"))


def start_scored_topic(
    spark: SparkSession, layout: Layout, sink: Sink | None = None,
    hook: events.RowHook | None = None, trigger: dict | None = None, files_per_batch: int | None = None,
) -> StreamingQuery:
    """One JSON array per message, to a topic or, without one, as lines of text."""
    good = scored_stream(spark, layout.table("scored"), files_per_batch).where("not is_quarantined")
    lines = good.select(F.col("envelope").alias("value"))
    sink = sink or files(layout.table("topic"), kind="text", trigger=trigger)
    return sink(events.post_process(lines, hook), layout.checkpoint("topic"))


def start_warehouse(
    spark: SparkSession, layout: Layout, trigger: dict | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """One row per sentence, partitioned by the day of the event."""
    rows = events.warehouse_rows(scored_stream(spark, layout.table("scored"), files_per_batch))
    dated = with_event_date(rows, records.seconds_time(F.col("timestamp")))
    sink = files(layout.table("warehouse"), partition_by=("event_date",), trigger=trigger)
    return sink(dated, layout.checkpoint("warehouse"))


def start_outbox(
    spark: SparkSession, layout: Layout, trigger: dict | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """Callbacks to deliver."""
    named = scored_stream(spark, layout.table("scored"), files_per_batch).where(F.col("callback_url").isNotNull())
    outbox = events.callback_outbox(named)
    return files(layout.table("outbox"), trigger=trigger)(outbox, layout.checkpoint("outbox"))


def flags_of(scores: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Stream of ``(userid, event_time, score)`` to a stream of alerts.

    Windows close when the watermark passes their end: the newest event, less
    ``cfg.watermark_delay``. Rows that come later still are dropped and counted (``dropped_late``).
    """
    timed = scores.withWatermark("event_time", cfg.watermark_delay)
    return flag_stream(windows.user_window_scores(timed, cfg), cfg)


def start_flags(
    spark: SparkSession, cfg: PipelineConfig, layout: Layout, sink: Sink | None = None,
    trigger: dict | None = None, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Alerts for users who turn toxic: JSON to a topic or, without one, rows of a table."""
    use_rocksdb(spark)
    scores = events.keyed_scores(scored_stream(spark, layout.table("scored"), files_per_batch))
    flags = flags_of(scores, cfg)
    if sink is not None:
        return sink(windows.flag_messages(flags), layout.checkpoint("flags"))
    return files(layout.table("flags"), trigger=trigger)(flags, layout.checkpoint("flags"))


def alert_job(cfg: PipelineConfig, layout: Layout) -> AlertJob:
    return AlertJob(cfg, layout.table("alerts"))


def start_alerts(
    spark: SparkSession, cfg: PipelineConfig, layout: Layout,
    trigger: dict | None = None, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Alerts by the sources' own clocks, with late rows kept and alerts corrected; no Python in the rows' way."""
    rows = events.alert_rows(scored_stream(spark, layout.table("scored"), files_per_batch))
    return alert_job(cfg, layout).start(rows, layout.checkpoint("alerts"), trigger)


def start_alert_topic(spark: SparkSession, layout: Layout, sink: Sink) -> StreamingQuery:
    """Alerts as JSON messages, as they are raised. A batch that is run again after a fall may send them twice."""
    raised = spark.readStream.schema(FLAG).parquet(f"{layout.table('alerts')}/alerts")
    return sink(windows.flag_messages(raised), layout.checkpoint("alert_topic"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that the recent micro-batches of an alert stream dropped as too late, as the windows' state counts them."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def wait_for_first_batch(query: StreamingQuery, poll_seconds: float = 0.2) -> None:
    """Wait until a stream has its table, empty or not, so that others can read it."""
    while query.isActive and query.lastProgress is None:
        time.sleep(poll_seconds)
    if query.exception() is not None:
        raise query.exception()


def tail(query: StreamingQuery, seconds: float) -> bool:
    """Let a stream run for a while, then stop it; True if it had already ended."""
    ended = query.awaitTermination(seconds)
    query.stop()
    return bool(ended)
