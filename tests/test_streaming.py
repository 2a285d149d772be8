"""Streams: sources, alerts, and agreement with the batch functions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.operators import events, windows
from banterscope.operators.scoring import LexiconScorer
from banterscope.schema import FLAG
from banterscope.session import CONF
from banterscope.sinks import batch, streams
from banterscope.sources import messages, tables
from banterscope.streaming import jobs

CFG = PipelineConfig(event_time="payload")


def put(folder, lines, start=1_700_000_000):
    """One file per entry, ten seconds apart, so that a stream takes them in this order."""
    folder.mkdir(parents=True, exist_ok=True)
    for i, line in enumerate(lines):
        path = folder / f"{i:04}.json"
        path.write_text(line)
        os.utime(path, (start + 10 * i, start + 10 * i))


def run(query):
    query.awaitTermination()


def test_alerts_in_order_of_arrival(spark, tmp_path):
    rows = [("u", 0, 0.9), ("u", 3, 0.9), ("u", 60, 0.1), ("u", 120, 0.9), ("v", 400, 0.1)]
    put(tmp_path / "in", [json.dumps({"userid": u, "at": t, "score": s}) for u, t, s in rows])
    reader = spark.readStream.schema("userid string, at long, score double").option("maxFilesPerTrigger", 1)
    scores = reader.json(str(tmp_path / "in")).select(
        "userid", F.timestamp_seconds("at").alias("event_time"), "score"
    )
    jobs.use_rocksdb(spark)
    layout = jobs.Layout(str(tmp_path))
    closed = windows.user_window_scores(scores.withWatermark("event_time", "0 seconds"), CFG)
    run(streams.files(layout.table("windows"))(closed, layout.checkpoint("windows")))
    run(streams.files(layout.table("flags"))(jobs.flags_of(scores, CFG), layout.checkpoint("flags")))
    assert spark.read.parquet(layout.table("windows")).count() == 18
    flags = spark.read.schema(FLAG).parquet(layout.table("flags"))
    found = sorted(tuple(r) for r in flags.select("userid", F.unix_timestamp("window_end")).collect())
    assert found == [("u", 5), ("u", 125)]


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [("u", 100, 0.9), ("u", 200, 0.9), ("u", 10, 0.9), ("u", 300, 0.1)]
    put(tmp_path / "in", [json.dumps({"userid": u, "at": t, "score": s}) for u, t, s in rows])
    reader = spark.readStream.schema("userid string, at long, score double").option("maxFilesPerTrigger", 1)
    scores = reader.json(str(tmp_path / "in")).select("userid", F.timestamp_seconds("at").alias("event_time"), "score")
    layout = jobs.Layout(str(tmp_path))
    closed = windows.user_window_scores(scores.withWatermark("event_time", "0 seconds"), CFG)
    run(streams.files(layout.table("windows"))(closed, layout.checkpoint("windows")))
    starts = [r[0] for r in spark.read.parquet(layout.table("windows")).select(F.unix_timestamp("window_start")).collect()]
    assert sorted(starts) == [75, 80, 85, 90, 95, 100, 175, 180, 185, 190, 195, 200]


@pytest.fixture(scope="module")
def lines():
    made = []
    for i in range(60):
        vile = "scum trash idiot moron worthless pathetic"
        text = [vile, "nice game", [{"text": vile}, {"text": vile}], [], ["bad"]][i % 5]
        made.append({"userid": f"u{i % 3}", "timestamp": i * 4, "text": text, "callback_url": f"https://c/{i % 2}"})
    del made[7]["callback_url"], made[9]["userid"]
    return [json.dumps(m) for m in made] + ["{broken", json.dumps({"userid": "z", "timestamp": 1000, "text": "end"})]


def test_stream_and_batch_agree(spark, tmp_path, lines):
    put(tmp_path / "in", lines)
    layout = jobs.Layout(str(tmp_path / "out"))
    source = str(tmp_path / "in")
    now = F.lit(5)

    arriving = messages.drop_zone_stream(spark, source, files_per_batch=25)
    run(jobs.start_scoring(arriving, LexiconScorer(), CFG, layout, now=now))
    run(jobs.start_quarantine(spark, layout))
    run(jobs.start_scored_topic(spark, layout))
    run(jobs.start_warehouse(spark, layout))
    run(jobs.start_outbox(spark, layout))
    run(jobs.start_flags(spark, CFG, layout))

    replay = jobs.scored_messages(messages.drop_zone_batch(spark, source), LexiconScorer(), CFG, now)
    stored = tables.scored_batch(spark, layout.table("scored"))

    def whole(df):
        return sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())

    assert stored.count() == 62 and whole(stored) == whole(replay)

    assert [r["raw"] for r in spark.read.parquet(layout.table("quarantine")).collect()] == ["{broken"]
    replay = replay.where("not is_quarantined")
    published = spark.read.text(layout.table("topic"))
    assert published.exceptAll(replay.select(F.col("envelope").alias("value"))).count() == 0
    assert published.count() == 61
    rows = jobs.warehouse(spark, layout)
    expected = events.warehouse_rows(replay)
    assert rows.count() == expected.count() and rows.exceptAll(expected).count() == 0
    outbox = spark.read.parquet(layout.table("outbox"))
    assert outbox.count() == events.callback_outbox(replay).count() > 0

    # The last message closes all windows but its own.
    closed = windows.user_window_scores(events.keyed_scores(replay), CFG).where("userid <> 'z'")
    flags = windows.toxic_flags(closed, CFG)
    streamed = spark.read.schema(FLAG).parquet(layout.table("flags"))

    def plain(df):
        return sorted((r[0], r[1]) for r in df.select("userid", F.unix_timestamp("window_end")).collect())

    assert plain(streamed) == plain(flags) and flags.count() > 0


def test_restart_adds_nothing_twice(spark, tmp_path, lines):
    layout = jobs.Layout(str(tmp_path / "out"))
    for _ in range(2):
        put(tmp_path / "in", lines[:10])
        run(jobs.start_scoring(messages.drop_zone_stream(spark, str(tmp_path / "in")), LexiconScorer(), CFG, layout))
        run(jobs.start_warehouse(spark, layout))
    first = jobs.warehouse(spark, layout).count()
    assert tables.scored_batch(spark, layout.table("scored")).count() == 10
    (tmp_path / "in" / "more.json").write_text(lines[0])
    run(jobs.start_scoring(messages.drop_zone_stream(spark, str(tmp_path / "in")), LexiconScorer(), CFG, layout))
    run(jobs.start_warehouse(spark, layout))
    assert jobs.warehouse(spark, layout).count() == first + 1


def test_odd_messages_do_not_stop_the_stream(spark, tmp_path):
    """Repeated keys keep the last value, who names no user is kept aside, late rows are counted."""
    vile = "scum trash idiot moron worthless pathetic"
    lines = [
        json.dumps({"userid": "u", "timestamp": 1000, "text": vile}),
        '{"userid":"x","userid":"v","timestamp":990,"text":"%s"}' % vile,
        json.dumps({"timestamp": 1700000000000000, "text": vile}),
        json.dumps({"userid": "w", "timestamp": 1700000000000000, "text": vile}),
        json.dumps({"userid": "z", "timestamp": 5000, "text": "end"}),
        json.dumps({"userid": "late", "timestamp": 4950, "text": vile}),
        json.dumps({"userid": "too late", "timestamp": 10, "text": vile}),
        json.dumps({"userid": "z", "timestamp": 9000, "text": "end"}),
    ]
    put(tmp_path / "in", lines)
    layout = jobs.Layout(str(tmp_path / "out"))
    spark = spark.newSession()
    for key, value in CONF.items():
        spark.conf.set(key, value)
    arriving = messages.drop_zone_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    run(jobs.start_scoring(arriving, LexiconScorer(), CFG, layout))
    run(jobs.start_without_user(spark, layout, files_per_batch=1))
    run(jobs.start_warehouse(spark, layout, files_per_batch=3))
    flags = jobs.start_flags(spark, CFG, layout, files_per_batch=1)
    run(flags)
    assert spark.read.parquet(layout.table("without_user")).count() == 1
    assert jobs.warehouse(spark, layout).count() == len(lines)
    found = spark.read.schema(FLAG).parquet(layout.table("flags"))
    assert {r["userid"] for r in found.collect()} == {"u", "v", "late"}
    assert jobs.dropped_late(flags) > 0


def test_outputs_can_be_replaced(spark, tmp_path):
    """Alerts as JSON messages, and the scored topic behind the user's own hook."""
    vile = {"userid": "u", "text": "scum trash idiot moron worthless pathetic"}
    put(tmp_path / "in", [json.dumps({**vile, "timestamp": t}) for t in (0, 100)])
    layout = jobs.Layout(str(tmp_path / "out"))
    run(jobs.start_scoring(messages.drop_zone_stream(spark, str(tmp_path / "in")), LexiconScorer(), CFG, layout))
    run(jobs.start_flags(spark, CFG, layout, sink=streams.files(str(tmp_path / "alerts"))))
    (alert,) = [json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()]
    assert alert["userid"] == "u" and alert["score"] > 0.6

    def shout(df):
        return df.withColumn("value", F.upper("value"))

    run(jobs.start_scored_topic(spark, layout, sink=streams.files(str(tmp_path / "topic")), hook=shout))
    published = [r["value"] for r in spark.read.parquet(str(tmp_path / "topic")).collect()]
    assert len(published) == 2 and all('"USERID":"U"' in value for value in published)


def test_trained_scorer_in_a_stream(spark, tmp_path):
    from banterscope.operators.scoring import LinearTextScorer

    put(tmp_path / "in", ['{"userid":"u","text":"you cad"}'])
    layout = jobs.Layout(str(tmp_path / "out"))
    trained = LinearTextScorer({"cad": 2.0}, -1.0)
    run(jobs.start_scoring(messages.drop_zone_stream(spark, str(tmp_path / "in")), trained, CFG, layout))
    (row,) = tables.scored_batch(spark, layout.table("scored")).collect()
    assert row["sentences"][0]["score"] == pytest.approx(0.7310585786)


def test_lines_as_messages(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n{"a":1}\n{"a":2}\n')
    rows = messages.line_batch(spark, str(tmp_path)).collect()
    assert sorted(r["value"] for r in rows) == ['{"a":1}', '{"a":1}', '{"a":2}']
    assert len({r["message_id"] for r in rows}) == 3
    assert messages.line_stream(spark, str(tmp_path), files_per_batch=1).isStreaming


def test_drop_zone_writer(spark, tmp_path):
    df = spark.createDataFrame([("Bob", '{"a":1}'), (None, '{"a":2}')], "userid string, value string")
    batch.write_messages(df, str(tmp_path / "zone"), F.lit(9))
    rows = spark.read.json(str(tmp_path / "zone")).collect()
    assert sorted((r["object_name"], r["value"]) for r in rows) == [("9.json", '{"a":2}'), ("bob_9.json", '{"a":1}')]


def test_batch_warehouse_is_partitioned_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("u", 0, "a", 0.5), ("u", 86400, "b", 0.5)], "userid string, timestamp long, text string, score double")
    batch.append_warehouse(rows, str(tmp_path / "w"))
    assert {p.name for p in (tmp_path / "w").glob("event_date=*")} == {"event_date=1970-01-01", "event_date=1970-01-02"}
    batch.write_outbox(spark.createDataFrame([("c", "{}")], "callback_url string, payload string"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_console_tap_and_bounded_tail(spark, tmp_path):
    stream = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = streams.console({"processingTime": "1 second"})(stream, str(tmp_path / "c"))
    assert jobs.tail(query, 3) is False
    assert not query.isActive


def test_topics_need_the_connector(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)kafka"):
        messages.topic_batch(spark, "localhost:1", "chat").count()
    with pytest.raises(Exception, match="(?i)kafka"):
        messages.topic_stream(spark, "localhost:1", "chat")
    stream = spark.readStream.format("rate").load().select(F.lit("x").alias("value"))
    with pytest.raises(Exception, match="(?i)kafka"):
        streams.topic("localhost:1", "chat")(stream, str(tmp_path / "t"))
