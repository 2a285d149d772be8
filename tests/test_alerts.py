"""Alerts by the sources' clocks: late rows, corrections, replays."""

import random
from collections import Counter
from dataclasses import replace

from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.operators import windows
from banterscope.plans import chat
from banterscope.streaming import alerts
from banterscope.streaming.alerts import AlertJob

CFG = PipelineConfig(correct_seconds=-1, watermark_delay="10 seconds", idle_seconds=100)
FIELDS = "userid string, source string, at long, published long, score double"


def frame(spark, rows):
    plain = spark.createDataFrame(rows, FIELDS)
    return plain.select("userid", "source", F.timestamp_seconds("at").alias("event_time"), F.timestamp_seconds("published").alias("publish_time"), "score")


def run(spark, folder, batches, cfg=CFG, keep=10):
    job = AlertJob(cfg, str(folder), keep)
    for k, rows in enumerate(batches):
        job.step(frame(spark, rows), k)
    return job


def told(df):
    return Counter((r[0], r[1]) for r in df.select("userid", F.unix_timestamp("window_end")).collect())


def everything(job, spark, version):
    return told(job.corrected(spark).unionByName(job.still_open(spark, version)))


def plainly(spark, rows, cfg=CFG):
    found = windows.user_window_scores(frame(spark, rows).select("userid", "event_time", "score"), cfg)
    return told(windows.toxic_flags(found, cfg))


def test_any_order_ends_in_the_alerts_of_the_whole(spark, tmp_path):
    r = random.Random(11)
    rows = [(f"u{r.randrange(4)}", f"s{r.randrange(3)}", t, 5000, r.choice([0.1, 0.9, 0.95, None])) for t in (r.randrange(600) for _ in range(120))]
    order = sorted(rows, key=lambda x: x[2] + r.choice([0, 0, 0, 150]))
    batches = [order[k : k + 30] for k in range(0, len(order), 30)]
    job = run(spark, tmp_path / "job", batches)
    assert job.late(spark).count() > 10 and job.corrections(spark).where("change = -1").count() > 0
    assert everything(job, spark, len(batches) - 1) == plainly(spark, rows)
    counts = job.counts(spark).agg(F.sum("late"), F.sum("on_time")).first()
    assert counts[0] == job.late(spark).count() and sum(counts) == len(rows)


def test_replay_of_a_batch_changes_nothing(spark, tmp_path):
    batches = [[("u", "s", 0, 900, 0.9), ("v", "s", 200, 900, 0.1)], [("u", "s", 100, 900, 0.9), ("u", "s", 400, 900, 0.9)], [("w", "s", 800, 900, 0.9)]]
    job = run(spark, tmp_path / "job", batches)

    def outputs():
        tables = (job.alerts, job.corrections, job.late, job.out_of_range, job.counts)
        return [Counter(tuple(x) for x in t(spark).collect()) for t in tables] + [everything(job, spark, 2)]

    first = outputs()
    for k in (1, 2):
        job.step(frame(spark, batches[k]), k)
    assert outputs() == first


def test_the_slowest_source_holds_the_clock_until_it_is_idle(spark, tmp_path):
    fast = [[("u", "fast", 100 * k, 100 * k, 0.9)] for k in range(6)]
    slow = [("v", "slow", 5, 5, 0.9)]
    job = run(spark, tmp_path / "job", [fast[0] + slow, *fast[1:]])
    clocks = [job._state(spark, k, "clock").first()["watermark"] // alerts.SECOND for k in range(6)]
    # The slow source was last seen at 5: from 200 on it is idle.
    assert clocks == [-10, -5, 190, 290, 390, 490]
    job.step(frame(spark, [("v", "slow", 20, 600, 0.9)]), 6)
    assert job._state(spark, 6, "clock").first()["watermark"] // alerts.SECOND == 490
    assert [x.event_time for x in job.late(spark).collect()] == [20 * alerts.SECOND]


def test_clocks_that_err_are_set_aside_and_move_nothing(spark, tmp_path):
    odd = [("a", "s", 253402000000, 50, 0.9), ("b", "s", 1700000000, 50, 0.9), ("c", "s", None, 50, 0.9), ("d", "s", 10, None, 0.9)]
    good = [("a", None, 10, 50, 0.9), ("b", "s", 600 + 50, 50, 0.9)]
    job = run(spark, tmp_path / "job", [odd + good, [("c", "s", 20, 60, 0.9), ("d", "s", 30, 60, 0.9)]])
    assert sorted(x.userid for x in job.out_of_range(spark).collect()) == ["a", "b", "c", "d"]
    assert set(u for u, _ in everything(job, spark, 1)) == {"a", "b", "c", "d"}


def test_what_is_forgotten_is_stored_but_not_corrected(spark, tmp_path):
    cfg = replace(CFG, correct_seconds=60)
    job = run(spark, tmp_path / "job", [[("u", "s", 0, 900, 0.9), ("u", "s", 100, 900, 0.1)], [("u", "s", 500, 900, 0.1)], [("u", "s", 3, 900, 0.0), ("u", "s", 450, 900, 0.9), ("u", "s", 800, 900, 0.1)]], cfg, keep=2)
    assert sorted((x.event_time // alerts.SECOND, x.corrected) for x in job.late(spark).collect()) == [(3, False), (450, True)]
    assert job._state(spark, 2, "panes").where(F.col("pane") < 700 * alerts.SECOND).count() == 0
    assert not (tmp_path / "job" / "state" / "0").exists() and (tmp_path / "job" / "state" / "1").exists()
    assert told(job.corrected(spark)) == Counter({("u", 5): 1, ("u", 455): 1})


def test_toxic_users_are_remembered_over_batches_and_over_what_is_forgotten(spark, tmp_path):
    cfg = replace(CFG, correct_seconds=20)
    rows = [("u", "s", 10 * k, 9000, 0.9) for k in range(40)] + [("u", "s", 700, 9000, 0.1), ("u", "s", 900, 9000, 0.9)]
    job = run(spark, tmp_path / "job", [rows[k : k + 7] for k in range(0, 42, 7)], cfg)
    assert everything(job, spark, 5) == plainly(spark, rows) == Counter({("u", 5): 1, ("u", 905): 1})


def test_an_arrival_is_one_batch_in_however_many_files(spark, tmp_path):
    seen = spark.range(400).selectExpr("id as event_id", "id % 7 as user_id", "timestamp_seconds(1700000000 + id * 900) as ts", "double(id % 100) as value")
    seen.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    job, version = chat._arrived(spark, str(tmp_path))
    assert version == chat.ARRIVALS - 1
    assert job.counts(spark).agg(F.sum(F.col("on_time") + F.col("late") + F.col("aside"))).first()[0] == 400


def test_no_events_arrive(spark, tmp_path):
    none = spark.range(0).selectExpr("id as event_id", "id as user_id", "timestamp_seconds(id) as ts", "double(id) as value")
    none.write.parquet(str(tmp_path / "events.parquet"))
    assert chat.rows_of_sources(spark, str(tmp_path)).count() == chat.alerts_of_sources(spark, str(tmp_path)).count() == 0


def test_empty_batches(spark, tmp_path):
    job = run(spark, tmp_path / "job", [[], [("u", "s", 0, 1, 0.9)], []])
    assert everything(job, spark, 2) == Counter({("u", 5): 1})


def test_delays_are_read_in_units():
    assert PipelineConfig(watermark_delay="1 minute 30 seconds").delay_seconds == 90
    assert PipelineConfig(watermark_delay="2 hours").delay_seconds == 7200
