"""Windows, alerts, look-back over large groups, and the options."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.operators import windows
from banterscope.operators.ordering import first_positions, with_first_positions, with_previous


def scores(spark, rows):
    df = spark.createDataFrame(rows, "userid string, at double, score double")
    return df.select("userid", F.timestamp_seconds("at").alias("event_time"), "score")


def as_rows(df):
    out = df.select("userid", F.unix_timestamp("window_start").alias("s"), F.unix_timestamp("window_end").alias("e"), "score")
    return sorted(tuple(r) for r in out.collect())


def brute_windows(rows, size, slide):
    groups = {}
    for user, at, score in rows:
        start = int(at // slide) * slide
        while start > at - size:
            groups.setdefault((user, start, start + size), []).append(score)
            start -= slide
    return sorted((*k, sum(s for s in v if s is not None) / len(v)) for k, v in groups.items())


def brute_flags(window_rows, threshold):
    flags, toxic = [], set()
    for user, start, end, score in window_rows:
        if score >= threshold - 1e-12 and user not in toxic:
            toxic.add(user)
            flags.append((user, start, end, score))
        elif score < threshold - 1e-12:
            toxic.discard(user)
    return flags


def same(found, expected):
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in expected])


ROWS = st.lists(
    st.tuples(
        st.sampled_from("uvw"),
        st.integers(0, 300).map(lambda n: n / 2),
        st.one_of(st.none(), st.sampled_from([0.0, 0.3, 0.6, 0.9, 1.0])),
    ),
    min_size=1,
    max_size=60,
)


@settings(max_examples=8, deadline=None)
@given(ROWS)
def test_windows_and_flags_equal_brute_force(spark, rows):
    cfg = PipelineConfig(slides_per_slice=3)
    expected = brute_windows(rows, 30, 5)
    direct = windows.user_window_scores(scores(spark, rows), cfg)
    same(as_rows(direct), expected)
    same(as_rows(windows.user_window_scores(scores(spark, rows), cfg, panes=True)), expected)
    same(as_rows(windows.toxic_flags(direct, cfg)), brute_flags(expected, 0.6))


def test_each_event_is_in_every_window_that_covers_it(spark):
    found = as_rows(windows.user_window_scores(scores(spark, [("u", 12.0, 0.5)]), PipelineConfig()))
    assert [(s, e) for _, s, e, _ in found] == [(s, s + 30) for s in range(-15, 15, 5)]


def test_window_that_is_no_multiple_of_the_slide(spark):
    rows = [("u", 12.0, 0.5), ("u", 13.0, None)]
    cfg = PipelineConfig(window_seconds=12, slide_seconds=5)
    same(as_rows(windows.user_window_scores(scores(spark, rows), cfg)), brute_windows(rows, 12, 5))
    with pytest.raises(ValueError):
        windows.user_window_scores(scores(spark, rows), cfg, panes=True)


def test_missing_scores_count_in_the_mean(spark):
    rows = [("u", 1.0, 0.9), ("u", 2.0, None), ("v", 1.0, None)]
    found = {(r[0], r[3]) for r in as_rows(windows.user_window_scores(scores(spark, rows), PipelineConfig()))}
    assert found == {("u", 0.45), ("v", 0.0)}


def test_flags_at_rising_edges_only(spark):
    cfg = PipelineConfig(window_seconds=5, slide_seconds=5)
    rows = [("u", 5.0 * i, s) for i, s in enumerate([0.9, 0.9, 0.1, 0.9])] + [("u", 100.0, 0.9), ("v", 0.0, 0.6)]
    found = as_rows(windows.toxic_flags(windows.user_window_scores(scores(spark, rows), cfg), cfg))
    assert [(u, s) for u, s, _, _ in found] == [("u", 0), ("u", 15), ("v", 0)]


def test_flag_message(spark):
    import json

    df = spark.createDataFrame([("u", 0.9)], "userid string, score double")
    assert json.loads(windows.flag_messages(df).first()["value"]) == {"userid": "u", "score": 0.9}


@pytest.mark.parametrize("slice_size", [1, 7, 64, 10**6])
def test_previous_over_slices_with_one_hot_group(spark, slice_size):
    random.seed(slice_size)
    rows = [("hot" if random.random() < 0.4 else f"k{random.randrange(9)}", i * random.choice([1, 3]), i) for i in range(900)]
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    found = with_previous(df, ["k"], "o", F.floor(F.col("o") / slice_size), F.when(F.col("v") % 5 != 0, F.col("v")), "prev")
    expected, last = {}, {}
    for k, o, v in sorted(rows):
        expected[(k, o)] = last.get(k)
        last[k] = v if v % 5 else None
    assert {(r["k"], r["o"]): r["prev"] for r in found.collect()} == expected


def test_no_task_gets_a_whole_hot_group(spark):
    """The rows of one key spread over the tasks of the first pass."""
    df = spark.range(100000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    found = with_previous(df, ["k"], "o", F.floor(F.col("o") / 1000), F.col("o"), "prev")
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 60000
    assert found.where("o > 0 and prev = o - 1").count() == 99999


@pytest.mark.parametrize("slice_size", [1, 7, 10**6])
def test_numbering_the_first_rows(spark, slice_size):
    random.seed(slice_size)
    rows = sorted({("hot" if random.random() < 0.4 else f"k{random.randrange(9)}", i * 3 % 1000) for i in range(800)})
    df = spark.createDataFrame(rows, "k string, o int").repartition(5)
    part = F.floor(F.col("o") / slice_size)
    found = with_first_positions(df, ["k"], "o", part, F.col("o"), 4, "n", "before").collect()
    groups = {}
    for k, o in rows:
        groups.setdefault(k, []).append(o)
    expected = {
        (k, o): (i + 1, os[i - 1] if i else None) if i < 4 else (None, None)
        for k, os in groups.items()
        for i, o in enumerate(os)
    }
    assert {(r["k"], r["o"]): (r["n"], r["before"]) for r in found} == expected


def test_first_positions(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 4)], "k string, o int")
    found = sorted(tuple(r) for r in first_positions(df, ["k"], ["o"], 2, "n").collect())
    assert found == [("a", 0, 1), ("a", 1, 2), ("b", 4, 1)]


@pytest.mark.parametrize(
    "options",
    [
        {"slide_seconds": 31}, {"slide_seconds": 0}, {"window_seconds": -1}, {"toxic_threshold": 1.1},
        {"toxic_threshold": -0.1}, {"event_time": "arrival"}, {"slides_per_slice": 0},
    ],
)
def test_options_are_checked(options):
    with pytest.raises(ValueError):
        PipelineConfig(**options)


def test_default_options():
    cfg = PipelineConfig()
    assert (cfg.window_seconds, cfg.slide_seconds, cfg.toxic_threshold, cfg.panes_per_window) == (30, 5, 0.6, 6)


def test_options_from_text():
    cfg = PipelineConfig.from_strings({"window_seconds": "60", "toxic_threshold": "0.7", "translate": "True"})
    assert (cfg.window_seconds, cfg.toxic_threshold, cfg.translate) == (60, 0.7, True)
    with pytest.raises(ValueError):
        PipelineConfig.from_strings({"windows": "1"})
