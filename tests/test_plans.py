"""What the plans of the main queries must look like at any scale."""

import re

import pytest

from __spark_entry__ import queries


def plan_of(spark, tables, name):
    return queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, scans",
    [
        ("toxic_flags", 2), ("event_flags", 1), ("window_user_avg", 1), ("scored_rows", 1),
        ("scored_envelope", 1), ("callback_decode", 1), ("sequential_score", 1),
        ("stt_long_regroup", 1), ("stt_attach_metadata", 2), ("short_messages", 2), ("dataset_stats", 2),
        ("language_route", 3), ("eval_metrics", 2),
    ],
)
def test_inputs_are_read_as_often_as_needed(spark, tables, name, scans):
    assert plan_of(spark, tables, name).count("FileScan parquet") == scans


# These run jobs of their own before they give a plan.
EAGER = {"toxic_flags_stream", "scored_rows_stream", "train_scorer", "embedding_scorer", "validate_examples"}


@pytest.mark.parametrize("name", sorted(set(queries()) - EAGER))
def test_no_cross_joins(spark, tables, name):
    plan = plan_of(spark, tables, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("window_user_avg", "ts,user_id,value"),
        ("train_split", "doc_id"),
        ("audio_route", "doc_id,lang,n_chars"),
        ("audio_manifest", "page_id,url"),
        ("stt_long_regroup", "conv_id,turn"),
    ],
)
def test_only_needed_columns_are_read(spark, tables, name, columns):
    (schema,) = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(spark, tables, name))
    assert ",".join(sorted(part.split(":")[0] for part in schema.split(","))) == columns


def test_filters_reach_the_scan(spark, tables):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan_of(spark, tables, "latest_blessed"))
    assert any("EqualTo(o_orderstatus,F)" in p for p in pushed)


@pytest.mark.parametrize("name", ["toxic_flags", "event_flags", "window_user_avg"])
def test_windows_are_summed_before_the_shuffle(spark, tables, name):
    plan = plan_of(spark, tables, name)
    assert "partial_sum(score" in plan and "Python" not in plan


def test_texts_are_not_shuffled_for_alerts(spark, tables):
    """Above the scoring there are keys and numbers only."""
    plan = plan_of(spark, tables, "toxic_flags")
    scored = plan.index("regexp_extract_all")
    above = plan[:scored]
    assert "Exchange" in above and "text#" not in above
