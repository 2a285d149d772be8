"""Messages: parsing, odd shapes, fallbacks, envelopes."""

import json

import pytest
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions import records
from banterscope.operators import events
from banterscope.operators.scoring import LexiconScorer
from banterscope.schema import WAREHOUSE

CFG = PipelineConfig(event_time="payload")
NOW = 1700000000


def messages(spark, *values):
    rows = [(str(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "message_id string, value string")


def scored(spark, *values, cfg=CFG, scorer=None):
    parsed = events.parse_events(messages(spark, *values))
    typed = events.with_event_columns(parsed, cfg, F.lit(NOW))
    return events.score_messages(typed, scorer or LexiconScorer(), cfg)


def envelopes(df, cfg=CFG):
    found = events.with_envelope(df, cfg).orderBy("message_id").collect()
    return [json.loads(r["envelope"]) for r in found]


def test_text_becomes_one_sentence_without_times(spark):
    df = scored(spark, '{"userid":"u","timestamp":1,"text":"hi"}')
    (row,) = df.collect()
    (sentence,) = row["sentences"]
    assert (sentence["start_time"], sentence["end_time"], sentence["text"]) == ("", "", "hi")
    assert sentence["score"] == pytest.approx(0.05**3 / (0.05**3 + 0.95**3))
    assert sentence["detail"] == {"IDENTITY_ATTACK": 0.05, "INSULT": 0.05, "SEXUALLY_EXPLICIT": 0.05}


def test_segments_keep_their_times(spark):
    text = [{"text": "a", "start_time": "0s", "end_time": "2s"}, {"text": "b"}]
    df = scored(spark, json.dumps({"userid": "u", "timestamp": 1, "text": text}))
    times = [(s["text"], s["start_time"], s["end_time"]) for s in df.first()["sentences"]]
    assert times == [("a", "0s", "2s"), ("b", "", "")]


def test_time_that_is_null_stays_null(spark):
    df = scored(spark, '{"userid":"u","text":[{"text":"a","start_time":null}]}')
    assert df.first()["sentences"][0]["start_time"] is None
    assert envelopes(df)[0][0]["start_time"] is None


@pytest.mark.parametrize("bad", ["{bad", "[1]", "5", '"x"', "null", "", '{"a":1,"a":2}'])
def test_what_is_no_object_goes_to_quarantine(spark, bad):
    parsed = events.parse_events(messages(spark, bad, '{"userid":"u","text":"hi"}'))
    assert [r["value"] for r in events.quarantine(parsed).collect()] == [bad]
    assert events.with_event_columns(parsed, CFG).count() == 1


def test_what_did_not_parse_is_stored_aside(spark):
    from banterscope.streaming.jobs import scored_messages

    df = scored_messages(messages(spark, "{bad", None, '{"text":"hi"}'), LexiconScorer(), CFG, F.lit(NOW))
    found = {r["message_id"]: r for r in df.collect()}
    assert [(found[i]["is_quarantined"], found[i]["raw"]) for i in "012"] == [(True, "{bad"), (True, None), (False, None)]
    assert all(found[i][c] is None for i in "01" for c in ("sentences", "envelope", "userid", "timestamp"))
    assert not found["0"]["is_fallback"]
    assert events.warehouse_rows(df).count() == 1


def test_missing_value_goes_to_quarantine(spark):
    assert events.quarantine(events.parse_events(messages(spark, None))).count() == 1


def test_absent_timestamp_is_now_and_null_stays(spark):
    df = scored(spark, '{"text":"a"}', '{"text":"a","timestamp":null}', '{"text":"a","timestamp":7}')
    found = {r["message_id"]: r["timestamp"] for r in df.collect()}
    assert found == {"0": NOW, "1": None, "2": 7}
    assert [e[0]["timestamp"] for e in envelopes(df)] == [NOW, None, 7]


def test_payload_time_in_three_shapes(spark):
    stamps = ["7", "7.5", '"20210804 11:22:46.222708"', '"soon"']
    df = scored(spark, *[f'{{"text":"a","timestamp":{s}}}' for s in stamps])
    micros = df.orderBy("message_id").select(F.unix_micros("event_time").alias("m")).collect()
    assert [r["m"] for r in micros] == [7_000_000, 7_500_000, 1628076166222708, None]


def test_publish_time_is_the_default_clock(spark):
    typed = events.with_event_columns(
        events.parse_events(messages(spark, '{"text":"a","timestamp":7}')).withColumn(
            "publish_time", F.timestamp_seconds(F.lit(99))
        ),
        PipelineConfig(),
    )
    assert typed.select(F.unix_timestamp("event_time").alias("t")).first()["t"] == 99


@pytest.mark.parametrize(
    "text",
    [None, 5, ["a"], {"text": "a"}, [{"text": "a"}, {"start_time": "0s"}], [{"text": None}], [None]],
)
def test_one_bad_sentence_gives_one_fallback(spark, text):
    original = {"userid": "u", "timestamp": 1, "text": text, "te": "kept"}
    df = scored(spark, json.dumps(original))
    row = df.first()
    assert row["is_fallback"]
    (sentence,) = row["sentences"]
    assert sentence["score"] == 0.00001 and sentence["detail"] is None
    ((entry,),) = envelopes(df)
    assert entry == {**original, "score": 0.00001, "score_detail": {"score": 0.00001}}


def test_message_without_text_is_a_fallback_with_null_text(spark):
    df = scored(spark, '{"userid":"u","timestamp":1}')
    rows = events.warehouse_rows(df).collect()
    assert [tuple(r) for r in rows] == [("u", 1, None, 0.00001)]


def test_fallback_keeps_a_list_as_its_json(spark):
    rows = events.warehouse_rows(scored(spark, '{"userid":"u","timestamp":1,"text":["a","b"]}'))
    assert rows.first()["text"] == '["a","b"]'


def test_empty_list_is_published_and_nothing_else(spark):
    df = scored(spark, '{"userid":"u","timestamp":1,"text":[]}')
    assert envelopes(df) == [[]]
    assert events.warehouse_rows(df).count() == 0
    assert events.keyed_scores(df).count() == 0


def test_keys_that_are_pieces_of_text_are_dropped(spark):
    keys = ["t", "e", "x", "te", "ex", "xt", "tex", "ext", "", "callback_url", "texts", "tt"]
    body = json.dumps({"userid": "u", "timestamp": 1, "text": "hi", **{k: 1 for k in keys}})
    ((strict,),) = envelopes(scored(spark, body))
    assert set(strict) == {
        "userid", "timestamp", "callback_url", "texts", "tt",
        "start_time", "end_time", "text", "score", "score_detail",
    }
    lax = PipelineConfig(event_time="payload", strict_key_filter=False)
    ((entry,),) = envelopes(scored(spark, body, cfg=lax), lax)
    assert set(keys) < set(entry)


def test_sentence_keys_win_over_the_message(spark):
    body = '{"userid":"u","text":"hi","score":9,"start_time":"x","score_detail":1,"end_time":2}'
    ((entry,),) = envelopes(scored(spark, body))
    assert entry["start_time"] == "" and entry["score"] < 0.01 and entry["score_detail"]["detail"]


def test_nested_extras_pass_through(spark):
    extra = {"a": [1, {"b": None}], "c": "é"}
    ((entry,),) = envelopes(scored(spark, json.dumps({"text": "hi", "extra": extra})))
    assert entry["extra"] == extra


def test_warehouse_columns(spark):
    rows = events.warehouse_rows(scored(spark, '{"userid":"u","timestamp":1,"text":"hi"}'))
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in WAREHOUSE]


def test_message_without_user_is_scored_but_in_no_window(spark):
    df = scored(spark, '{"timestamp":1,"text":"hi"}')
    assert envelopes(df)[0][0]["text"] == "hi"
    assert events.warehouse_rows(df).count() == 1
    assert events.keyed_scores(df).count() == 0
    assert events.without_user(df).count() == 1


def test_bytes_for_a_topic(spark):
    df = events.with_envelope(scored(spark, '{"userid":"u","text":"é"}'), CFG)
    assert json.loads(bytes(events.as_bytes(df).first()["value"]).decode("utf-8"))[0]["text"] == "é"


def test_post_processing_hook(spark):
    df = scored(spark, '{"text":"hi"}')
    assert events.post_process(df) is df
    marked = events.post_process(df, lambda d: d.withColumn("mark", F.lit(1)))
    assert marked.first()["mark"] == 1


def test_outbox_has_one_row_per_entry_with_a_callback(spark):
    text = [{"text": "a"}, {"text": "b"}]
    with_url = json.dumps({"text": text, "callback_url": "https://c.example"})
    df = events.with_envelope(scored(spark, with_url, '{"text":"c"}'), CFG)
    rows = events.callback_outbox(df).collect()
    assert [(r["callback_url"], json.loads(r["payload"])["text"]) for r in rows] == [
        ("https://c.example", "a"),
        ("https://c.example", "b"),
    ]


def test_push_envelope(spark):
    body = '{"message":{"data":"W3siYSI6ICLDqSJ9XQ=="}}'
    df = spark.createDataFrame([(body,), ('{"message":{}}',), ("x",)], "body string")
    found = [r["v"] for r in df.select(records.decode_push_envelope(F.col("body")).alias("v")).collect()]
    assert found == ['[{"a": "é"}]', None, None]


def test_dotted_path_with_default(spark):
    doc = F.parse_json(F.lit('{"a":{"b":{"c":3}}}'))
    row = spark.range(1).select(
        records.get_path(doc, "a.b.c", "int").alias("there"),
        records.get_path(doc, "a.x.c", "int", F.lit(-1)).alias("absent"),
    ).first()
    assert (row["there"], row["absent"]) == (3, -1)


def test_parsing_happens_once(spark):
    """A filter on the parsed record must not repeat the parsing below itself."""
    df = events.warehouse_rows(scored(spark, '{"userid":"u","text":"hi"}'))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson(value") == 1


def test_clocks_out_of_range_stop_nothing(spark):
    micro, milli, good = 1700000000000000, 1700000000000, 1700000000
    values = [json.dumps({"userid": "u", "text": "a", "timestamp": t}) for t in (micro, milli, good)]
    parsed = events.with_event_columns(events.parse_events(messages(spark, *values)), CFG, F.lit(NOW))
    found = [r["event_time"] for r in parsed.orderBy("message_id").collect()]
    assert found[0] is None and found[1] is None and found[2].year == 2023
    day = F.to_date(records.seconds_time(F.col("timestamp")))
    assert [r[0] is None for r in parsed.orderBy("message_id").select(day).collect()] == [True, True, False]
