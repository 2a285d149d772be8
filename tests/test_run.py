"""The command line."""

import json

import pytest

from banterscope import run
from banterscope.functions import probability
from banterscope.streaming import jobs


def test_options_reach_the_jobs():
    args = run.arguments(["replay", "--root", "r", "--messages", "m", "--window-seconds", "60", "--strict-key-filter", "false"])
    cfg = run.options(args)
    assert (cfg.window_seconds, cfg.slide_seconds, cfg.strict_key_filter) == (60, 5, False)
    with pytest.raises(ValueError):
        run.options(run.arguments(["replay", "--root", "r", "--slide-seconds", "90"]))


OWN = """
import pandas as pd
from banterscope.operators.scoring import LexiconScorer, PandasScorer

def load():
    return lambda texts: pd.DataFrame({"score": texts.str.len() / 100.0})

def make(divisor):
    by = float(divisor)
    return PandasScorer(lambda: lambda texts: pd.DataFrame({"score": texts.str.len() / by}))
"""


@pytest.mark.parametrize(
    ("given", "score"),
    [
        (["--scorer", "pandas", "--load", "own_scores:load"], 0.09),
        (["--scorer", "own_scores:make", "--scorer-option", "divisor=10"], 0.9),
        (["--scorer", "attributes", "--responses", "{}/responses"], 0.5),
    ],
)
def test_scorers_of_ones_own(spark, tmp_path, monkeypatch, given, score):
    (tmp_path / "own_scores.py").write_text(OWN)
    monkeypatch.syspath_prepend(tmp_path)
    spark.sparkContext.addPyFile(str(tmp_path / "own_scores.py"))
    response = json.dumps({"attributeScores": {a: {"summaryScore": {"value": 0.5}} for a in probability.ATTRIBUTES}})
    spark.createDataFrame([("some text", response)], "text string, response string").write.parquet(str(tmp_path / "responses"))
    args = run.arguments(["replay", "--root", "r", *[g.format(tmp_path) for g in given]])
    df = spark.createDataFrame([("m", ["some text"])], "message_id string, texts array<string>")
    found = run.chosen_scorer(spark, args).attach(df, "texts", "scores").first()["scores"]
    assert found[0]["score"] == pytest.approx(score)


@pytest.mark.parametrize("name", ["attributes", "pandas", "linear", "sparkml", "nothing", "a:", ":b"])
def test_scorers_say_what_they_need(spark, name):
    with pytest.raises(ValueError):
        run.chosen_scorer(spark, run.arguments(["replay", "--root", "r", "--scorer", name]))


def test_replay(spark, tmp_path):
    vile = "scum trash idiot moron worthless pathetic"
    lines = [json.dumps({"userid": "u", "timestamp": t, "text": vile, "callback_url": "c"}) for t in (0, 1, 100)]
    (tmp_path / "in.jsonl").write_text("\n".join([*lines, "{broken"]))
    root = tmp_path / "root"
    run.main(["replay", "--root", str(root), "--messages", str(tmp_path / "in.jsonl"), "--event-time", "payload"])
    assert spark.read.parquet(str(root / "scored")).count() == 4
    assert spark.read.text(str(root / "topic")).count() == 3
    assert spark.read.parquet(str(root / "warehouse")).count() == 3
    assert spark.read.parquet(str(root / "outbox")).count() == 3
    assert spark.read.parquet(str(root / "flags")).count() == 1
    assert spark.read.parquet(str(root / "quarantine")).first()["raw"] == "{broken"
    with pytest.raises(Exception, match="(?i)exist"):
        run.main(["replay", "--root", str(root), "--messages", str(tmp_path / "in.jsonl")])


def spoken(text, language="en-US"):
    return json.dumps({"results": [{"alternatives": [{"transcript": text}], "resultEndTime": "1s", "languageCode": language}]})


@pytest.mark.parametrize(("job", "suffix"), [("transcripts", "json"), ("short-transcripts", "flac")])
def test_transcripts_are_delivered_once(spark, tmp_path, job, suffix):
    stt, meta, zone, root = (tmp_path / n for n in ("stt", "meta", "zone", "root"))
    stt.mkdir()
    meta.mkdir()
    given = [job, "--root", str(root), "--results", str(stt), "--sidecars", str(meta), "--messages", str(zone)]
    lines = lambda: sorted(json.loads(r.value)["userid"] for r in spark.read.text(str(zone)).collect())
    for name in ("a", "late"):
        (stt / f"{name}.{suffix}").write_text(spoken(f"words of {name}"))
    (meta / "a.json").write_text(json.dumps({"userid": "u", "timestamp": 3}))
    run.main(given)
    run.main(given)
    assert lines() == ["u"]
    errors = spark.read.parquet(str(root / "transcript_errors")).collect()
    assert [tuple(r) for r in errors] == [("late.json", "metadata missing")]
    # Metadata that comes later lets its transcript through, and nothing else again.
    (meta / "late.json").write_text(json.dumps({"userid": "v", "timestamp": 4}))
    run.main(given)
    run.main(given)
    assert lines() == ["u", "v"]
    names = {r.object_name: r.result_name for r in spark.read.parquet(str(root / "transcripts_delivered")).collect()}
    assert set(names) == {"a.json", "late.json"} and all(n.startswith(k[:-5]) for k, n in names.items())


def test_stream(spark, tmp_path):
    """All jobs at once; messages that arrive later go all the way through."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    root = str(tmp_path / "root")
    args = run.arguments(
        ["stream", "--root", root, "--messages", str(inbox), "--event-time", "payload", "--every", "1 second"]
    )
    started = run.start_stream(spark, args)
    try:
        vile = "scum trash idiot moron worthless pathetic"
        for t in (0, 500):
            line = json.dumps({"userid": "u", "timestamp": t, "text": vile, "callback_url": "c"})
            (inbox / f"{t}.jsonl").write_text(line + "\n{broken")
            for query in started:
                query.processAllAvailable()
        assert spark.read.parquet(f"{root}/scored").count() == 4
        assert spark.read.text(f"{root}/topic").count() == 2
        assert spark.read.parquet(f"{root}/warehouse").count() == 2
        assert spark.read.parquet(f"{root}/outbox").count() == 2
        assert spark.read.parquet(f"{root}/quarantine").count() == 2
        raised = jobs.alert_job(run.options(args), jobs.Layout(root)).alerts(spark)
        assert [r["userid"] for r in raised.collect()] == ["u"]
    finally:
        for query in started:
            query.stop()
