"""File names, transcripts, routing and metadata."""

import json

import pytest
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions import names, text
from banterscope.operators import audio
from banterscope.plans import transcripts_run
from banterscope.schema import STT_RESULT


def now():
    return F.lit(1700000000)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://x.y/a%20b/12 My-File(1).MP3?x=1", "my_file_1_.mp3"),
        ("https://h/123.mp3", "mp3"),
        ("https://h/a.ogg", "noid_1700000000.mp3"),
        ("https://h/a.wav/b.flac", "a.wav"),
        ("https://h/é_x.flac", "x.flac"),
        (None, "noid_1700000000.mp3"),
        ("", "noid_1700000000.mp3"),
    ],
)
def test_audio_file_name(spark, url, expected):
    assert one(spark, names.audio_file_name(F.lit(url).cast("string"), now())) == expected


@pytest.mark.parametrize(
    "make, name, expected",
    [
        (names.flac_name, "A.MP3", "a.flac"),
        (names.flac_name, "mp3", "mp3"),
        (names.sidecar_name, "a.b.wav", "a.b.json"),
        (names.long_result_name, "a.flac", "a.json"),
        (names.long_result_name, "a.FLAC", "a.FLAC"),
        (names.long_result_name, "a_flac", "a.json"),
        (names.short_metadata_name, "A.FLAC.flac", "a.json.json"),
        (lambda c: names.short_result_name(c, now()), "a.flac", "a_1700000000.json"),
        (lambda c: names.message_name(c, now()), "Bob", "bob_1700000000.json"),
        (lambda c: names.message_name(c, now()), None, "1700000000.json"),
        (names.is_flac, "A.FLAC \n", True),
        (names.is_flac, "a.flac.mp3", False),
    ],
)
def test_names(spark, make, name, expected):
    assert one(spark, make(F.lit(name).cast("string"))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Hi there. How are you? Fine! ok. x", ["Hi there", "How are you", "Fine"]),
        ("one", ["one"]),
        ("a.b?c!d", ["a.b?c!d"]),
        ("", []),
        ("é é. ab", ["é é"]),
    ],
)
def test_sentences(spark, given, expected):
    assert one(spark, text.split_sentences(F.lit(given))) == expected


def test_small_text_functions(spark):
    assert one(spark, text.ascii_lower(F.lit("AZÉ"))) == "azÉ"
    assert one(spark, text.truncate(F.lit("é" * 600))) == "é" * 511
    assert one(spark, text.join_pieces(F.array(F.lit(" a"), F.lit("b\n")))) == "a b"
    assert one(spark, text.seconds_of(F.lit("12.3s"))) == 12.3
    assert one(spark, text.seconds_of(F.lit("soon"))) is None


def result(*spoken):
    return {
        "results": [
            {"alternatives": [{"transcript": t}] if t is not None else [], "resultEndTime": f"{i + 1}.5s"}
            for i, t in enumerate(spoken)
        ]
    }


def results(spark, *files):
    lines = spark.createDataFrame([(json.dumps(f),) for f in files], "j string")
    return lines.select(F.from_json("j", STT_RESULT).alias("r")).select("r.results")


def test_long_transcripts_are_not_deduplicated(spark):
    (row,) = results(spark, result("a", "a", "b")).select(audio.regroup_long(F.col("results")).alias("s")).collect()
    assert [tuple(s) for s in row["s"]] == [("a", "0s", "1.5s"), ("a", "1.5s", "2.5s"), ("b", "2.5s", "3.5s")]


def test_long_transcript_without_results(spark):
    assert results(spark, {"results": []}).select(audio.regroup_long(F.col("results")).alias("s")).first()["s"] == []


def test_short_transcripts_are_deduplicated(spark):
    merged = audio.merge_short(F.col("results"))
    row = results(spark, result("b", "a", "b")).select(audio.short_segment(merged).alias("s")).first()
    assert [tuple(s) for s in row["s"]] == [("b a", "0s", "59s")]


def test_broken_files(spark):
    files = results(spark, result("a"), result("a", None), {}, {"results": []}, {"results": [{}]})
    found = files.select(audio.is_broken_result(F.col("results")).alias("b")).collect()
    assert [r["b"] for r in found] == [False, True, True, False, True]


@pytest.mark.parametrize("seconds, route", [(59.9, "short"), (60.0, "long"), (0.0, "short"), (None, "rejected")])
def test_audio_route(spark, seconds, route):
    df = spark.createDataFrame([(seconds,)], "duration double")
    assert audio.route_audio(df, PipelineConfig()).first()["route"] == route


@pytest.mark.parametrize("translate, expected", [(True, {1: "hi", 2: "x y", 3: "ciao", 4: "hm"}), (False, {1: "hi", 2: "hola", 3: "ciao", 4: "hm"})])
def test_language_route(spark, translate, expected):
    spoken = spark.createDataFrame(
        [(1, "hi", "EN-us"), (2, "hola", "es-ES"), (3, "ciao", "it-IT"), (4, "hm", None)],
        "id int, text string, language string",
    )
    translated = spark.createDataFrame([(1, ["no"]), (2, ["x", "y "])], "id int, pieces array<string>")
    routed = audio.route_language(spoken, translated, "id", PipelineConfig(translate=translate))
    assert {r["id"]: r["final_text"] for r in routed.collect()} == expected


def test_detected_language(spark):
    files = results(spark, {"results": [{"languageCode": "es-ES"}]}, {"results": []}, {})
    assert [r[0] for r in files.select(audio.detected_language(F.col("results"))).collect()] == ["es-ES", "en-us", "en-us"]


def test_collisions(spark):
    df = spark.createDataFrame([("https://h/1.mp3",), ("https://h/2.mp3",), ("https://h/a.mp3",)], "audio_uri string")
    found = audio.name_collisions(audio.audio_manifest(df, now())).collect()
    assert [tuple(r) for r in found] == [("mp3", 2)]


def test_transcript_files_to_drop_zone(spark, tmp_path):
    """Result files and sidecars on disk, joined, and written as messages."""
    (tmp_path / "stt").mkdir()
    (tmp_path / "meta").mkdir()
    (tmp_path / "stt" / "A.json").write_text(json.dumps(result("x", "y"), indent=1))
    (tmp_path / "stt" / "lost.json").write_text(json.dumps(result("z")))
    (tmp_path / "meta" / "a.json").write_text(json.dumps({"userid": "u", "timestamp": 3, "text": "old"}))
    (tmp_path / "meta" / "a.flac").write_text("sound")
    (tmp_path / "stt" / "broken.json").write_text(json.dumps(result("z", None)))
    (tmp_path / "meta" / "broken.json").write_text("{}")
    transcripts_run.run_long(
        spark, str(tmp_path / "stt"), str(tmp_path / "meta"), str(tmp_path / "out"), str(tmp_path / "errors")
    )
    failed = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "errors")).collect())
    assert failed == [("broken.json", "transcript missing"), ("lost.json", "metadata missing")]
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert json.loads(line) == {
        "userid": "u",
        "timestamp": 3,
        "text": [
            {"text": "x", "start_time": "0s", "end_time": "1.5s"},
            {"text": "y", "start_time": "1.5s", "end_time": "2.5s"},
        ],
    }


def test_short_transcripts(spark):
    spoken = {"A.flac": ["hola", "hola"], "b.FLAC": ["hi"], "c.mp3": ["no"], "d.flac": [None]}
    rows = [
        (name, json.dumps({"results": [
            {"alternatives": [{"transcript": t}] if t else [], "languageCode": "es-ES" if name == "A.flac" else "en-us"}
            for t in said]}))
        for name, said in spoken.items()
    ]
    files = spark.createDataFrame(rows, "object_name string, j string").select(
        "object_name", F.from_json("j", STT_RESULT)["results"].alias("results")
    )
    metadata = spark.createDataFrame(
        [("a.json", '{"userid":"u","timestamp":null}'), ("b.json", '{"userid":"v"}'), ("d.json", "{}")],
        "object_name string, metadata string",
    )
    translated = spark.createDataFrame([("A.flac", ["hello "])], "object_name string, pieces array<string>")
    found = transcripts_run.short_transcripts(files, metadata, PipelineConfig(translate=True), now(), translated)
    rows = {r["object_name"]: r for r in found.collect()}
    assert set(rows) == {"a.json", "b.json", "d.json"}
    assert tuple(rows["a.json"]["segments"][0]) == ("hello", "0s", "59s")
    assert json.loads(rows["a.json"]["metadata"]) == {"userid": "u", "timestamp": None}
    assert json.loads(rows["b.json"]["metadata"]) == {"userid": "v", "timestamp": 1700000000}
    assert rows["a.json"]["result_name"] == "A_1700000000.json"
    assert [rows[k]["error"] for k in sorted(rows)] == [None, None, "transcript missing"]
