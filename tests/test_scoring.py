"""Scorers and score arithmetic."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from banterscope.functions import probability
from banterscope.operators import scoring, windows
from banterscope.operators.scoring import AttributeTableScorer, LexiconScorer, PandasScorer, SparkMLScorer


def texts(spark, *lists):
    rows = [(str(i), t) for i, t in enumerate(lists)]
    return spark.createDataFrame(rows, "message_id string, texts array<string>")


def scores_of(scorer, df):
    found = scorer.attach(df, "texts", "scores").orderBy("message_id").collect()
    return [None if r["scores"] is None else [s and s["score"] for s in r["scores"]] for r in found]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def conflated(a, b, c):
    return a * b * c / (a * b * c + (1 - a) * (1 - b) * (1 - c))


@pytest.mark.parametrize(
    "given_, expected",
    [((0.05, 0.05, 0.05), 0.00014577259475218664), ((0.0, 1.0, 0.5), None), ((0.5, 0.5, 0.3), 0.3), ((0.0, 0.0, 0.0), 0.0)],
)
def test_conflation(spark, given_, expected):
    found = one(spark, probability.conflate([F.lit(p) for p in given_]))
    assert found == (None if expected is None else pytest.approx(expected, abs=1e-15))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.floats(0.001, 0.999)] * 3), min_size=1, max_size=20))
def test_conflation_is_symmetric_and_bounded(spark, triples):
    df = spark.createDataFrame(triples, "a double, b double, c double")
    a, b, c = (F.col(x) for x in "abc")
    rows = df.select("*", probability.conflate([a, b, c]).alias("s"), probability.conflate([c, a, b]).alias("r"))
    for row in rows.collect():
        assert 0 <= row["s"] <= 1 and row["s"] == pytest.approx(row["r"])
        assert row["s"] == pytest.approx(conflated(row["a"], row["b"], row["c"]))


RESPONSE = '{"attributeScores":{"IDENTITY_ATTACK":{"summaryScore":{"value":0.1}},"INSULT":{"summaryScore":{"value":0.2}},"SEXUALLY_EXPLICIT":{"summaryScore":{"value":0.3}}}}'


@pytest.mark.parametrize(
    "response, expected",
    [
        (RESPONSE, [0.1, 0.2, 0.3]),
        ("{}", [0.0, 0.0, 0.0]),
        ('{"error":{"code":400}}', [0.0, 0.0, 0.0]),
        ('{"attributeScores":{"INSULT":{"summaryScore":{"value":0.2}}}}', [None, 0.2, None]),
        ('{"attributeScores":null}', [None, None, None]),
        (None, [None, None, None]),
    ],
)
def test_attributes(spark, response, expected):
    df = spark.createDataFrame([(response,)], "r string").select(F.try_parse_json("r").alias("r"))
    row = df.select(*[p.alias(f"p{i}") for i, p in enumerate(probability.attribute_probabilities(F.col("r")))]).first()
    assert list(row) == expected


def test_lexicon_counts_whole_words_in_any_case(spark):
    df = texts(spark, ["You IDIOT, you idiots. idiot1 moron-loser éscum", "", None], [], None)
    base = conflated(0.05, 0.05, 0.05)
    # idiot, idiot (before a digit), moron, loser, and scum after a letter that is not ASCII.
    assert scores_of(LexiconScorer(), df) == [
        [pytest.approx(conflated(0.35, 0.95, 0.05)), pytest.approx(base), None], [], None,
    ]


def test_lexicon_rows_and_lists_agree(spark, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("message_id"), "text"
    )
    scorer = LexiconScorer()
    listed = scorer.attach(documents.withColumn("texts", F.array("text")), "texts", "scores")
    rows = scorer.score_rows(documents).join(listed.select("message_id", "scores"), "message_id")
    assert rows.where(F.abs(F.col("score") - F.col("scores")[0]["score"]) > 1e-12).count() == 0
    assert rows.count() == documents.count()


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.6,), (0.5999999,), ((0.1 + 0.5 + 1.2) / 3,)], "s double")
    assert [r[0] for r in df.select(probability.is_toxic(F.col("s"), 0.6)).collect()] == [True, False, True]


def test_pandas_scorer(spark):
    # Local, so that it travels to the tasks by itself.
    def load():
        return lambda batch: pd.DataFrame({"score": batch.str.len() / 10.0, "length": batch.str.len() * 1.0})

    df = texts(spark, ["ab", None, "abc"], [], None, ["x"])
    scorer = PandasScorer(load)
    assert scores_of(scorer, df) == [[0.2, None, 0.3], [], None, [0.1]]
    assert scorer.attach(df, "texts", "s").where("message_id = '3'").first()["s"][0]["detail"] == {"length": 1.0}


def test_attribute_table_scorer(spark):
    responses = spark.createDataFrame([("hi", RESPONSE), ("odd", "{}")], "text string, response string")
    df = texts(spark, ["hi", "unknown", "odd", "hi"], [], None)
    expected = pytest.approx(conflated(0.1, 0.2, 0.3))
    assert scores_of(AttributeTableScorer(responses), df) == [[expected, None, 0.0, expected], [], None]


@pytest.fixture(scope="module")
def small_model(spark):
    from banterscope.operators.models import text_pipeline, train_text_scorer

    rows = [("you idiot", 1.0), ("such an idiot", 1.0), ("well played", 0.0), ("good game", 0.0)] * 5
    training = spark.createDataFrame(rows, "text string, label double")
    return train_text_scorer(training, lambda: text_pipeline(256, 10))


def test_spark_model_scorer(spark, small_model):
    df = texts(spark, ["an IDIOT", None, "good"], [], None)
    (bad, missing, good), empty, none = scores_of(SparkMLScorer(small_model), df)
    assert bad > 0.5 > good and missing is None and empty == [] and none is None
    rows = spark.createDataFrame([("an IDIOT", 1)], "text string, n int")
    assert SparkMLScorer(small_model).score_rows(rows).select("text", "n").first() == ("an IDIOT", 1)


def test_linear_scorer_equals_its_model(spark, small_model, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet").select("text")
    extra = spark.createDataFrame([("Idiot idiot, you",), ("",), ("good GAME",)], "text string")
    linear = scoring.scorer("linear", model=small_model)
    both = SparkMLScorer(small_model).score_rows(documents.union(extra), into="a")
    off = both.where(F.abs(F.col("a") - linear.score_column(F.col("text"))) > 1e-9)
    assert off.count() == 0 and 0 < len(linear.weights) < 10
    df = texts(spark, ["an IDIOT", None], [], None)
    ((bad, missing), empty, none) = scores_of(linear, df)
    assert bad > 0.5 and missing is None and empty == [] and none is None


def test_registry_of_scorers():
    assert isinstance(scoring.scorer("lexicon"), LexiconScorer)
    scoring.register_scorer("mine", lambda **o: LexiconScorer(base=0.2))
    assert scoring.scorer("mine").base == 0.2
    with pytest.raises(ValueError):
        scoring.scorer("nobody")


@pytest.mark.parametrize("part", [1, 2, 100])
def test_sequential_scores(spark, part):
    rows = [("u", i, 0.5) for i in range(1, 8)] + [("v", 3, 0.2)]
    df = spark.createDataFrame(rows, "userid string, at int, score double")
    found = windows.sequential_scores(df, ["userid"], "at", F.floor(F.col("at") / part))
    rows = found.orderBy("userid", "at").collect()
    steps = [0.5 - 0.90, 1 - 0.93, 1 - 0.95, 1 - 0.97, 1 - 0.99]
    assert [r["sequential_score"] for r in rows] == [*map(pytest.approx, steps), None, None, pytest.approx(-0.7)]
    assert [r["position"] for r in rows] == [1, 2, 3, 4, 5, None, None, 1]


def test_analysis_request(spark):
    import json

    request = one(spark, scoring.analysis_request(F.lit('say "hi"')))
    assert json.loads(request) == {
        "comment": {"text": 'say "hi"'},
        "requestedAttributes": {"IDENTITY_ATTACK": {}, "INSULT": {}, "SEXUALLY_EXPLICIT": {}},
    }


def test_several_responses_for_one_text_score_it_once(spark):
    rows = [("hello", '{"attributeScores": {}}'), ("hello", '{"attributeScores": {}}'), ("other", "x")]
    responses = spark.createDataFrame(rows, "text string, response string")
    df = texts(spark, ["hello", "hello"], ["other", "absent"])
    found = AttributeTableScorer(responses).attach(df, "texts", "scores").orderBy("message_id").collect()
    assert [len(r["scores"]) for r in found] == [2, 2]


def test_listed_words_may_have_capitals_and_signs(spark):
    words = {"IDENTITY_ATTACK": ("Idiot",), "INSULT": ("a$$",), "SEXUALLY_EXPLICIT": ("x.y",)}
    scorer = LexiconScorer(words=words)
    (row,) = scorer.score_rows(spark.createDataFrame([("an IDIOT, A$$ and xzy",)], "text string")).collect()
    assert row["identity_attack"] > scorer.base and row["insult"] > scorer.base and row["sexually_explicit"] == scorer.base
