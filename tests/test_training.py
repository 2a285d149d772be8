"""Training data, statistics, validation, models and their registry."""

import pytest
from pyspark.sql import functions as F

from banterscope.operators import datasets, models
from banterscope.sinks import batch
from banterscope.sources import tables


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_labelled_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('comment_text,target\n"say ""hi"",\nthen go",0.75\nplain,0\n')
    found = rows_of(tables.labelled_comments(spark, str(tmp_path)))
    assert found == [("plain", 0.0), ('say "hi",\nthen go', 0.75)]


def test_split_is_stable_and_complete(spark):
    df = spark.range(20000)
    train, test = datasets.train_test(df, "id")
    again, _ = datasets.train_test(df.repartition(7), "id")
    assert train.exceptAll(again).count() == 0
    assert train.count() + test.count() == 20000
    assert 0.78 < train.count() / 20000 < 0.82


def test_split_takes_any_key(spark):
    df = spark.createDataFrame([(str(2**80),), ("x",)], "k string")
    train, test = datasets.train_test(df, "k")
    assert train.count() + test.count() == 2


def test_preprocessing_hook(spark):
    df = spark.createDataFrame([("AÉ", 1.0)], "comment_text string, target double")
    assert rows_of(datasets.preprocess(df).select("text", "label")) == [("aÉ", 1.0)]
    mine = datasets.preprocess(df, lambda d: d.select(F.length("comment_text").alias("n")))
    assert rows_of(mine) == [(2,)]


def test_embeddings_come_in_batches(spark):
    sizes = []

    def embed(texts):
        return [[float(len(texts)), float(len(t))] for t in texts]

    # Whole comments; a NULL one has no vector.
    none = spark.createDataFrame([(None, 1)], "comment_text string, id long")
    assert datasets.attach_embeddings(none, embed).first()["embedded_text"] is None
    df = spark.range(250).select(F.repeat(F.lit("x"), 600).alias("comment_text"), "id").coalesce(1)
    found = datasets.attach_embeddings(df, embed).collect()
    sizes = sorted({r["embedded_text"][0] for r in found})
    assert sizes == [50.0, 100.0] and {r["embedded_text"][1] for r in found} == {600.0}
    assert sorted(r["id"] for r in found) == list(range(250))


def described(df):
    return datasets.feature_statistics(df), datasets.value_counts(df)


@pytest.fixture(scope="module")
def people(spark):
    rows = [("a", 1, 0.5), ("a", 0, None), ("b", 3, 1.5), (None, 4, 2.0)]
    return spark.createDataFrame(rows, "name string, n int, x double")


def test_statistics(spark, people):
    found = {r["feature"]: r for r in datasets.dataset_statistics(*described(people)).collect()}
    name, n, x = found["name"], found["n"], found["x"]
    assert (name["type"], name["examples"], name["missing"], name["avg_length"]) == ("BYTES", 4, 1, 1.0)
    assert (name["distinct_values"], name["top_value"], name["top_count"]) == (2, "a", 2)
    assert (n["type"], n["min"], n["max"], n["mean"], n["zeros"]) == ("INT", 0, 4, 2.0, 1)
    assert (x["type"], x["missing"], x["mean"]) == ("FLOAT", 1, pytest.approx(4 / 3))
    assert n["std"] == pytest.approx(2.5**0.5) and n["top_value"] is None


def test_top_values(spark, people):
    found = rows_of(datasets.top_values(datasets.value_counts(people), 1))
    assert found == [("name", "a", 2, 1)]


def test_values_of_any_length_are_counted(spark):
    df = spark.createDataFrame([("x" * 2000,), ("x" * 2000,), ("x" * 1999,), ("y" * 1024,)], "t string")
    found = {r["value"]: r["count"] for r in datasets.value_counts(df).collect()}
    assert found == {"x" * 2000: 2, "x" * 1999: 1, "y" * 1024: 1}


@pytest.mark.parametrize("size", [99, 100, 101, 5000])
def test_domains_have_any_size(spark, size):
    df = spark.range(size).select(F.col("id").cast("string").alias("t"))
    schema = datasets.infer_schema(*described(df))
    assert schema.first()["domain_size"] == size
    assert datasets.infer_domains(datasets.value_counts(df), schema).count() == size


def test_parts_by_whole_shares(spark):
    keys = spark.range(30_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    shares = {"none": 0, "train": 4, "eval": 2, "test": 1}
    part = datasets.split_name(F.col("k"), shares)
    found = {r["part"]: r["count"] for r in keys.groupBy(part.alias("part")).count().collect()}
    assert set(found) == {None, "train", "eval", "test"} and found[None] == 1
    for name, share in shares.items():
        assert abs(found.get(name, 0) / 30_000 - share / 7) < 0.01
    for wrong in ({}, {"a": 0}, {"a": -1, "b": 2}):
        with pytest.raises(ValueError):
            datasets.split_name(F.col("k"), wrong)


def test_quantiles(spark):
    df = spark.range(1, 10002).select(F.col("id").alias("n"), F.lit("t").alias("t"))
    found = {r["share"]: r["value"] for r in datasets.quantiles(df, accuracy=1000).collect()}
    assert set(found) == {0.0, 0.25, 0.5, 0.75, 1.0}
    assert datasets.quantiles(df, accuracy=1000).first()["rank_error"] == pytest.approx(10.001)
    for share, value in found.items():
        assert abs(value - (1 + share * 10000)) <= 10001 / 1000 + 1


@pytest.mark.parametrize(
    "values",
    [
        [],
        [None, None],
        [7.0],
        [3.0, 3.0, 3.0, None, 4.0],
        [1.7e308, -1.7e308, 5e-324, 0.0, 1.0, 1e-300],
        [float("inf"), -float("inf"), float("nan"), 1.0, 2.0],
        [float("nan"), float("nan")],
        [float("inf")] * 3 + [5e-324, 1e-323],
        [((i * 7919) % 5003) ** 3 / 7 for i in range(5003)] + [42.0] * 2500,
    ],
)
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v, "t", None if v is None or v != v or abs(v) > 1e9 else int(v)) for v in values], "`a.b` double, t string, n long").repartition(4)
    for bins, points in ((3, 4), (1000, 7)):
        found = {(r["feature"], round(r["share"] * points)): r["value"] for r in datasets.exact_quantiles(df, points, bins).collect()}
        assert len(found) == 2 * (points + 1)
        columns = {"a.b": list(values), "n": [float(int(v)) for v in values if v is not None and v == v and abs(v) <= 1e9]}
        for (feature, i), value in found.items():
            own = sorted((v for v in columns[feature] if v is not None), key=lambda v: (v != v, v))
            want = own[max(1, -(-i * len(own) // points)) - 1] if own else None
            assert value == want or value != value and want != want, (feature, i)


def test_exact_quantiles_without_numbers(spark):
    assert datasets.exact_quantiles(spark.createDataFrame([("x",)], "t string")).count() == 0


def test_inferred_schema(spark, people):
    found = rows_of(datasets.infer_schema(*described(people)))
    assert found == [("n", "INT", True, None), ("name", "BYTES", False, 2), ("x", "FLOAT", False, None)]
    narrow = datasets.infer_schema(*described(people), domains=["other"])
    assert narrow.where("feature = 'name'").first()["domain_size"] is None
    domains = datasets.infer_domains(datasets.value_counts(people), datasets.infer_schema(*described(people)))
    assert rows_of(domains) == [("name", "a"), ("name", "b")]


def test_imported_schema(spark):
    df = spark.createDataFrame([("n", "INT", True, None)], "feature string, type string, required boolean, domain_size int")
    assert datasets.import_schema(df).schema["domain_size"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        datasets.import_schema(df.drop("type"))


def test_anomalies(spark, people):
    schema = datasets.infer_schema(*described(people))
    domains = datasets.infer_domains(datasets.value_counts(people), schema)
    assert datasets.validate_examples(*described(people), schema, domains).count() == 0
    odd = spark.createDataFrame(
        [("c", None, 1, "new"), ("c", 1, 2, "new"), ("a", 1, 3, "new")], "name string, n int, x int, y string"
    )
    assert rows_of(datasets.validate_examples(*described(odd), schema, domains).na.fill("-")) == [
        ("n", "missing_values", "-", 1),
        ("name", "value_outside_domain", "c", 2),
        ("x", "type_change", "FLOAT>INT", 3),
        ("y", "new_feature", "BYTES", 3),
    ]
    assert rows_of(datasets.validate_examples(*described(odd.drop("x", "y")), schema, domains).na.fill("-"))[-1] == (
        "x", "missing_feature", "-", 0,
    )


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.4, 1.0), (0.1, 0.0), (0.5, 0.0)], "score double, label double")
    row = models.evaluation_metrics(df).first()
    assert (row["example_count"], row["accuracy"]) == (4, 0.5)
    assert row["mae"] == pytest.approx(1.3 / 4) and row["mse"] == pytest.approx((0.01 + 0.36 + 0.01 + 0.25) / 4)


@pytest.mark.parametrize(
    "accuracy, baseline, blessed",
    [(0.5, None, True), (0.4999, None, False), (0.8, 0.8, True), (0.8, 0.8 + 1e-11, True), (0.8, 0.81, False), (0.4, 0.3, False)],
)
def test_blessing(spark, accuracy, baseline, blessed):
    candidate = spark.createDataFrame([("m", accuracy)], "model_name string, accuracy double")
    past = [("m", "bad", 2, 0.99, False), ("other", "x", 9, 0.99, True)]
    if baseline is not None:
        past += [("m", "old", 1, 0.1, True), ("m", "last", 3, baseline, True)]
    registry = spark.createDataFrame(
        past, "model_name string, model_id string, created_at int, accuracy double, blessed boolean"
    )
    assert models.bless(candidate, registry).first()["blessed"] is blessed


def test_blessing_by_the_same_examples(spark):
    """What the older model reaches on the candidate's examples counts, not what was stored."""
    candidate = spark.createDataFrame([("m", 0.7)], "model_name string, accuracy double")
    registry = spark.createDataFrame(
        [("m", "old", 1, 0.9, True)], "model_name string, model_id string, created_at int, accuracy double, blessed boolean"
    )
    assert models.bless(candidate, registry).first()["blessed"] is False
    for reached, blessed in ((0.6, True), (0.8, False)):
        measured = spark.createDataFrame([("m", reached)], "model_name string, accuracy double")
        row = models.bless(candidate, registry, measured).first()
        assert (row["baseline_accuracy"], row["blessed"]) == (reached, blessed)


def test_every_word_counts(spark):
    """A word of one comment only has a bucket too, and columns and pipeline agree on it."""
    from banterscope.operators.scoring import LinearTextScorer

    words = ["a", "bc", "def", "ghij", "klmno", "pqrstu", "vwxyzab", "cdefghij"]
    rows = [(f"you {w} idiot" if i % 2 else f"nice {w} game", float(i % 2)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows * 3, "text string, label double")
    model = models.train_text_scorer(df, lambda: models.text_pipeline(1 << 12, 30, 0.0))
    linear = LinearTextScorer.from_model(model)
    split = df.select(F.explode(F.split("text", " ")).alias("w"))
    known = split.select(models.bucket(F.col("w"), 1 << 12).cast("string").alias("b")).distinct()
    assert {r["b"] for r in known.collect()} >= set(linear.weights) and len(linear.weights) >= len(words)
    both = model.transform(df).select(models.score_probability().alias("a"), linear.score_column(F.col("text")).alias("b"))
    assert all(r["a"] == pytest.approx(r["b"]) for r in both.collect())


def test_train_publish_and_load(spark, tmp_path):
    """The whole way from comments to a served model."""
    rows = [("You IDIOT", 1.0), ("such a moron", 1.0), ("well played", 0.0), ("good game", 0.0)] * 10
    df = spark.createDataFrame(rows, "comment_text string, target double")
    batch.write_features(datasets.preprocess(df), str(tmp_path / "features"))
    features = tables.features(spark, str(tmp_path / "features"))
    model = models.train_text_scorer(features, lambda: models.text_pipeline(512, 10))
    scored = model.transform(features).select(models.score_probability().alias("score"), "label")
    registry_path, serving = str(tmp_path / "registry"), str(tmp_path / "serving")

    def offer(model_id, metrics, day):
        candidate = metrics.withColumns(
            {
                "model_name": F.lit("text"),
                "model_id": F.lit(model_id),
                "created_at": F.lit(f"2024-01-0{day}").cast("timestamp"),
            }
        )
        return models.publish(model, models.bless(candidate, models.load_registry(spark, registry_path)), serving, registry_path)

    spark.createDataFrame([], models.REGISTRY).write.parquet(registry_path)
    assert models.load_latest(spark, registry_path, serving, "text") is None
    assert offer("one", models.evaluation_metrics(scored), 1) is True
    worse = models.evaluation_metrics(scored.withColumn("score", 1 - F.col("score")))
    assert offer("two", worse, 2) is False
    assert rows_of(models.load_registry(spark, registry_path).select("model_id", "blessed")) == [("one", True), ("two", False)]
    loaded = models.load_latest(spark, registry_path, serving, "text")
    again = loaded.transform(features).select(models.score_probability().alias("score"))
    assert rows_of(again) == rows_of(scored.select("score"))


def test_training_run(spark, tmp_path):
    """CSV in, model served; a second run with an imported schema is measured against it."""
    from banterscope.plans.training_run import TrainingRun, run_csv

    lines = "".join(f'"You {w} {i}",1\n"good {g} {i}",0\n' for i in range(30) for w, g in [("IDIOT", "game")])
    (tmp_path / "c.csv").write_text("comment_text,target\n" + lines)

    def build():
        return models.text_pipeline(512, 10)

    first = TrainingRun(str(tmp_path / "root"), "one", build=build)
    assert run_csv(spark, str(tmp_path / "c.csv"), first) is True
    second = TrainingRun(
        str(tmp_path / "root"), "two", build=build,
        schema_path=first.table("schema"), domains_path=first.table("domains"),
    )
    assert run_csv(spark, str(tmp_path / "c.csv"), second) is True
    found = models.load_registry(spark, first.registry).select("model_id", "blessed", "accuracy")
    assert rows_of(found) == [("one", True, 1.0), ("two", True, 1.0)]
    assert spark.read.parquet(second.table("anomalies")).count() == 0
    served = models.load_latest(spark, first.registry, first.serving, "toxicity")
    assert served is not None
