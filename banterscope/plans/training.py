"""Queries over labelled comments and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.operators import datasets, models
from banterscope.plans import inputs
from banterscope.plans.inputs import table
from banterscope.session import materialise


def training_source(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.class_counts(inputs.training_examples(spark, folder))


def train_split(spark: SparkSession, folder: str) -> DataFrame:
    side = F.when(datasets.is_training(F.col("doc_id")), "train").otherwise("test")
    return table(spark, folder, "documents").select("doc_id", side.alias("side"))


def ratio_split(spark: SparkSession, folder: str) -> DataFrame:
    """Two parts for training to one for evaluation."""
    side = datasets.split_name(F.col("doc_id"), {"train": 2, "eval": 1})
    return table(spark, folder, "documents").select("doc_id", side.alias("side"))


def truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return datasets.truncate_comments(documents, "text")


def preprocess_features(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.preprocess(inputs.training_examples(spark, folder))


def _letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for a hosted embedder: length, blanks, and lines of a text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


def embedding_attach(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("comment_text"))
    embedded = datasets.attach_embeddings(documents, _letter_counts)
    vector = F.col("embedded_text")
    return embedded.select(
        "doc_id",
        *[vector[i].cast("double").alias(name) for i, name in enumerate(("length", "blanks", "lines"))],
    )


def dataset_stats(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "events")
    found = datasets.dataset_statistics(datasets.feature_statistics(given), datasets.value_counts(given))
    rounded = [F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std", "avg_length")]
    others = [c for c in found.columns if c not in ("min", "max", "mean", "std", "avg_length")]
    return found.select(*others, *rounded)


def dataset_top_values(spark: SparkSession, folder: str) -> DataFrame:
    found = datasets.top_values(datasets.value_counts(table(spark, folder, "events")), 10)
    return found.select("feature", "value", "count", F.col("rank").cast("bigint").alias("rank"))


def dataset_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.exact_quantiles(table(spark, folder, "events"))


def infer_schema(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "events")
    found = datasets.infer_schema(datasets.feature_statistics(given), datasets.value_counts(given))
    return found.withColumn("required", F.col("required").cast("int"))


def validate_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The schema comes from a time without errors; then views lost their user, the value
    became text, the properties went and a channel came."""
    every = table(spark, folder, "events")
    before = every.where(F.col("event_type") != "error")
    counts = datasets.value_counts(before)
    schema = datasets.infer_schema(datasets.feature_statistics(before), counts)
    after = every.select(
        "event_id",
        "ts",
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"),
        "event_type",
        F.col("value").cast("string").alias("value"),
        F.lit("web").alias("channel"),
    )
    return datasets.validate_examples(
        datasets.feature_statistics(after),
        datasets.value_counts(after),
        schema,
        datasets.infer_domains(counts, schema),
    )


def _lexicon_predictions(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    return inputs.scored_documents(spark, folder).select("doc_id", "score").join(labels, "doc_id")


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = models.evaluation_metrics(_lexicon_predictions(spark, folder))
    return found.select("example_count", *[F.round(c, 6).alias(c) for c in ("accuracy", "mae", "mse")])


def bless_model(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon against a model that calls nothing toxic, and blessed once."""
    lexicon = models.evaluation_metrics(_lexicon_predictions(spark, folder))
    constant = models.evaluation_metrics(
        table(spark, folder, "labels").select(F.lit(0.0).alias("score"), F.col("toxic").alias("label"))
    )
    registry = constant.select(
        F.lit("toxicity").alias("model_name"),
        F.lit("constant").alias("model_id"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        "accuracy",
        F.lit(True).alias("blessed"),
    )
    decided = models.bless(lexicon.withColumn("model_name", F.lit("toxicity")), registry)
    return decided.select(
        "model_name",
        F.round("accuracy", 6).alias("accuracy"),
        F.round("baseline_accuracy", 6).alias("baseline_accuracy"),
        F.col("blessed").cast("int").alias("blessed"),
    )


def latest_blessed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as models: a priority is a name, a finished order a blessed model."""
    registry = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("model_name"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("model_id"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice") / 1000000).alias("accuracy"),
        (F.col("o_orderstatus") == "F").alias("blessed"),
    )
    found = models.latest_blessed(registry)
    return found.select(
        "model_name",
        "model_id",
        inputs.epoch(F.col("created_at")).alias("created_at"),
        F.round("accuracy", 6).alias("accuracy"),
    )


def train_scorer(spark: SparkSession, folder: str) -> DataFrame:
    """Train on the sample, evaluate on its complement. Equal texts are on the same side."""
    examples = datasets.preprocess(inputs.training_examples(spark, folder))
    stored = materialise(examples, "features")
    train, test = datasets.train_test(stored, "text")
    model = models.train_text_scorer(train)
    scored = model.transform(test).select(models.score_probability().alias("score"), "label")
    return models.evaluation_metrics(scored)


def embedding_scorer(spark: SparkSession, folder: str) -> DataFrame:
    """Train on the sample of vectors, count right and wrong on its complement per label."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shape = vectors.agg(F.max(F.size("embedding")).alias("width"), F.max("label").alias("label")).first()
    train, test = datasets.train_test(vectors, "vec_id")
    model = models.train_embedding_scorer(train, shape["width"], shape["label"] + 1)
    scored = model.transform(models.as_features(test))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if(F.col("prediction") == F.col("label")).alias("right"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        training_source, train_split, ratio_split, truncate_text, preprocess_features, embedding_attach,
        dataset_stats, dataset_top_values, dataset_quantiles, infer_schema, validate_examples,
        eval_metrics, bless_model, latest_blessed, train_scorer, embedding_scorer,
    )
}
