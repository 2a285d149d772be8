"""From labelled comments to a published scorer, step by step.

Every step leaves a table, so a later step reads what an earlier one wrote and nothing is
computed twice. A run lives in a folder of its own under ``root``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.operators import datasets, models
from banterscope.sources import tables


@dataclass(frozen=True)
class TrainingRun:
    """What a run needs. ``schema_path`` and ``domains_path`` import a schema made before."""

    root: str
    model_id: str
    model_name: str = "toxicity"
    schema_path: str | None = None
    domains_path: str | None = None
    preprocessing_fn: Callable[[DataFrame], DataFrame] = datasets.default_preprocessing
    build: Callable[[], Pipeline] = models.text_pipeline

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/runs/{self.model_id}/{name}"

    @property
    def registry(self) -> str:
        return f"{self.root.rstrip('/')}/registry"

    @property
    def serving(self) -> str:
        return f"{self.root.rstrip('/')}/serving"


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, examples: DataFrame, job: TrainingRun) -> bool:
    """Statistics, schema, validation, features, training, evaluation, blessing, publishing.

    ``examples`` has ``comment_text`` and ``target``. Anomalies are stored, and training
    goes on: what to do about them is up to who reads the table. True if published.
    """
    given = _store(examples, job.table("examples"))
    stats = _store(datasets.feature_statistics(given), job.table("statistics"))
    counts = _store(datasets.value_counts(given), job.table("values"))
    _store(datasets.dataset_statistics(stats, counts), job.table("summary"))
    if job.schema_path:
        schema = datasets.import_schema(spark.read.parquet(job.schema_path))
        domains = spark.read.parquet(job.domains_path) if job.domains_path else _no_domains(spark)
    else:
        schema = _store(datasets.infer_schema(stats, counts), job.table("schema"))
        domains = _store(datasets.infer_domains(counts, schema), job.table("domains"))
    _store(datasets.validate_examples(stats, counts, schema, domains), job.table("anomalies"))

    is_training = datasets.is_training(F.concat_ws("|", "comment_text", F.col("target").cast("string")))
    marked = datasets.preprocess(given.withColumn("training", is_training), job.preprocessing_fn)
    features = _store(marked, job.table("features"))
    model = models.train_text_scorer(features.where("training"), job.build)

    held_out = features.where(~F.col("training"))
    metrics = _evaluated(model, held_out)
    candidate = metrics.withColumns(
        {
            "model_name": F.lit(job.model_name),
            "model_id": F.lit(job.model_id),
            "created_at": F.current_timestamp(),
        }
    )
    registry = _registry(spark, job)
    # The older model meets the same examples as the candidate, a harder sample is hard for both.
    older = models.load_latest(spark, job.registry, job.serving, job.model_name)
    measured = None if older is None else _evaluated(older, held_out).select(F.lit(job.model_name).alias("model_name"), "accuracy")
    decided = _store(models.bless(candidate, registry, measured), job.table("decision"))
    return models.publish(model, decided, job.serving, job.registry)


def _evaluated(model: PipelineModel, examples: DataFrame) -> DataFrame:
    scored = model.transform(examples).select(models.score_probability().alias("score"), "label")
    return models.evaluation_metrics(scored)


def _no_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "feature string, value string")


def _registry(spark: SparkSession, job: TrainingRun) -> DataFrame:
    """The registry, which the first run of all creates."""
    spark.createDataFrame([], models.REGISTRY).write.mode("append").parquet(job.registry)
    return models.load_registry(spark, job.registry)


def run_csv(spark: SparkSession, csv: str, job: TrainingRun) -> bool:
    return run(spark, tables.labelled_comments(spark, csv), job)
