"""Training, evaluation, blessing and publishing of scorers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A model must reach this accuracy and may not fall behind by more.
LOWEST_ACCURACY = 0.5
ALLOWED_CHANGE = -1e-10

WORD = "[a-z]+"

# A word filled up to whole blocks of four bytes: there the hash of ``HashingTF`` and the SQL function agree.
_FILLED = "rpad(w, cast(4 * ceil(length(w) / 4.0D) AS int), ' ')"


def bucket(word: Column, buckets: int) -> Column:
    """The feature of a ``text_pipeline`` that a word counts for."""
    filled = F.rpad(word, (4 * F.ceil(F.length(word) / 4.0)).cast("int"), " ")
    return F.pmod(F.hash(filled), F.lit(buckets))


REGISTRY = (
    "model_name string, model_id string, created_at timestamp, "
    "example_count bigint, accuracy double, mae double, mse double, blessed boolean"
)


def text_pipeline(buckets: int = 1 << 18, iterations: int = 20, penalty: float = 0.005) -> Pipeline:
    """Which words occur, weighted by rarity, into a sparse logistic regression.

    Every word counts. Words are hashed into ``buckets`` features, the same number for any
    data, so no vocabulary is gathered; words of one bucket share a weight.
    """
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False),
            SQLTransformer(statement=f"SELECT *, transform(words, w -> {_FILLED}) AS filled FROM __THIS__"),
            HashingTF(inputCol="filled", outputCol="present", numFeatures=buckets, binary=True),
            IDF(inputCol="present", outputCol="features"),
            LogisticRegression(maxIter=iterations, regParam=penalty, elasticNetParam=1.0),
        ]
    )


def bucket_weights(model: PipelineModel) -> tuple[dict[str, float], float, int]:
    """What a fitted ``text_pipeline`` learned: the buckets that count, the intercept, how many buckets there are."""
    _, _, counter, rarity, regression = model.stages
    effect = regression.coefficients.toArray() * rarity.idf.toArray()
    weights = {str(i): float(effect[i]) for i in effect.nonzero()[0]}
    return weights, float(regression.intercept), counter.getNumFeatures()


def train_text_scorer(
    examples: DataFrame, build: Callable[[], Pipeline] = text_pipeline
) -> PipelineModel:
    """Fit on ``(text, label)``. The same pipeline then serves evaluation and scoring."""
    return build().fit(examples.withColumn("label", F.col("label").cast("double")))


def train_embedding_scorer(
    examples: DataFrame, width: int, classes: int, hidden: int = 32, iterations: int = 100, seed: int = 25
) -> PipelineModel:
    """Fit one hidden layer on ``embedding ARRAY<FLOAT>`` and ``label``; stops when it stalls."""
    network = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label", layers=[width, hidden, classes],
        maxIter=iterations, tol=1e-4, seed=seed,
    )
    return Pipeline(stages=[network]).fit(as_features(examples))


def as_features(examples: DataFrame, embedding: str = "embedding") -> DataFrame:
    vector = array_to_vector(F.col(embedding).cast("array<double>"))
    return examples.withColumn("features", vector).withColumn("label", F.col("label").cast("double"))


def score_probability(positive: int = 1) -> Column:
    return vector_to_array(F.col("probability"))[positive]


def evaluation_metrics(
    scored: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """One row over all examples: count, accuracy, mean absolute and mean squared error."""
    error = F.col(score) - F.col(label)
    right = (F.col(score) >= threshold) == (F.col(label) >= 0.5)
    return scored.agg(
        F.count(F.lit(1)).alias("example_count"),
        F.avg(right.cast("double")).alias("accuracy"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
    )


def latest_blessed(registry: DataFrame) -> DataFrame:
    """The most recent blessed model of each name; the larger id wins a tie."""
    newest = F.max(F.struct("created_at", "model_id", "accuracy")).alias("m")
    return (
        registry.where("blessed")
        .groupBy("model_name")
        .agg(newest)
        .select(
            "model_name",
            F.col("m.model_id").alias("model_id"),
            F.col("m.created_at").alias("created_at"),
            F.col("m.accuracy").alias("accuracy"),
        )
    )


def bless(candidates: DataFrame, registry: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Add ``baseline_accuracy`` and ``blessed``.

    ``measured`` (``model_name, accuracy``) is what the latest blessed models reach on the
    candidates' own examples; without it their stored accuracy is taken.

    Blessed is a candidate that is accurate enough and not worse than the latest blessed
    model of its name; the first of a name has nothing to be measured against.
    """
    known = latest_blessed(registry) if measured is None else measured
    baseline = known.select("model_name", F.col("accuracy").alias("baseline_accuracy"))
    # Side by side instead of joined: the name is often a constant, and a join on a constant
    # would become a cross join.
    both = candidates.withColumn("_candidate", F.lit(True)).unionByName(baseline, allowMissingColumns=True)
    measured = both.withColumn(
        "baseline_accuracy", F.max("baseline_accuracy").over(W.partitionBy("model_name"))
    )
    good = F.col("accuracy") >= LOWEST_ACCURACY
    kept = F.coalesce(F.col("accuracy") - F.col("baseline_accuracy") >= ALLOWED_CHANGE, F.lit(True))
    return measured.where("_candidate").withColumn("blessed", good & kept).drop("_candidate")


def publish(model: PipelineModel, blessed: DataFrame, serving_dir: str, registry_path: str) -> bool:
    """Record the decision, and save the model for serving if it was blessed.

    ``blessed`` is the one row of metrics that ``bless`` gave for this model.
    """
    columns = REGISTRY_COLUMNS
    row = blessed.select(*columns).first()
    if row["blessed"]:
        model.write().overwrite().save(f"{serving_dir}/{row['model_name']}/{row['model_id']}")
    recorded = blessed.sparkSession.createDataFrame([row], REGISTRY)
    recorded.write.mode("append").parquet(registry_path)
    return bool(row["blessed"])


REGISTRY_COLUMNS = [part.strip().split(" ")[0] for part in REGISTRY.split(",")]


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)


def load_latest(spark: SparkSession, registry_path: str, serving_dir: str, name: str) -> PipelineModel | None:
    """The model to serve now, if any was blessed."""
    newest = latest_blessed(load_registry(spark, registry_path)).where(F.col("model_name") == name).first()
    return None if newest is None else PipelineModel.load(f"{serving_dir}/{name}/{newest['model_id']}")
