"""Training data: split, features, statistics, schema and validation.

Tables here are long, one row per feature or per feature value, so that nothing grows
into a single cell or travels through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banterscope.functions import text
from banterscope.operators.ordering import first_positions

# The seed and share of the random training sample.
SPLIT_SEED = 25
TRAIN_PERCENT = 80


def split_bucket(key: Column, seed: int = SPLIT_SEED, buckets: int = 100) -> Column:
    """A number below ``buckets`` that depends on nothing but the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def is_training(key: Column, percent: int = TRAIN_PERCENT, seed: int = SPLIT_SEED) -> Column:
    return split_bucket(key, seed) < percent


def train_test(examples: DataFrame, key: str, percent: int = TRAIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """A seeded sample and its complement. Stable under retries and repartitioning."""
    inside = is_training(F.col(key), percent)
    return examples.where(inside), examples.where(~inside)


def split_name(key: Column, shares: dict[str, int], seed: int = SPLIT_SEED) -> Column:
    """The part that a key falls into, by whole-number shares: ``{"train": 2, "eval": 1}`` is two to one.

    A key that is null has no part. Parts with a share of 0 get nothing.
    """
    if not shares or min(shares.values()) < 0 or not sum(shares.values()):
        raise ValueError(f"shares must be whole numbers from 0, not all 0: {shares}")
    bucket = split_bucket(key, seed, sum(shares.values()))
    return F.coalesce(*[F.when(bucket < end, F.lit(part)) for part, end in zip(shares, accumulate(shares.values()), strict=True)])


def truncate_comments(examples: DataFrame, comment: str = "comment_text") -> DataFrame:
    return examples.withColumn(comment, text.truncate(F.col(comment)))


def default_preprocessing(examples: DataFrame) -> DataFrame:
    """Lower-case the comment and give the two columns their model names."""
    return examples.withColumn("text", text.ascii_lower(F.col("comment_text"))).withColumnRenamed(
        "target", "label"
    ).drop("comment_text")


def preprocess(
    examples: DataFrame, preprocessing_fn: Callable[[DataFrame], DataFrame] = default_preprocessing
) -> DataFrame:
    return examples.transform(preprocessing_fn)


def attach_embeddings(
    examples: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    comment: str = "comment_text",
    batch: int = 100,
    into: str = "embedded_text",
) -> DataFrame:
    """Add a vector per comment; ``embed`` takes up to ``batch`` texts at a time.

    Comments are embedded whole; a caller whose embedder accepts less cuts them first. Only
    the comments go through Python. A NULL comment is not passed on and has no vector.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(comments: pd.Series) -> pd.Series:
        given = comments.dropna()
        found = [v for at in range(0, len(given), batch) for v in embed(given.iloc[at : at + batch].tolist())]
        return pd.Series(found, index=given.index, dtype=object).reindex(comments.index).map(
            lambda v: v if isinstance(v, list) else None
        )

    return examples.withColumn(into, vectors(F.col(comment)))


def _is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def feature_type(field: T.StructField) -> str:
    """INT, FLOAT, BYTES (text) or OTHER."""
    if _is_text(field):
        return "BYTES"
    if isinstance(field.dataType, T.IntegralType):
        return "INT"
    return "FLOAT" if _is_number(field) else "OTHER"


STATISTICS = (
    "feature string, type string, examples bigint, missing bigint, min double, max double, "
    "mean double, std double, zeros bigint, avg_length double"
)


def feature_statistics(examples: DataFrame) -> DataFrame:
    """One row per feature, from one pass over the data and one row of partial sums per task."""
    fields = examples.schema.fields

    def summary(field: T.StructField) -> Column:
        column = F.col(field.name)
        none = F.lit(None).cast("double")
        number = column.cast("double") if _is_number(field) else none
        return F.struct(
            F.lit(field.name).alias("feature"),
            F.lit(feature_type(field)).alias("type"),
            F.count(F.lit(1)).alias("examples"),
            F.count_if(column.isNull()).alias("missing"),
            (F.min(number) if _is_number(field) else none).alias("min"),
            (F.max(number) if _is_number(field) else none).alias("max"),
            (F.avg(number) if _is_number(field) else none).alias("mean"),
            (F.stddev_pop(number) if _is_number(field) else none).alias("std"),
            (F.count_if(column == 0) if _is_number(field) else F.lit(None).cast("bigint")).alias("zeros"),
            (F.avg(F.length(column)) if _is_text(field) else none).alias("avg_length"),
        )

    one_row = examples.agg(*[summary(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return one_row.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(fields))])))


def value_counts(examples: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``(feature, value, count)`` for the text features, in one shuffle.

    Counts are summed per task first, so a value that fills the data is one row per task.
    Values of any length come out as they are; leave features out that need no counts.
    """
    chosen = features or [f.name for f in examples.schema.fields if _is_text(f)]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in chosen])
    return (
        examples.select(F.inline_outer(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def dataset_statistics(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """Feature statistics plus, for text, the distinct values and the most frequent one.

    Among equally frequent values the smallest is named.
    """
    # The least of (-count, value): an ordinary partial aggregate, no join, no sort.
    peak = F.min(F.struct((-F.col("count")).alias("c"), "value"))
    text_features = (
        counts.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("distinct_values"), peak.alias("_peak"))
        .select(
            "feature",
            "distinct_values",
            (-F.col("_peak.c")).alias("top_count"),
            F.col("_peak.value").alias("top_value"),
        )
    )
    return stats.join(text_features, "feature", "left")


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per feature, with their rank."""
    descending = counts.withColumn("_order", -F.col("count"))
    return first_positions(descending, ["feature"], ["_order", "value"], k, "rank").drop("_order")


def quantiles(examples: DataFrame, points: int = 4, accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles of the number features, ``points + 1`` rows per feature.

    ``rank_error``: by how many places in the sorted feature a value may be off at most.
    """
    numbers = [f.name for f in examples.schema.fields if _is_number(f)]
    shares = [i / points for i in range(points + 1)]
    found = examples.agg(
        *[
            F.struct(
                F.percentile_approx(F.col(c).cast("double"), F.array(*map(F.lit, shares)), accuracy).alias("at"),
                (F.count(c) / accuracy).alias("rank_error"),
            ).alias(c)
            for c in numbers
        ]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["at"].alias("at"), F.col(c)["rank_error"].alias("rank_error")) for c in numbers])
    share = F.array(*map(F.lit, shares))
    return found.select(F.inline(rows)).select(
        "feature", "rank_error", F.inline(F.arrays_zip(share.alias("share"), F.col("at").alias("value")))
    )


def exact_quantiles(examples: DataFrame, points: int = 4, bins: int = 1000) -> DataFrame:
    """Quantiles of the number features as they are: ``feature, share, value``, ``points + 1`` rows per feature.

    The value at share ``i / points`` of ``n`` is the one in place ``ceil(i * n / points)`` of the sorted feature (the
    first for 0). Nulls don't count; NaN is the greatest value, and a feature without values has nulls. Numbers are
    compared as doubles.

    Each pass counts the values in ``bins`` equal parts of every range that still holds a wanted place, and the part
    with the place is the next range, from the least to the greatest value seen in it, until these are equal. So
    nothing is sorted, a value of a third of all rows is one row a task, and what reaches the driver depends on
    features, points and bins only. ``examples`` is read once a pass: pass a stored table.
    """
    numbers = [f.name for f in examples.schema.fields if _is_number(f)]
    out = "feature string, share double, value double"
    if not numbers:
        return examples.sparkSession.createDataFrame([], out)
    values = examples.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(numbers)])
    finite = [F.when(F.abs(v) < float("inf"), v) for v in map(F.col, values.columns)]
    ends = values.agg(F.array(*map(F.count, values.columns)).alias("n"), F.array(*map(F.min, finite)).alias("low"), F.array(*map(F.max, finite)).alias("high")).first()
    found = {(i, p): None for i in range(len(numbers)) for p in range(points + 1)}
    # Of every place that is wanted still: its range, and how many values of the range stand up to it.
    open_ = {(i, p): ((i, ends["low"][i], ends["high"][i], True), max(1, -(-p * ends["n"][i] // points))) for i, p in found if ends["n"][i]}
    while open_:
        ranges = list(dict.fromkeys(r for r, _ in open_.values()))
        cells = F.array(*[F.struct(F.lit(k).alias("at"), _part(F.col(f"v{r[0]}"), *r[1:], bins).alias("part"), F.col(f"v{r[0]}").alias("v")) for k, r in enumerate(ranges)])
        counted = values.select(F.inline(cells)).where("part is not null").groupBy("at", "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        parts: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda row: row["part"]):
            parts.setdefault(row["at"], []).append(row)
        later = {}
        for place, (own, up_to) in open_.items():
            for row in parts[ranges.index(own)]:
                if up_to <= row["n"]:
                    break
                up_to -= row["n"]
            if row["low"] == row["high"] or math.isnan(row["low"]):
                found[place] = row["low"]
            else:
                later[place] = ((own[0], row["low"], row["high"], False), up_to)
        open_ = later
    return examples.sparkSession.createDataFrame([(numbers[i], p / points, v) for (i, p), v in found.items()], out)


def _part(v: Column, low: float | None, high: float | None, whole: bool, bins: int) -> Column:
    """Which of the equal parts of a range a value is in, null outside; with ``whole``, infinities and NaN have parts of their own."""
    part = F.when(F.isnan(v), F.lit(bins + 2)).when(v == float("inf"), F.lit(bins + 1)).when(v == -float("inf"), F.lit(-1)) if whole else None
    if low is None:
        return part
    # Halves where the width would be no double. The greatest value is in the part after the last, so every range is cut.
    by = 0.5 if math.isinf(high - low) else 1.0
    width = high * by - low * by
    inside = F.floor((v * by - F.lit(low * by)) / F.lit(width) * bins).cast("int") if width else F.lit(0)
    held = v.between(low, high)
    return part.when(held, inside) if whole else F.when(held, inside)


def infer_schema(stats: DataFrame, counts: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """One row per feature: type, whether it is always there, and the size of its domain.

    ``domains`` names the features whose values are a domain, whatever their number; by
    default all text features.
    """
    sizes = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values"))
    return stats.join(sizes, "feature", "left").select(
        "feature",
        "type",
        (F.col("missing") == 0).alias("required"),
        (F.col("values") if domains is None else F.when(F.col("feature").isin(domains), F.col("values"))).alias("domain_size"),
    )


def infer_domains(counts: DataFrame, schema: DataFrame) -> DataFrame:
    """The values of the features that have a domain."""
    return _bounded(counts, schema).select("feature", "value")


def _bounded(counts: DataFrame, schema: DataFrame) -> DataFrame:
    limited = schema.where(F.col("domain_size").isNotNull()).select("feature")
    return counts.join(limited, "feature", "left_semi")


def import_schema(features: DataFrame) -> DataFrame:
    """A schema that was made elsewhere: checks that the columns are there and casts them."""
    wanted = {"feature": "string", "type": "string", "required": "boolean", "domain_size": "bigint"}
    missing = sorted(set(wanted) - set(features.columns))
    if missing:
        raise ValueError(f"schema table lacks {missing}")
    return features.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted.items()])


def validate_examples(stats: DataFrame, counts: DataFrame, schema: DataFrame, domains: DataFrame) -> DataFrame:
    """Anomalies against a schema: ``(feature, anomaly, detail, rows)``, empty if all is well.

    ``stats`` and ``counts`` describe the data that is checked.
    """
    seen = stats.select("feature", F.col("type").alias("seen"), "examples", "missing")
    both = schema.withColumn("_known", F.lit(True)).join(seen, "feature", "full_outer")
    nothing = F.lit(None).cast("string")
    rules = [
        ("missing_feature", F.col("seen").isNull(), nothing, F.lit(0).cast("bigint")),
        ("new_feature", F.col("_known").isNull(), F.col("seen"), F.col("examples")),
        ("type_change", F.col("type") != F.col("seen"), F.concat_ws(">", "type", "seen"), F.col("examples")),
        ("missing_values", F.col("required") & (F.col("missing") > 0), nothing, F.col("missing")),
    ]
    found = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("anomaly"),
                    detail.alias("detail"),
                    rows.alias("rows"),
                    F.coalesce(when, F.lit(False)).alias("hit"),
                )
                for name, when, detail, rows in rules
            ]
        ),
        lambda rule: rule["hit"],
    )
    structural = both.select("feature", F.inline(found)).drop("hit")

    outside = (
        _bounded(counts, schema)
        .join(domains, ["feature", "value"], "left_anti")
        .select(
            "feature",
            F.lit("value_outside_domain").alias("anomaly"),
            F.col("value").alias("detail"),
            F.col("count").alias("rows"),
        )
    )
    return structural.unionByName(outside)


def class_counts(examples: DataFrame, target: str = "target") -> DataFrame:
    return examples.groupBy(target).agg(F.count(F.lit(1)).alias("examples"))
