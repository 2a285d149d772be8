"""Score arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scored attributes and the steps of the sequential score.
ATTRIBUTES = ("IDENTITY_ATTACK", "INSULT", "SEXUALLY_EXPLICIT")
TRANSITION_STEPS = (0.90, 0.93, 0.95, 0.97, 0.99)

# Sums of doubles depend on the order of addition in the last digit; a mean that equals
# the threshold up to this much counts as reaching it, whatever the order was.
SUM_ORDER_SLACK = 1e-12


def conflate(probabilities: list[Column]) -> Column:
    """Joint probability of independent opinions; NULL where they contradict (0 and 1)."""
    yes = reduce(mul, probabilities)
    no = reduce(mul, [1 - p for p in probabilities])
    return F.try_divide(yes, yes + no)


def detail_map(probabilities: list[Column]) -> Column:
    pairs = [part for name, p in zip(ATTRIBUTES, probabilities) for part in (F.lit(name), p)]
    return F.create_map(*pairs)


def score_payload(probabilities: list[Column]) -> Column:
    return F.struct(
        conflate(probabilities).alias("score"),
        detail_map(probabilities).alias("detail"),
    )


def attribute_probabilities(response: Column) -> list[Column]:
    """The three probabilities of an attribute response (VARIANT).

    All are 0 where the response is an object without ``attributeScores``; a single
    missing attribute, or no response at all, gives NULL, which leads to the fallback.
    """
    scored = F.variant_get(response, "$.attributeScores", "variant").isNotNull()
    is_object = F.try_variant_get(response, "$", "map<string,variant>").isNotNull()
    return [
        F.when(scored, F.try_variant_get(response, f"$.attributeScores.{name}.summaryScore.value", "double"))
        .when(is_object, F.lit(0.0))
        for name in ATTRIBUTES
    ]


def sequential_score(position: Column, previous: Column, current: Column) -> Column:
    """``previous + current`` less the step of the position; NULL beyond the last step."""
    steps = F.array(*[F.lit(step) for step in TRANSITION_STEPS])
    return F.when(position >= 1, previous + current - F.try_element_at(steps, position.cast("int")))


def is_toxic(score: Column, threshold: float) -> Column:
    """At or above the threshold."""
    return score >= F.lit(threshold - SUM_ORDER_SLACK)
