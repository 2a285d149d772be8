"""Look-back over ordered groups of any size.

A plain ``lag`` over ``partitionBy(key)`` puts a whole group into one task. Here a group
is cut into slices of its order, each slice is a task's worth, and only the first and the
last row of every slice meet again in a second pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    slice_of: Column,
    value: Column,
    into: str,
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``into``: ``value`` of the previous row of the group, NULL for its first row.

    ``slice_of`` must not fall as ``order`` rises; ``order`` is never NULL, and ``keys``
    plus ``order`` identify a row. The input is read once. The first pass works within
    slices. The second one brings together only the two edge rows of each slice of a
    group; the other rows keep what the first pass found and stay spread by slice.

    ``wanted`` takes the previous value and tells which rows the caller needs. It is
    applied to rows inside a slice before the second pass; edge rows always go on, so the
    caller applies it once more to the result.
    """
    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    rows = (
        df.withColumn("_slice", slice_of)
        .withColumn("_value", F.struct(value.alias("v")))
        .withColumn("_inside", F.lag("_value").over(inside))
        .withColumn("_is_last", F.lead(order).over(inside).isNull())
    )
    is_first = F.col("_inside").isNull()
    is_edge = is_first | F.col("_is_last")
    if wanted is not None:
        rows = rows.where(is_edge | F.coalesce(wanted(F.col("_inside.v")), F.lit(False)))
    # Edge rows share the NULL place of their group; all others stay with their slice.
    placed = rows.withColumn("_place", F.when(~is_edge, F.col("_slice")))
    across = W.partitionBy(*keys, "_place").orderBy(order)
    found = F.when(is_first, F.col("_across")).otherwise(F.col("_inside"))
    return (
        placed.withColumn("_across", F.lag("_value").over(across))
        .withColumn(into, found["v"])
        .drop("_slice", "_value", "_inside", "_is_last", "_place", "_across")
    )


def with_first_positions(
    df: DataFrame,
    keys: list[str],
    order: str,
    slice_of: Column,
    value: Column,
    count: int,
    position: str,
    previous: str,
) -> DataFrame:
    """Number the first ``count`` rows of each group and give them the ``value`` before.

    All rows stay; the later ones have NULL in both columns. The same conditions and the
    same two passes as in ``with_previous``: only the first ``count`` rows of a slice can
    be among the first of the group, so only they come together in the second pass.
    """
    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    rows = (
        df.withColumn("_slice", slice_of)
        .withColumn("_value", value)
        .withColumn("_within", F.row_number().over(inside))
    )
    is_candidate = F.col("_within") <= count
    across = W.partitionBy(*keys, "_place").orderBy(order)
    placed = (
        rows.withColumn("_place", F.when(~is_candidate, F.col("_slice")))
        .withColumn("_position", F.row_number().over(across))
        .withColumn("_before", F.lag("_value").over(across))
    )
    is_first = is_candidate & (F.col("_position") <= count)
    return (
        placed.withColumn(position, F.when(is_first, F.col("_position")))
        .withColumn(previous, F.when(is_first, F.col("_before")))
        .drop("_slice", "_value", "_within", "_place", "_position", "_before")
    )


def first_positions(df: DataFrame, keys: list[str], order: list[str], count: int, into: str) -> DataFrame:
    """The first ``count`` rows of each group with their position.

    Spark keeps at most ``count`` rows per group and task before the shuffle, so a large
    group does not travel.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(into, place).where(F.col(into) <= count)
