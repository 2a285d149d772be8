"""Sliding windows per user and the moment a user becomes toxic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banterscope.config import PipelineConfig
from banterscope.functions.probability import TRANSITION_STEPS, is_toxic, sequential_score
from banterscope.operators.ordering import with_first_positions, with_previous


def user_window_scores(
    scores: DataFrame, cfg: PipelineConfig, panes: bool = False, sizes: bool = False
) -> DataFrame:
    """Mean score per user and sliding window.

    ``scores`` has ``(userid, event_time, score)``. The mean divides the sum of present
    scores by the number of all rows. Map-side partial aggregation means that a user with
    very many messages sends one row per task and window. ``panes`` first sums slides and
    then combines them, which pays where a user has many messages per slide.
    """
    if panes:
        partial = _pane_sums(scores, cfg)
    else:
        window = F.window(
            "event_time", f"{cfg.window_seconds} seconds", f"{cfg.slide_seconds} seconds"
        )
        partial = scores.groupBy("userid", window.alias("window")).agg(
            F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("messages")
        )
    mean = F.coalesce("_sum", F.lit(0.0)) / F.col("messages")
    columns = [
        F.col("userid"),
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        mean.alias("score"),
    ]
    return partial.select(*columns, *(["messages"] if sizes else []))


def _pane_sums(scores: DataFrame, cfg: PipelineConfig) -> DataFrame:
    slide = F.expr(f"INTERVAL {cfg.slide_seconds} SECONDS")
    length = F.expr(f"INTERVAL {cfg.window_seconds} SECONDS")
    pane_sums = scores.groupBy(
        "userid", F.window("event_time", f"{cfg.slide_seconds} seconds").alias("pane")
    ).agg(F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("_count"))
    back = F.explode(F.array(*[F.col("pane.start") - slide * i for i in range(cfg.panes_per_window)]))
    spread = pane_sums.select("userid", back.alias("start"), "_sum", "_count")
    window = F.struct(F.col("start"), (F.col("start") + length).alias("end"))
    return (
        spread.groupBy("userid", "start")
        .agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("messages"))
        .select("userid", window.alias("window"), "_sum", "messages")
    )


def toxic_flags(windows: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Windows in which a user becomes toxic: toxic now, and not in the window before.

    Only windows with messages count, so a silent gap does not clear a user. A user's
    windows are looked back over in slices of time, not as one group.
    """
    # Seconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike.
    seconds = F.unix_timestamp("window_start")
    slice_of = F.floor(seconds / F.lit(cfg.slice_seconds))
    toxic = is_toxic(F.col("score"), cfg.toxic_threshold)

    def rises(was_toxic: Column) -> Column:
        return toxic & ~F.coalesce(was_toxic, F.lit(False))

    seen = with_previous(windows, ["userid"], "window_start", slice_of, toxic, "_was_toxic", rises)
    return seen.where(rises(F.col("_was_toxic"))).drop("_was_toxic")


def flag_messages(flags: DataFrame) -> DataFrame:
    """The JSON alert, ``{userid, score}``, as a topic takes it."""
    return flags.select(
        F.col("userid").alias("key"), F.to_json(F.struct("userid", "score")).alias("value")
    )


def sequential_scores(
    scored: DataFrame, keys: list[str], order: str, slice_of: Column, score: str = "score"
) -> DataFrame:
    """Add ``position`` and ``sequential_score`` to a user's first comments.

    The n-th comment gets the sum of its own and the previous score, less the n-th step;
    the first has no previous one, which counts as 0. Comments beyond the last step have
    no sequential score and keep NULL. What the positions mean is our reading: the steps
    are given, who calls them is not. ``keys`` plus ``order`` identify a row, and
    ``slice_of`` cuts the order of one user into parts, see operators.ordering.
    """
    numbered = with_first_positions(
        scored, keys, order, slice_of, F.col(score), len(TRANSITION_STEPS), "position", "_previous"
    )
    before = F.when(F.col("position") == 1, F.lit(0.0)).otherwise(F.col("_previous"))
    found = sequential_score(F.col("position"), before, F.col(score))
    return numbered.withColumn("sequential_score", found).drop("_previous")
