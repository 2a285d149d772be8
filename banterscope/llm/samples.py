"""Folds and bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Up to so many labels, their shares are constants of the plan; beyond, a join.
FEW_LABELS = 500


def fold(key: str, parts: int) -> Column:
    """The fold of a row: the CRC-32 of its key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def sample_per_label(rows: DataFrame, label: str, key: str, each: int) -> DataFrame:
    """About ``each`` rows of every label, chosen by a hash of the key: the same ones in every run.

    Labels are counted with partial sums, so a label of a third of all rows needs no task of its own. What
    comes back has ``each`` rows a label in expectation and at most twice that in practice.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_count"))
    chance = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = counts.limit(FEW_LABELS + 1).collect()
    if not few:
        return rows.limit(0)
    if len(few) <= FEW_LABELS:  # the same rows as below, without moving any
        shares = F.create_map(*(F.lit(x) for r in few for x in (r[0], float(each) / r[1])))
        return rows.where(chance < shares[F.col(label)])
    return rows.join(counts, label).where(chance < F.lit(float(each)) / F.col("_count")).drop("_count")
