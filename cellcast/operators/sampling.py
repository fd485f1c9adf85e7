"""Undersampling and temporal splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.features import SPLIT_YEARS
from cellcast.shared import value_of

# Negatives kept per positive, and the seed.
NEGATIVES_PER_POSITIVE = 20
SEED = 42


def undersample(df: DataFrame, key: Sequence[str] | Column, label: str = "label",
                ratio: float = NEGATIVES_PER_POSITIVE, seed: int = SEED,
                buckets: int = 1 << 53) -> DataFrame:
    """All positives and about ``ratio`` negatives per positive.

    The draw hashes the row's key, so the sample does not change with the partitioning and a retried
    task makes the same choice; it is a filter, nothing is shuffled. ``key`` is a list of columns
    that identify a row, whose 64-bit hash is used to the 53 bits a double holds, or an integer
    expression in [0, ``buckets``); then ``buckets`` is the finest step. The kept fraction is capped at 1.
    """
    if not isinstance(key, Column):
        key, buckets = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11), 1 << 53
    counts = value_of(df.agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
                             F.count(F.when(F.col(label) == 0, 1)).alias("neg")))
    fraction = F.least(F.lit(1.0), F.lit(float(ratio)) * counts.getField("pos")
                       / F.greatest(counts.getField("neg"), F.lit(1)))
    return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & (key < fraction * float(buckets))))


def strata_kept(df: DataFrame, sampled: DataFrame, by: Sequence[str],
                label: str = "label") -> DataFrame:
    """Negatives per stratum before and after sampling: one common fraction keeps the proportions."""
    def negatives(rows: DataFrame, out: str) -> DataFrame:
        return rows.filter(F.col(label) == 0).groupBy(*by).agg(F.count(F.lit(1)).alias(out))

    return negatives(df, "before").join(negatives(sampled, "after"), on=list(by), how="left").fillna(
        0, subset=["after"])


def temporal_split(df: DataFrame, bounds: tuple[int, int] = SPLIT_YEARS,
                   year: str = "year") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test by year, never at random; rows without a year are in none."""
    y = F.col(year)
    return (df.filter(y <= bounds[0]), df.filter(y.between(bounds[0] + 1, bounds[1])),
            df.filter(y > bounds[1]))
