"""Ordering, top-k, previews, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.operators.windows import numbered


def order_months(df: DataFrame) -> DataFrame:
    return df.orderBy("year", "month")


def order_track(df: DataFrame, id_col: str = "SID", order: Sequence[str] = ("ts",),
                block: Column | None = None, out: str = "point_no") -> DataFrame:
    """Chronological position of each point within its event.

    With ``block`` (a non-decreasing coarse function of the order, e.g. the day) an event with very
    many points is numbered by several tasks.
    """
    if block is not None:
        return numbered(df, [id_col], order, block, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))


def top_k(df: DataFrame, col: str, k: int = 10, tie: Sequence[str] = ("name",)) -> DataFrame:
    """The ``k`` largest by ``col``, ties by name: per-partition heaps, no global sort."""
    return df.orderBy(F.desc(col), *tie).limit(k)


def preview(df: DataFrame, predicate: Column, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``order`` that satisfy ``predicate``."""
    return df.filter(predicate).orderBy(*order).limit(n)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return a.unionByName(b)


def distinct_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
