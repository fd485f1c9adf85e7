"""Helpers shared by the operators: small lookups, one-row values, the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound under which a lookup may be broadcast (rows are a handful of numbers wide).
SMALL_ROWS = 200_000


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` hinted for broadcast when it has at most ``max_rows`` rows, else ``df`` unhinted.

    The check is one bounded count (``limit`` stops each partition early). Beyond the bound the
    join is left to Spark: sort-merge with adaptive skew splitting.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def value_of(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct column: an uncorrelated scalar subquery.

    Used for global aggregates (means, priors, totals), so no join and no driver round trip is
    written into the plan.
    """
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row")).scalar()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temp folder in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="cellcast-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cellcast-{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
