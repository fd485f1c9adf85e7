"""Writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_grid(df: DataFrame, path: str, mode: str = "overwrite",
               partition_by: Sequence[str] = ()) -> None:
    """Parquet; with ``partition_by`` an overwrite replaces only the partitions present in ``df``.

    Partitioned writes are rebalanced on the partition columns first: few files per directory, and
    Spark splits a partition that holds far more rows than the others.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a finished write (its success marker is readable)."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(
            f"{path.rstrip('/')}/_SUCCESS").schema
    except AnalysisException:
        return False
    return True


def materialise(spark: SparkSession, build: Callable[[], DataFrame], path: str,
                rebuild: bool = False) -> DataFrame:
    """The table at ``path``, built and written first if it is absent, unfinished or ``rebuild``.

    Reading the written table back cuts the lineage, so a lost executor re-reads files instead of
    recomputing the windows.
    """
    if rebuild or not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str, keys: Sequence[str] = ("year", "month"),
                      actual: str = "actual_count", after: int | None = None, year: str = "year") -> None:
    """Keys, the actual and every ``pred_*`` column present, as CSV with a header; with ``after`` only rows of
    later years, those that no model has seen."""
    df = df if after is None else df.filter(F.col(year) > after)
    preds = [c for c in df.columns if c.startswith("pred_")]
    df.select(*keys, actual, *preds).write.mode("overwrite").option("header", True).csv(path)


def save_artifacts(path: str, tables: Mapping[str, DataFrame] | None = None, **models) -> None:
    """Spark ML models by name, and tables (imputation means, knots, coefficients) as Parquet."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    for name, table in (tables or {}).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_artifacts(spark: SparkSession, path: str, tables: Sequence[str] = ("means",),
                   **kinds: type[MLReadable]) -> dict:
    """Reload what ``save_artifacts`` wrote; ``kinds`` maps each model's name to its class."""
    missing = [n for n in (*kinds, *tables) if not _complete(
        spark, f"{path}/{n}" if n in tables else f"{path}/{n}/metadata")]
    if missing:
        raise FileNotFoundError(f"no saved {', '.join(missing)} under {path}; fit and save first")
    loaded = {n: kind.load(f"{path}/{n}") for n, kind in kinds.items()}
    return loaded | {n: spark.read.parquet(f"{path}/{n}") for n in tables}
