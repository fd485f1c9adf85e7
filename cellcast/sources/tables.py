"""Text sources and dataset inspection."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.cleaning import null_below
from cellcast.functions.features import classify_phase


def read_csv_with_units(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """CSV with a header and a units line; every column is text.

    The units line carries a blank id, so it goes with the rows whose id is blank or missing.
    """
    df = spark.read.csv(path, header=True)
    return df.filter(~F.col(id_col).rlike(r"^\s*$"))


def read_index_csv(spark: SparkSession, path: str, sentinel: float = -999.0,
                   drop_missing: bool = False) -> DataFrame:
    """Monthly index from a two-column CSV, read by position: year, month, value, phase.

    Values below the sentinel become null (phase 0). ``drop_missing`` instead drops rows whose
    date does not parse or whose value is not above the sentinel.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True,
                         ignoreTrailingWhiteSpace=True)
    first, second = raw.columns[:2]
    named = raw.select(F.trim(F.col(first)).try_cast("date").alias("day"),
                       F.trim(F.col(second)).try_cast("double").alias("value"))
    if drop_missing:
        named = named.filter(F.col("day").isNotNull() & (F.col("value") > sentinel))
    value = null_below("value", sentinel)
    return named.select(F.year("day").alias("index_year"), F.month("day").alias("index_month"),
                        value.alias("driver"), classify_phase(value).alias("phase"))


def profile_datasets(spark: SparkSession, paths: dict[str, str], sample: int = 20) -> DataFrame:
    """One row per dataset: rows, column count, schema, a JSON sample; unreadable ones report why.

    Schemas come from the file footers; the row counts and samples are one lazy job per dataset,
    united in one DataFrame.
    """
    def failed(name: str, why: str) -> DataFrame:
        return spark.range(1).select(
            F.lit(name).alias("dataset"), F.lit(None).cast("bigint").alias("row_count"),
            F.lit(None).cast("int").alias("column_count"), F.lit(None).cast("string").alias("schema"),
            F.lit(None).cast("array<string>").alias("sample_rows"), F.lit(why).alias("error"))

    def profiled(name: str, path: str) -> DataFrame:
        try:
            df = spark.read.parquet(path)
        except PySparkException as problem:
            return failed(name, type(problem).__name__)
        preview = df.limit(sample).select(F.to_json(F.struct("*")).alias("j")).agg(
            F.collect_list("j").alias("sample_rows"))
        count = df.agg(F.count(F.lit(1)).alias("row_count"))
        return count.select(
            F.lit(name).alias("dataset"), "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(df.schema.simpleString()).alias("schema"),
            preview.scalar().alias("sample_rows"), F.lit(None).cast("string").alias("error"))

    return reduce(DataFrame.unionByName, [profiled(n, p) for n, p in paths.items()])


def count_rows_by_category(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """Rows per category and in total; the category is ``pattern``'s first group in the file path.

    No data column is read: counts come from the Parquet footers, one row group at a time.
    """
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    category = F.when(found == "", F.lit("other")).otherwise(found)
    return (spark.read.parquet(*paths).select(category.alias("category"))
            .rollup("category").agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.coalesce("category", F.lit("TOTAL")).alias("category"), "row_count"))
