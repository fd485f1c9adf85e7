"""Gridded sources: dense array blocks and Hive-partitioned Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.shared import small, value_of

# Names under which the sources spell each coordinate and measure.
GRID_ALIASES = {
    "time": ("time", "valid_time"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "u_wind": ("u_wind", "u10"),
    "v_wind": ("v_wind", "v10"),
    "slp": ("slp", "msl"),
}
# Bookkeeping columns the gridded files may carry.
GRID_EXTRAS = ("number", "expver", "surface", "step")


def explode_grid(df: DataFrame, axes: Mapping[str, Column], values: Mapping[str, str],
                 keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell of dense array blocks.

    ``axes`` maps an output coordinate to its array column, slowest-varying first; ``values`` maps
    an output measure to the array column flattened in that order. One array is exploded with its
    positions and streams through the filter: cells where any measure or coordinate is null or NaN
    are dropped before anything else is kept of them, and no array of rows is built for a block. The
    other measures and the coordinates are looked up by position. A block whose measures differ in
    length raises. The block's other columns are limited to ``keep``.
    """
    sources = list(values.values())
    even = F.lit(True)
    for other in sources[1:]:
        even = even & (F.size(F.col(other)) == F.size(F.col(sources[0])))
    first = F.when(even, F.col(sources[0])).otherwise(
        F.raise_error(F.lit(f"arrays of different length among {', '.join(sources)}")))
    cells = df.select("*", F.posexplode(first).alias("_at", "_first"))
    measures = {out: (F.col("_first") if src == sources[0] else F.get(F.col(src), F.col("_at"))
                      ).cast("double") for out, src in values.items()}
    coordinates: dict[str, Column] = {}
    stride: Column = F.lit(1)
    for name in reversed(list(axes)):
        coordinates[name] = F.get(axes[name], (F.floor(F.col("_at") / stride)
                                               % F.size(axes[name])).cast("int"))
        stride = stride * F.size(axes[name])
    complete = F.lit(True)
    for column in measures.values():
        complete = complete & column.isNotNull() & ~F.isnan(column)
    for column in coordinates.values():
        complete = complete & column.isNotNull()
    return cells.filter(complete).select(
        *keep, *[coordinates[n].alias(n) for n in axes], *[c.alias(n) for n, c in measures.items()])


def harmonise(df: DataFrame, aliases: Mapping[str, Sequence[str]] = GRID_ALIASES,
              drop: Sequence[str] = GRID_EXTRAS) -> DataFrame:
    """First present alias of each target gets the target's name; listed extras are dropped."""
    renames = {}
    for target, names in aliases.items():
        found = next((n for n in names if n in df.columns), None)
        if found is not None and found != target:
            renames[found] = target
    return df.withColumnsRenamed(renames).drop(*[c for c in drop if c in df.columns])


def read_grid(spark: SparkSession, path: str, years: Sequence[int] | None = None,
              year_col: str = "year") -> DataFrame:
    """Parquet with partition discovery; ``years`` prunes to those directories."""
    df = spark.read.parquet(path)
    return df if years is None else df.filter(F.col(year_col).isin(*years))


# Fixed value: the year is the last dot- or underscore-separated token before the extension.
FILE_YEAR = r"[._=](\d{4})\.[A-Za-z][A-Za-z0-9]*(?:/[^/]*)?$"


def with_file_year(df: DataFrame, target: str = "file_year") -> DataFrame:
    """Year taken from the name of the file (or of the dataset folder) a row was read from."""
    found = F.regexp_extract(F.col("_metadata.file_path"), FILE_YEAR, 1)
    return df.withColumn(target, F.when(found != "", found.cast("int")))


def first_slice(df: DataFrame, ts: str, required: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """Rows at the earliest ``ts`` (of each ``by`` group), then those with ``required`` present."""
    if by:
        keyed = df.withColumn("_by", F.struct(*by))  # as a struct, a null group is kept too
        earliest = keyed.groupBy("_by").agg(F.min(ts).alias("_first"))
        hits = keyed.join(small(earliest), on="_by", how="inner").filter(
            F.col(ts) == F.col("_first")).select(df.columns)
    else:
        hits = df.filter(F.col(ts) == value_of(df.agg(F.min(ts).alias("first"))).getField("first"))
    return hits.dropna(subset=list(required))
