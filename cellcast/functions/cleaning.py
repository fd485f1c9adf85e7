"""Missing markers, non-finite numbers, imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.shared import value_of

# Exact strings that mean "missing" in the track files.
TRACK_SENTINELS = ("-999", "-9999", "", " ")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_numeric(c: Column | str, sentinels: Sequence[str] = TRACK_SENTINELS,
                  to: str = "double") -> Column:
    """Text to number; exact sentinel strings and unparseable text become null."""
    c = _col(c)
    return F.when(~c.isin(*sentinels), c.try_cast(to))


def null_below(c: Column | str, bound: float = -999.0) -> Column:
    """Values strictly below ``bound`` become null; the bound itself is kept."""
    c = _col(c)
    return F.when(c >= bound, c)


def finite(c: Column | str) -> Column:
    """NaN and both infinities become null."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sanitise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinite, NaN and null entries of ``cols`` become 0.0."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in cols})


def count_unclean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: infinite and missing (null or NaN) entries over all of ``cols``."""
    def total(flag):
        return sum((F.count(F.when(flag(F.col(c).cast("double")), 1)) for c in cols), F.lit(0))

    return df.agg(
        total(lambda c: F.abs(c) == float("inf")).cast("bigint").alias("inf_count"),
        total(lambda c: c.isNull() | F.isnan(c)).cast("bigint").alias("missing_count"),
    )


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns that are not numeric become double, unparseable entries 0.0."""
    kinds = dict(df.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    text = [c for c in cols if kinds[c] not in numeric and not kinds[c].startswith("decimal")]
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in text})


# Fixed value: no predicted monthly count may exceed this.
COUNT_CEILING = 200.0


def clamp(c: Column | str, lo: float | None = 0.0, hi: float | None = COUNT_CEILING) -> Column:
    """Non-finite and null become 0, then the value is limited to [lo, hi]."""
    out = F.coalesce(finite(c), F.lit(0.0))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return out


def impute_with(df: DataFrame, means: DataFrame | Mapping[str, float],
                cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls and NaN of each column become that column's entry in ``means``.

    ``means`` is a one-row DataFrame (train-split means) or a mapping. Columns are promoted to
    double first: filling an integer column in place would truncate the mean.
    """
    if isinstance(means, DataFrame):
        cols = list(cols or means.columns)
        row = value_of(means)
        fill = {c: row.getField(c) for c in cols}
    else:
        cols = list(cols or means)
        fill = {c: F.lit(float(means[c])) for c in cols}
    return df.withColumns(
        {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), fill[c]) for c in cols})


def ensure_column(df: DataFrame, name: str, kind: str = "double") -> DataFrame:
    """``df`` with a typed null column where the source that supplies it is absent."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
