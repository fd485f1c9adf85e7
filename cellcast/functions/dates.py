"""Dates and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS_PER_DAY = 86_400_000_000_000

# Month labels in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Months of the peak season; the others are off-peak.
PEAK_MONTHS = (5, 6, 7, 8, 9, 10, 11, 12)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_day(df: DataFrame, source: str, target: str = "date") -> DataFrame:
    """Calendar day of ``source``: nanoseconds since the epoch (long), or a date/timestamp.

    The long branch is pure arithmetic on UTC days, so the session zone cannot move it.
    """
    c = F.col(source)
    if dict(df.dtypes)[source] == "bigint":
        day = F.date_from_unix_date(
            F.round((c - F.pmod(c, F.lit(NANOS_PER_DAY))) / NANOS_PER_DAY).cast("int"))
    else:
        day = F.to_date(c)
    return df.withColumn(target, day)


def with_year_month(df: DataFrame, source: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(source), "month": F.month(source)})


def parse_ts(c: Column | str) -> Column:
    """Text to a zone-free timestamp, null where it does not parse."""
    return _col(c).try_cast("timestamp_ntz")


def epoch_seconds(c: Column | str) -> Column:
    """Seconds since the epoch of a date, for ordering."""
    return F.unix_date(_col(c)).cast("bigint") * 86_400


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))


def month_name(month: Column | str) -> Column:
    """1..12 to its label, null outside."""
    return F.try_element_at(F.array(*[F.lit(m) for m in MONTHS]),
                            F.when(_col(month) > 0, _col(month).cast("int")))


def month_index(year: Column | str, month: Column | str) -> Column:
    """Months since year 0: consecutive calendar months differ by one."""
    return _col(year) * 12 + _col(month) - 1


def season(month: Column | str, peak: tuple[int, ...] = PEAK_MONTHS) -> Column:
    return F.when(_col(month).isin(*peak), F.lit("peak")).otherwise(F.lit("offpeak"))
