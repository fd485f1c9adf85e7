"""Joins.

Lookups are broadcast only through ``small``, which counts them first. Fact-to-fact joins are plain
equi-joins on pre-aggregated sides, so a key meets at most one row of the aggregated side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.dates import month_index
from cellcast.shared import SMALL_ROWS, checkpointed, small, value_of

CELL_DAY = ("lat", "lon", "date")
# Points of one cell and day that meet their cell in one task.
CROWD = 10_000


def join_cell_day(left: DataFrame, right: DataFrame, on: Sequence[str] = CELL_DAY) -> DataFrame:
    """Left equi-join on cell and day; both sides are expected to hold one row per key."""
    return left.join(right, on=list(on), how="left")


def join_month_index(df: DataFrame, index: DataFrame, year: str = "index_year",
                     month: str = "index_month") -> DataFrame:
    """Left join of a monthly index on year and month; the index's own keys are dropped."""
    renamed = index.withColumnsRenamed({year: "year", month: "month"})
    return df.join(small(renamed), on=["year", "month"], how="left")


def attach_events(df: DataFrame, tracks: DataFrame, on: Sequence[str] = CELL_DAY,
                  dedup: bool = False, order: Sequence[str] = (),
                  max_rows: int = SMALL_ROWS, crowd: int = CROWD) -> DataFrame:
    """Track points attached to their cell and day; cells without one keep nulls.

    Several points of one cell-day fan the row out. ``dedup`` keeps only the first point by
    ``order`` (all point columns when empty).

    The points are computed once. Few are broadcast. Many are joined on key and salt: a cell-day with more than
    ``crowd`` points deals them over salts and meets them with a copy of its row per salt (an outer join cannot be
    split by adaptive skew handling), all others have one salt. ``df`` is read once either way.
    """
    on = list(on)
    extra = [c for c in tracks.columns if c not in on]
    points = tracks.select(*on, *extra)
    if dedup:
        by = F.struct(*(order or extra))
        points = points.groupBy(*on).agg(
            F.min_by(F.struct(*extra), by).alias("_p")).select(*on, "_p.*")
    points = checkpointed(points)
    columns = df.columns + extra
    if dedup or points.limit(max_rows + 1).count() <= max_rows:
        return df.join(small(points, max_rows), on=on, how="left").select(columns)
    crowded = checkpointed(points.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > crowd).select(*on, F.ceil(F.col("_n") / crowd).cast("int").alias("_salts")))
    if not crowded.limit(1).count():
        return df.join(points, on=on, how="left").select(columns)
    known = F.coalesce("_salts", F.lit(1))
    dealt = F.pmod(F.xxhash64(*points.columns, F.monotonically_increasing_id()), known).cast("int")
    salted = points.join(small(crowded, max_rows), on=on, how="left").select(
        *points.columns, dealt.alias("_salt"), F.lit(True).alias("_met"))
    rows = df.join(small(crowded, max_rows), on=on, how="left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), known - 1)))
    # A salt that got no point of a crowded key has no row of its own.
    return rows.join(salted, on=[*on, "_salt"], how="left").filter(
        F.col("_salts").isNull() | F.col("_met")).select(columns)


def attach_transition(df: DataFrame, grid: DataFrame, on: Sequence[str] = ("lat", "lon"),
                      prefix: str = "prob_") -> DataFrame:
    """Left join of per-cell outcome probabilities; a cell without any gets 0 for every outcome."""
    on = list(on)
    cells = grid.select(*[F.col(c).cast("double").alias(c) for c in on],
                        *[c for c in grid.columns if c not in on])
    outcomes = [c for c in grid.columns if c.startswith(prefix)]
    return df.join(small(cells), on=on, how="left").fillna(0.0, subset=outcomes)


def attach_outcome(events: DataFrame, outcomes: DataFrame, id_col: str = "SID") -> DataFrame:
    """Outcome of each event; an event without one keeps null and counts for no target."""
    return events.join(small(checkpointed(outcomes)), on=id_col, how="left")


def join_actuals(index: DataFrame, actuals: DataFrame, driver: DataFrame | None = None,
                 keys: Sequence[str] = ("year", "month"),
                 driver_col: str = "driver") -> DataFrame:
    """Actual counts (missing month: 0), then the monthly driver (missing: 0.0)."""
    keys = list(keys)
    counts = [c for c in actuals.columns if c not in keys]
    out = index.join(small(actuals), on=keys, how="left").fillna(0, subset=counts)
    if driver is not None:
        out = out.join(small(driver), on=keys, how="left").fillna(0.0, subset=[driver_col])
    return out


def calendar_lag(df: DataFrame, cols: Sequence[str], months: int = 1, suffix: str = "_lag1",
                 year: str = "year", month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Values of the calendar month ``months`` earlier; 0.0 where that month is absent.

    A join on the month number, so a gap in the calendar is never bridged by the previous row.
    """
    number = month_index(year, month)
    earlier = df.select(*by, (number + months).alias("_month"),
                        *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    out = df.withColumn("_month", number).join(earlier, on=[*by, "_month"], how="left")
    return out.select(*df.columns, *[
        F.coalesce(F.col(f"{c}{suffix}").cast("double"), F.lit(0.0)).alias(f"{c}{suffix}")
        for c in cols])


def expanding_folds(df: DataFrame, start: int, end: int, year: str = "year") -> DataFrame:
    """Rows repeated per fold year f in (start, end]: ``train`` where year < f, ``test`` at f.

    The folds of a row are computed from its own year (a generated sequence, no theta join); folds
    that lack a side are dropped by a lookup of at most ``end - start`` rows.
    """
    y = F.col(year)
    first_train = F.greatest(y + 1, F.lit(start + 1))
    as_train = F.when(first_train <= end, F.sequence(first_train, F.lit(end)))
    as_test = F.when((y > start) & (y <= end), F.array(y))
    folds = df.withColumn("fold", F.explode(F.concat(
        F.coalesce(as_test, F.array().cast("array<int>")),
        F.coalesce(as_train, F.array().cast("array<int>")))))
    folds = folds.withColumn("role", F.when(y == F.col("fold"), "test").otherwise("train"))
    years = df.filter((y > start) & (y <= end)).select(y.alias("fold")).distinct()
    oldest = value_of(df.agg(F.min(year).alias("y"))).getField("y")
    usable = years.filter(F.col("fold") > oldest)
    return folds.join(F.broadcast(usable), on="fold", how="left_semi").select(
        *df.columns, "fold", "role")


def drop_incomplete_years(df: DataFrame, min_months: int = 6, year: str = "year") -> DataFrame:
    """Rows of years with at least ``min_months`` months."""
    short = df.groupBy(year).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") < min_months).select(year)
    return df.join(small(short), on=year, how="left_anti").select(df.columns)
