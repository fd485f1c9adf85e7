"""Four sources to one row per cell and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cellcast.functions.cleaning import ensure_column
from cellcast.functions.dates import with_year_month
from cellcast.functions.grid import Box
from cellcast.operators.aggregates import daily_mean, snap_then_mean
from cellcast.operators.joins import attach_events, join_cell_day, join_month_index

CELL_DAY = ("lat", "lon", "date")
# Atmosphere measures, and the region of the grid.
AIR = ("u_wind", "v_wind", "slp", "wind_speed_env")
REGION_LAT, REGION_LON = (0.0, 30.0), (100.0, 180.0)


def build_master(air: DataFrame, surface: DataFrame | None, index: DataFrame, points: DataFrame,
                 lat: Box = REGION_LAT, lon: Box = REGION_LON,
                 dedup_order: Sequence[str] | None = None) -> DataFrame:
    """Daily atmosphere, daily surface, monthly index and event points on a common grid.

    One plan for all years: the two daily means shuffle on the same key, so their join adds no
    exchange, and the lookups are broadcast after a size check. ``points`` hold their cell and day.
    With ``dedup_order`` the first point per cell and day is kept; without it several points fan
    the row out. A missing surface source gives a null column.
    """
    days = daily_mean(air, CELL_DAY, {m: f"{m}_avg" for m in AIR})
    if surface is not None:
        days = join_cell_day(days, snap_then_mean(surface, {"sst": "sst_avg"}, lat, lon))
    days = ensure_column(days, "sst_avg")
    months = join_month_index(with_year_month(days), index)
    master = attach_events(months, points, CELL_DAY, dedup=dedup_order is not None,
                           order=dedup_order or ())
    extras = [c for c in master.columns if c not in days.columns and c not in ("year", "month")]
    return master.select(*CELL_DAY, "year", "month", *[f"{m}_avg" for m in AIR], "sst_avg", *extras)
