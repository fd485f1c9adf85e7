"""Raw track points to event months, outcomes and the outcome matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.cleaning import clean_numeric
from cellcast.functions.dates import parse_ts, with_year_month
from cellcast.functions.grid import in_box, snap
from cellcast.operators.aggregates import (cell_visits, entity_months, outcome_crosstab, outcome_prior,
                                           smooth_transition)
from cellcast.operators.geo import first_hit
from cellcast.shared import checkpointed

# Fixed value: latitudes of the basin; its longitudes are not cut.
BASIN_LAT = (0.0, 30.0)


@dataclass(frozen=True)
class Tracks:
    """Cleaned points, months in which an event was active, its outcome, and outcome odds per cell."""

    points: DataFrame
    months: DataFrame
    outcomes: DataFrame
    transition: DataFrame


def clean_points(raw: DataFrame, id_col: str = "SID", ts: str = "ts", lat: str = "lat", lon: str = "lon",
                 box: tuple[float, float] = BASIN_LAT) -> DataFrame:
    """Points with an id, numeric coordinates (sentinels are missing) inside the basin, and a parsed time."""
    rows = raw.filter(F.trim(F.col(id_col)) != "").withColumns({
        ts: parse_ts(ts), lat: clean_numeric(lat), lon: clean_numeric(lon)})
    return in_box(rows.dropna(subset=[lat, lon]), box, None)


def prepare_tracks(raw: DataFrame, edges: DataFrame, id_col: str = "SID", ts: str = "ts", order: tuple[str, ...] = (),
                   dist: float = 0.5) -> Tracks:
    """The steps in one plan; the cleaned points are written once, everything else is aggregates over them."""
    points = checkpointed(clean_points(raw, id_col, ts))
    outcomes = checkpointed(first_hit(points, edges, id_col, (ts, *order), dist))
    cells = points.withColumns({"lat_grid": snap("lat", mode="even"), "lon_grid": snap("lon", mode="even")})
    visits = checkpointed(cell_visits(cells.join(outcomes, id_col)))
    return Tracks(points, entity_months(with_year_month(points, ts), id_col), outcomes,
                  smooth_transition(outcome_crosstab(visits), outcome_prior(visits)))
