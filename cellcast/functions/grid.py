"""Grid alignment and small geometry on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def snap(c: Column | str, per_unit: float = 4.0, mode: str = "half_up") -> Column:
    """Nearest grid line with ``per_unit`` lines per unit.

    ``half_up`` moves ties away from zero, ``even`` moves them to the even line. The two disagree
    on every second cell centre, so sources that are joined must use the same mode.
    """
    scaled = _col(c).cast("double") * F.lit(float(per_unit))
    if mode == "half_up":
        nearest = F.round(scaled)
    elif mode == "even":
        nearest = F.rint(scaled)
    else:
        raise ValueError(f"unknown snap mode {mode!r}")
    return (nearest + 0.0) / F.lit(float(per_unit))


def in_box(df: DataFrame, lat: Box | None = (0.0, 30.0), lon: Box | None = None,
           lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows inside an inclusive box; rows with a null coordinate are dropped.

    With ``lon=None`` only the latitude is bounded (longitude must still be present). Plain column
    comparisons like these reach the Parquet scan.
    """
    kept = df.filter(F.col(lat_col).isNotNull() & F.col(lon_col).isNotNull())
    for name, bounds in ((lat_col, lat), (lon_col, lon)):
        if bounds is not None:
            kept = kept.filter(F.col(name).between(*bounds))
    return kept


def in_snapped_box(df: DataFrame, lat: Box | None, lon: Box | None, per_unit: float = 4.0,
                   lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows whose half-up snapped coordinate lies in the box, decided on the raw coordinate.

    The box holds the grid lines from the first at or above its lower bound to the last at or below
    its upper one; a raw value belongs to them up to half a cell beyond, and a tie goes away from
    zero. Being plain comparisons of raw columns with numbers, all of it can be pushed into the scan.
    """
    kept = df.filter(F.col(lat_col).isNotNull() & F.col(lon_col).isNotNull())
    for name, bounds in ((lat_col, lat), (lon_col, lon)):
        if bounds is not None:
            low = (math.ceil(bounds[0] * per_unit) - 0.5) / per_unit
            high = (math.floor(bounds[1] * per_unit) + 0.5) / per_unit
            c = F.col(name)
            kept = kept.filter((c >= low if low > 0 else c > low) & (c < high if high > 0 else c <= high))
    return kept


def wrap_lon(c: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_col(c).cast("double") + 180.0, F.lit(360.0)) - 180.0


def magnitude(u: Column | str, v: Column | str) -> Column:
    """Length of the vector (u, v)."""
    u, v = _col(u), _col(v)
    return F.sqrt(u * u + v * v)


# Fixed value: kilometres per hour in one knot, as used for the wind columns.
KNOT_KMH = 1.852


def convert_unit(c: Column | str, factor: float = KNOT_KMH, digits: int = 1) -> Column:
    """``c`` times ``factor``, rounded."""
    return F.round(_col(c) * F.lit(factor), digits)
