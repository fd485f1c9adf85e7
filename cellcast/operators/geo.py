"""Points against polygons, as equi-joins on tiles of latitude and longitude.

Whether a tile's centre lies inside a polygon is found once per tile that has points, from the few places where
edges cross the centre's latitude. A tile that no edge reaches is inside or outside as a whole, so its points meet no
edge at all. In the others a point meets only the tile's own edges: it is inside if the centre is, and an
even number of them lies between, along a path through the tile. Candidates are folded at once into counters by the
partial aggregate above the join; pairs are never stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.shared import SMALL_ROWS, checkpointed, small

TILE = 0.5
# A tile's centre is a little off the middle, where no vertex of a grid lies.
_OFF = 0.5 + 0.0137
_EPS = 1e-9


def segment_distance(px: Column, py: Column, x1: Column, y1: Column,
                     x2: Column, y2: Column) -> Column:
    """Planar distance from (px, py) to the segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _at(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1


def border_edges(edges: DataFrame, reach: float = 0.0) -> DataFrame:
    """Each edge once per tile that it, widened by ``reach``, may touch: along the edge, not over its box."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    wide = reach + _EPS
    rows = edges.select("code", "poly_order", "x1", "y1", "x2", "y2", F.explode(F.sequence(
        F.floor((F.least(y1, y2) - wide) / TILE), F.floor((F.greatest(y1, y2) + wide) / TILE))).alias("_ty"))
    low = F.greatest(F.least(y1, y2), F.col("_ty") * TILE - wide)
    high = F.least(F.greatest(y1, y2), (F.col("_ty") + 1) * TILE + wide)
    flat = F.abs(y2 - y1) < _EPS
    left, right = _at(low, x1, y1, x2, y2), _at(high, x1, y1, x2, y2)
    least = F.when(flat, F.least(x1, x2)).otherwise(F.greatest(F.least(left, right), F.least(x1, x2)))
    most = F.when(flat, F.greatest(x1, x2)).otherwise(F.least(F.greatest(left, right), F.greatest(x1, x2)))
    return rows.select("*", F.explode(F.sequence(
        F.floor((least - wide) / TILE), F.floor((most + wide) / TILE))).alias("_tx"))


def inner_tiles(tiles: DataFrame, edges: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``(_ty, _tx, code, poly_order)`` of the tiles whose centre is inside the polygon."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = edges.select("code", "poly_order", "x1", "y1", "x2", "y2", F.explode(F.sequence(
        F.floor(F.least(y1, y2) / TILE), F.floor(F.greatest(y1, y2) / TILE))).alias("_ty"))
    line = (F.col("_ty") + _OFF) * TILE
    cuts = checkpointed(rows.where((y1 > line) != (y2 > line)).select(
        "_ty", "code", "poly_order", _at(line, x1, y1, x2, y2).alias("_cut")))
    beyond = tiles.join(small(cuts, max_rows), "_ty").where(F.col("_cut") > (F.col("_tx") + _OFF) * TILE)
    return beyond.groupBy("_ty", "_tx", "code", "poly_order").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") % 2 == 1).drop("_n")


def polygon_hits(points: DataFrame, edges: DataFrame, dist: float | None = None,
                 x: str = "lon", y: str = "lat", max_rows: int = SMALL_ROWS) -> DataFrame:
    """Distinct points paired with each polygon they hit: ``(x, y, code, poly_order)``.

    A hit is a point inside (even-odd rule over all closed rings, so holes are outside) or, with ``dist``,
    strictly closer than ``dist`` to the boundary. Each distinct coordinate is tested once.
    """
    reach = dist or 0.0
    coords = points.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna().distinct()
    coords = checkpointed(coords.select(x, y, F.floor(F.col(y) / TILE).alias("_ty"), F.floor(F.col(x) / TILE).alias("_tx")))
    tile = ["_ty", "_tx", "code", "poly_order"]
    inner = checkpointed(inner_tiles(coords.select("_ty", "_tx").distinct(), edges, max_rows))
    border = border_edges(edges, reach).join(
        small(inner.withColumn("_inside", F.lit(1)), max_rows), tile, "left")
    border = checkpointed(border.withColumn("_inside", F.coalesce("_inside", F.lit(0))))
    whole = inner.join(border.select(*tile).distinct(), tile, "left_anti")
    clear = coords.join(small(whole, max_rows), ["_ty", "_tx"]).select(x, y, "code", "poly_order")

    px, py, x1, y1, x2, y2 = (F.col(c) for c in (x, y, "x1", "y1", "x2", "y2"))
    cx, cy = (F.col("_tx") + _OFF) * TILE, (F.col("_ty") + _OFF) * TILE
    # From the point level to the centre's longitude, then along it to the centre.
    at = _at(py, x1, y1, x2, y2)
    level = ((y1 > py) != (y2 > py)) & ((px < at) != (cx < at))
    up = y1 + (y2 - y1) * (cx - x1) / F.nullif(x2 - x1, F.lit(0.0))
    along = ((x1 > cx) != (x2 > cx)) & ((up > py) != (up > cy))
    flips = F.coalesce(level, F.lit(False)).cast("int") + F.coalesce(along, F.lit(False)).cast("int")
    near = F.lit(False)
    if dist is not None:
        in_reach = (px.between(F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach)
                    & py.between(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach))
        near = in_reach & (segment_distance(px, py, x1, y1, x2, y2) < dist)
    met = coords.join(small(border, max_rows), ["_ty", "_tx"]).select(
        x, y, "code", "poly_order", "_inside", flips.alias("_flips"), near.alias("_near"))
    touched = met.groupBy(x, y, "code", "poly_order").agg(
        (F.sum("_flips") + F.max("_inside")).alias("_crossings"), F.max("_near").alias("_near"))
    return touched.filter((F.col("_crossings") % 2 == 1) | F.col("_near")).select(
        x, y, "code", "poly_order").unionByName(clear)


def match_polygons(points: DataFrame, edges: DataFrame, dist: float | None = 0.5,
                   x: str = "lon", y: str = "lat", max_rows: int = SMALL_ROWS) -> DataFrame:
    """``points`` with ``code`` and ``poly_order`` of the first polygon in file order they hit."""
    first = (polygon_hits(points, edges, dist, x, y, max_rows).groupBy(x, y)
             .agg(F.min(F.struct("poly_order", "code")).alias("_hit"))
             .select(x, y, F.col("_hit.code").alias("code"),
                     F.col("_hit.poly_order").alias("poly_order")))
    return points.join(first, on=[x, y], how="left")


def ocean_only(points: DataFrame, edges: DataFrame, x: str = "lon", y: str = "lat",
               max_rows: int = SMALL_ROWS) -> DataFrame:
    """Rows whose coordinate lies inside no polygon."""
    land = polygon_hits(points, edges, None, x, y, max_rows).select(x, y).distinct()
    return points.join(land, on=[x, y], how="left_anti").select(points.columns)


def flag_land(points: DataFrame, edges: DataFrame, x: str = "lon", y: str = "lat",
              max_rows: int = SMALL_ROWS) -> DataFrame:
    """``points`` with ``is_land``."""
    land = polygon_hits(points, edges, None, x, y, max_rows).select(x, y).distinct()
    return (points.join(land.withColumn("_land", F.lit(True)), on=[x, y], how="left")
            .select(*points.columns, F.coalesce("_land", F.lit(False)).alias("is_land")))


# Fixed value: the outcome of an event that reaches no polygon.
NO_OUTCOME = "None"


def first_hit(tracks: DataFrame, edges: DataFrame, id_col: str = "SID",
              order: Sequence[str] = ("ts",), dist: float = 0.5, x: str = "lon", y: str = "lat",
              max_rows: int = SMALL_ROWS) -> DataFrame:
    """Outcome per event: the polygon hit by its earliest hitting point, else ``"None"``.

    Tracks are first reduced to the earliest visit of each coordinate by each event, then one
    partial-aggregating ``min`` picks the hit; no track is sorted or held whole.
    """
    when = F.struct(*order)
    visits = tracks.groupBy(id_col, x, y).agg(F.min(when).alias("_when"))
    hits = match_polygons(visits, edges, dist, x, y, max_rows)
    best = F.min(F.when(F.col("code").isNotNull(), F.struct("_when", "poly_order", "code")))
    return hits.groupBy(id_col).agg(best.alias("_best")).select(
        id_col, F.coalesce("_best.code", F.lit(NO_OUTCOME)).alias("outcome"))
