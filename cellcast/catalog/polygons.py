"""Polygon joins and the outcome matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.catalog.scalars import r6
from cellcast.functions.grid import snap
from cellcast.operators import geo
from cellcast.operators.aggregates import (MATRIX_OUTCOMES, cell_visits, outcome_counts,
                                           outcome_crosstab, outcome_prior, smooth_transition)
from cellcast.shared import checkpointed

# Brute force in SQL: every point against every edge.
PAIRS = """pairs AS (
 SELECT g.event_id, e.poly_order, MIN(e.code) AS code,
  SUM(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
   THEN 1 ELSE 0 END) % 2 = 1 AS inside,
  MIN(SQRT(POW(lon - (x1 + s * (x2 - x1)), 2) + POW(lat - (y1 + s * (y2 - y1)), 2))) AS dist
 FROM geo_tracks g, (SELECT *, POW(x2 - x1, 2) + POW(y2 - y1, 2) AS len2 FROM edges) e,
  LATERAL (SELECT GREATEST(0, LEAST(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / len2)) AS s) p
 GROUP BY g.event_id, e.poly_order)"""
HITS = PAIRS + """,
hits AS (SELECT event_id, MIN(poly_order) AS poly_order, ARG_MIN(code, poly_order) AS code FROM pairs
 WHERE inside OR dist < 0.5 GROUP BY event_id)"""
OUTCOME = HITS + """,
outcomes AS (SELECT g.SID, COALESCE(ARG_MIN(h.code, (g.ts, g.event_id)) FILTER (h.code IS NOT NULL),
 'None') AS outcome FROM geo_tracks g LEFT JOIN hits h ON h.event_id = g.event_id GROUP BY g.SID)"""
VISITS = OUTCOME + """,
visits AS (SELECT DISTINCT g.SID, ROUND_EVEN(lat * 4, 0) / 4 AS lat_grid,
 ROUND_EVEN(lon * 4, 0) / 4 AS lon_grid, outcome FROM geo_tracks g JOIN outcomes o ON o.SID = g.SID)"""
_COUNTS = ", ".join(f"COUNT(CASE WHEN outcome = '{o}' THEN 1 END) AS \"{o}\"" for o in MATRIX_OUTCOMES)


@query("join_point_polygon_distance", views="geo_tracks edges", oracle=f"""
WITH {HITS} SELECT g.event_id, h.code, h.poly_order FROM geo_tracks g LEFT JOIN hits h
 ON h.event_id = g.event_id""")
def _(t):
    return geo.match_polygons(t.geo_tracks, t.edges, 0.5).select("event_id", "code", "poly_order")


@query("join_land_anti", views="geo_tracks edges", oracle=f"""
WITH {PAIRS} SELECT event_id, lat, lon, event_id IN (SELECT event_id FROM pairs WHERE inside) AS is_land,
 event_id NOT IN (SELECT event_id FROM pairs WHERE inside) AS kept FROM geo_tracks""")
def _(t):
    flagged = geo.flag_land(t.geo_tracks, t.edges).select("event_id", "lat", "lon", "is_land")
    ocean = geo.ocean_only(t.geo_tracks, t.edges).select("event_id", F.lit(True).alias("kept"))
    return flagged.join(ocean, on="event_id", how="left").fillna(False, subset=["kept"])


def outcomes_of(t):
    return geo.first_hit(t.geo_tracks, t.edges, order=["ts", "event_id"])


def visits_of(t):
    cells = t.geo_tracks.withColumns({"lat_grid": snap("lat", mode="even"),
                                      "lon_grid": snap("lon", mode="even")})
    return cell_visits(cells.join(outcomes_of(t), on="SID"))


@query("win_first_hit", views="geo_tracks edges",
       oracle=f"WITH {OUTCOME} SELECT SID, outcome FROM outcomes")
def _(t):
    return outcomes_of(t)


@query("agg_outcome_counts", views="geo_tracks edges",
       oracle=f"WITH {OUTCOME} SELECT outcome, COUNT(*) AS events FROM outcomes GROUP BY outcome")
def _(t):
    return outcome_counts(outcomes_of(t))


@query("agg_cell_outcome_crosstab", views="geo_tracks edges",
       oracle=f"WITH {VISITS} SELECT lat_grid, lon_grid, {_COUNTS} FROM visits GROUP BY 1, 2")
def _(t):
    return outcome_crosstab(visits_of(t))


@query("agg_outcome_prior", views="geo_tracks edges", oracle=f"WITH {VISITS} SELECT " + ", ".join(
    f"ROUND(COUNT(CASE WHEN outcome = '{o}' THEN 1 END) / COUNT(outcome), 6) AS \"{o}\""
    for o in MATRIX_OUTCOMES) + " FROM visits")
def _(t):
    prior = outcome_prior(visits_of(t))
    return prior.select(*[r6(c) for c in prior.columns])


@query("agg_laplace_smooth", views="geo_tracks edges", oracle=f"""
WITH {VISITS}, total AS (SELECT COUNT(outcome) AS n, {_COUNTS.replace('AS "', 'AS "all_')} FROM visits)
SELECT lat_grid, lon_grid, """ + ", ".join(
    f"ROUND((COUNT(CASE WHEN outcome = '{o}' THEN 1 END) + 5 * MAX(\"all_{o}\") / MAX(n)) "
    f"/ (COUNT(*) + 5), 6) AS \"prob_{o}\"" for o in MATRIX_OUTCOMES) + """
FROM visits, total GROUP BY 1, 2""")
def _(t):
    visits = checkpointed(visits_of(t))
    smooth = smooth_transition(outcome_crosstab(visits), outcome_prior(visits))
    return smooth.select("lat_grid", "lon_grid", *[
        r6(c) for c in smooth.columns if c.startswith("prob_")])
