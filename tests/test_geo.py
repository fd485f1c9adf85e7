import math
import random

import pytest
from pyspark.sql import functions as F

from cellcast.catalog.views import EDGE_SCHEMA, POLYGONS, Tables, edge_rows
from cellcast.operators import geo


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def away(rings, x, y):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            dx, dy = x2 - x1, y2 - y1
            s = min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x - x1 - s * dx, y - y1 - s * dy))
    return best


def first(x, y, dist=0.5):
    return next((c for c, rings in POLYGONS if inside(rings, x, y) or away(rings, x, y) < dist), None)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


@pytest.mark.parametrize("max_rows", [10_000, 0])
def test_match_against_brute_force(spark, edges, max_rows):
    rng = random.Random(2)
    points = [(rng.uniform(5, 30), rng.uniform(102, 143)) for _ in range(400)]
    points += [(15.0, 109.49), (15.0, 109.51), (15.0, 109.0), (28.7, 134.5), (20.5, 108.5), (0.0, 0.0)]
    df = spark.createDataFrame(points + points[:5] + [(None, 1.0)], "lat double, lon double")
    rows = geo.match_polygons(df, edges, 0.5, max_rows=max_rows).collect()
    assert len(rows) == len(points) + 6
    for r in rows:
        want = None if r.lat is None else first(r.lon, r.lat)
        assert r.code == want, (r.lat, r.lon)
    by = {(r.lat, r.lon): r.code for r in rows}
    assert by[15.0, 109.49] == "VN" and by[15.0, 109.51] is None
    assert by[28.7, 134.5] is None and by[20.5, 108.5] == "VN"


def test_land_mask_keeps_missing_and_rest(spark, edges):
    df = spark.createDataFrame([(15.0, 105.0, 1), (15.0, 105.0, 2), (28.7, 134.5, 3), (None, 3.0, 4)],
                               "lat double, lon double, i int")
    assert sorted(r.i for r in geo.ocean_only(df, edges).collect()) == [3, 4]
    assert {r.i: r.is_land for r in geo.flag_land(df, edges).collect()} == {1: True, 2: True, 3: False, 4: False}


# Outcomes per id over the polygon fixture, by scale.
OUTCOMES = {
    "sf0.001": {"None": 93, "PH": 10, "CN": 10, "VN": 7, "JP": 4, "TW": 1},
    "sf0.01": {"None": 934, "PH": 102, "CN": 84, "VN": 65, "JP": 45, "TW": 20},
}


@pytest.mark.parametrize("scale", list(OUTCOMES))
def test_first_hit_counts(spark, edges, scale):
    t = Tables(spark, f"/root/testdata/{scale}")
    got = geo.first_hit(t.geo_tracks, edges, order=["ts", "event_id"]).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == OUTCOMES[scale]


def test_first_hit_is_the_earliest(spark, edges):
    rows = [("A", 2, 15.0, 105.0), ("A", 1, 10.0, 120.0), ("A", 3, 25.0, 115.0), ("B", 1, 0.0, 150.0)]
    df = spark.createDataFrame(rows, "SID string, ts int, lat double, lon double")
    assert {r.SID: r.outcome for r in geo.first_hit(df, edges).collect()} == {"A": "PH", "B": "None"}


def test_tiles_of_a_long_boundary(spark):
    """Ten thousand edges: the same hits as edge by edge, and a tenth of the pairs that bands of latitude make."""
    n, rng = 10_000, random.Random(4)
    ring = [((20 + math.sin(k / 40)) * math.cos(2 * math.pi * k / n), (20 + math.sin(k / 40)) * math.sin(
        2 * math.pi * k / n)) for k in range(n)]
    hole = [(-3.0, -3.0), (-3.0, 3.0), (3.0, 3.0), (3.0, -3.0), (-3.0, -3.0)]
    rings = [ring + ring[:1], hole]
    flat = [("A", 1, 0, r, e, *map(float, (*ring[e], *ring[e + 1])))
            for r, ring in enumerate(rings) for e in range(len(ring) - 1)]
    edges = spark.createDataFrame(flat, EDGE_SCHEMA)
    points = [(rng.uniform(-22, 22), rng.uniform(-22, 22)) for _ in range(250)] + [
        (a * 0.5, b * 0.5) for a in (-7, -6, 0, 5, 6, 41) for b in (-6, 0, 6, 40)]
    df = spark.createDataFrame(points, "lon double, lat double")
    for dist in (None, 0.3):
        got = {(r.lon, r.lat) for r in geo.polygon_hits(df, edges, dist).collect()}
        assert got == {p for p in set(points) if inside(rings, *p) or (dist and away(rings, *p) < dist)}
    tiles = df.select(F.floor(F.col("lat") / geo.TILE).alias("_ty"), F.floor(F.col("lon") / geo.TILE).alias("_tx"))
    met = tiles.join(geo.border_edges(edges, 0.3), ["_ty", "_tx"]).count()
    banded = sum(math.floor((min(f[6], f[8]) - 0.3) / 0.5) <= math.floor(p[1] / 0.5) <= math.floor(
        (max(f[6], f[8]) + 0.3) / 0.5) for p in points for f in flat)
    assert 10 * met < banded


def test_no_nested_loop_join(spark, edges):
    df = spark.createDataFrame([(1.0, 1.0)], "lat double, lon double")
    for max_rows in (10_000, 0):
        hits = geo.polygon_hits(df, edges, 0.5, max_rows=max_rows)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_degenerate_edge(spark):
    point = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    zero = F.lit(0.0)
    d = point.select(geo.segment_distance(F.col("x"), F.col("y"), zero, zero, zero, zero).alias("d"))
    assert d.first().d == 5.0
