"""Joins other than the polygon joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.catalog.scalars import r6
from cellcast.functions.dates import with_year_month
from cellcast.functions.grid import snap
from cellcast.operators import joins
from cellcast.operators.aggregates import daily_mean, entity_months, monthly_distinct

CELL_DAY = ["lat", "lon", "date"]


def snapped_points(t):
    """Track points on their cell and day."""
    return t.tracks.select(snap("lat").alias("lat"), snap("lon").alias("lon"),
                           F.to_date("ts").alias("date"), "SID", "pressure",
                           "l_orderkey", "l_linenumber")


POINTS = """points AS (SELECT ROUND(lat * 4) / 4 AS lat, ROUND(lon * 4) / 4 AS lon,
 CAST(ts AS DATE) AS date, SID, pressure, l_orderkey, l_linenumber FROM tracks)"""


@query("join_cell_day_left", views="obs_raw", oracle="""
SELECT a.lat, a.lon, a.date, ROUND(a.slp_avg, 6) AS slp_avg, ROUND(b.sst_avg, 6) AS sst_avg
FROM (SELECT lat, lon, date, AVG(slp) AS slp_avg FROM obs_raw GROUP BY 1, 2, 3) a
LEFT JOIN (SELECT lat, lon, date, AVG(sst) AS sst_avg FROM obs_raw WHERE l_linenumber > 2
 GROUP BY 1, 2, 3) b ON a.lat = b.lat AND a.lon = b.lon AND a.date = b.date""")
def _(t):
    air = daily_mean(t.obs_raw, CELL_DAY, {"slp": "slp_avg"})
    sea = daily_mean(t.obs_raw.filter("l_linenumber > 2"), CELL_DAY, {"sst": "sst_avg"})
    return joins.join_cell_day(air, sea).select(*CELL_DAY, r6("slp_avg"), r6("sst_avg"))


@query("join_month_index_left", views="obs_raw month_index", oracle="""
SELECT l_orderkey, l_linenumber, oni_value FROM obs_raw o LEFT JOIN month_index i
 ON i.oni_year = YEAR(o.date) AND i.oni_month = MONTH(o.date)""")
def _(t):
    obs = with_year_month(t.obs_raw.select("l_orderkey", "l_linenumber", "date"))
    return joins.join_month_index(obs, t.month_index, "oni_year", "oni_month").select(
        "l_orderkey", "l_linenumber", "oni_value")


@query("join_events_left", views="obs_raw tracks", oracle="WITH " + POINTS + """,
 cells AS (SELECT DISTINCT lat, lon, date FROM obs_raw)
SELECT 'fan' AS mode, c.lat, c.lon, c.date, p.SID, p.pressure FROM cells c LEFT JOIN points p
 ON p.lat = c.lat AND p.lon = c.lon AND p.date = c.date
UNION ALL
SELECT 'dedup', c.lat, c.lon, c.date, p.SID, p.pressure FROM cells c LEFT JOIN (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY lat, lon, date ORDER BY l_orderkey, l_linenumber) AS rn
 FROM points) p ON p.lat = c.lat AND p.lon = c.lon AND p.date = c.date AND p.rn = 1""")
def _(t):
    cells, points = t.obs_raw.select(*CELL_DAY).distinct(), snapped_points(t)
    cols = [*CELL_DAY, "SID", "pressure"]
    fan = joins.attach_events(cells, points.select(*cols)).select(F.lit("fan").alias("mode"), *cols)
    one = joins.attach_events(cells, points, dedup=True, order=["l_orderkey", "l_linenumber"])
    return fan.unionByName(one.select(F.lit("dedup").alias("mode"), *cols))


TRANSITION = """SELECT lat, lon, COUNT(*) % 7 / CAST(10.0 AS DOUBLE) AS prob_VN,
 COUNT(*) % 3 / CAST(10.0 AS DOUBLE) AS prob_PH FROM obs_raw WHERE sst > 25 AND lat < 12 GROUP BY lat, lon"""


@query("join_transition_broadcast", views="obs_raw scores", oracle=f"""
SELECT s.l_orderkey, s.l_linenumber, s.lat, s.lon, COALESCE(g.prob_VN, 0) AS prob_VN,
 COALESCE(g.prob_PH, 0) AS prob_PH
FROM scores s LEFT JOIN ({TRANSITION}) g ON g.lat = s.lat AND g.lon = s.lon""")
def _(t):
    grid = t.obs_raw.filter("sst > 25 AND lat < 12").groupBy("lat", "lon").agg(
        (F.count(F.lit(1)) % 7 / 10.0).alias("prob_VN"), (F.count(F.lit(1)) % 3 / 10.0).alias("prob_PH"))
    return joins.attach_transition(
        t.scores.select("l_orderkey", "l_linenumber", "lat", "lon"), grid)


@query("join_outcome_left", views="tracks", oracle="""
SELECT m.SID, m.year, m.month, o.outcome
FROM (SELECT DISTINCT SID, CAST(YEAR(ts) AS INTEGER) AS year, CAST(MONTH(ts) AS INTEGER) AS month
 FROM tracks) m
LEFT JOIN (SELECT SID, CASE WHEN MIN(lat) < 8 THEN 'VN' ELSE 'PH' END AS outcome FROM tracks
 WHERE lon < 100.1 GROUP BY SID) o ON o.SID = m.SID""")
def _(t):
    outcomes = t.tracks.filter("lon < 100.1").groupBy("SID").agg(
        F.when(F.min("lat") < 8, "VN").otherwise("PH").alias("outcome"))
    months = entity_months(with_year_month(t.tracks, "ts"))
    return joins.attach_outcome(months, outcomes)


@query("join_month_actuals", views="scores tracks month_index", oracle="""
SELECT i.year, i.month, ROUND(i.monthly_index, 6) AS monthly_index,
 COALESCE(a.actual_count, 0) AS actual_count, COALESCE(o.oni_value, 0) AS driver
FROM (SELECT year, month, SUM(prob) AS monthly_index FROM scores GROUP BY 1, 2) i
LEFT JOIN (SELECT YEAR(ts) AS year, MONTH(ts) AS month, COUNT(DISTINCT SID) AS actual_count
 FROM tracks GROUP BY 1, 2) a ON a.year = i.year AND a.month = i.month
LEFT JOIN month_index o ON o.oni_year = i.year AND o.oni_month = i.month""")
def _(t):
    index = t.scores.groupBy("year", "month").agg(F.sum("prob").alias("monthly_index"))
    actuals = monthly_distinct(with_year_month(t.tracks, "ts"))
    driver = t.month_index.select(F.col("oni_year").alias("year"), F.col("oni_month").alias("month"),
                                  F.col("oni_value").alias("driver"))
    return joins.join_actuals(index, actuals, driver).select(
        "year", "month", r6("monthly_index"), "actual_count", "driver")


@query("join_gap_safe_lag", views="monthly_x", oracle="""
SELECT m.year, m.month, COALESCE(p.driver, 0) AS driver_lag1,
 COALESCE(p.monthly_index, 0) AS monthly_index_lag1,
 COALESCE(CAST(p.actual_count AS DOUBLE), 0) AS actual_count_lag1
FROM monthly_x m LEFT JOIN monthly_x p ON p.year * 12 + p.month = m.year * 12 + m.month - 1""")
def _(t):
    cols = ["driver", "monthly_index", "actual_count"]
    return joins.calendar_lag(t.monthly_x, cols).select(
        "year", "month", *[f"{c}_lag1" for c in cols])


@query("join_expanding_folds", views="monthly", oracle="""
SELECT m.year, m.month, m.actual_count, CAST(f.fold AS INTEGER) AS fold,
 CASE WHEN m.year = f.fold THEN 'test' ELSE 'train' END AS role
FROM monthly m JOIN (SELECT DISTINCT year AS fold FROM monthly WHERE year > 1996 AND year <= 2000
 AND year > (SELECT MIN(year) FROM monthly)) f ON m.year <= f.fold""")
def _(t):
    return joins.expanding_folds(t.monthly.select("year", "month", "actual_count"), 1996, 2000)


@query("join_incomplete_anti", views="monthly", oracle="""
SELECT * FROM monthly WHERE year NOT IN (SELECT year FROM monthly GROUP BY year HAVING COUNT(*) < 8)
""")
def _(t):
    return joins.drop_incomplete_years(t.monthly, 8)
