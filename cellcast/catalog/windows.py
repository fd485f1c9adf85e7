"""Windows, ordering, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.joins import snapped_points
from cellcast.catalog.registry import query
from cellcast.catalog.scalars import OFF_TIE, r4, r6
from cellcast.operators import ordering
from cellcast.operators.aggregates import daily_mean, latest_year as latest_year_of
from cellcast.operators.evaluate import average_precision, roc_auc
from cellcast.operators.joins import attach_events, calendar_lag
from cellcast.operators.windows import (TRAILING, diff_in_group, momentum, trailing_in_group,
                                        trailing_means, ytd_before)

CELL_DAY = ["lat", "lon", "date"]
_OUTS = [(n, src, out) for n, m in TRAILING.items() for src, out in m.items()]


def cell_days(t):
    """Daily cell means of every trailing measure."""
    obs = t.obs_raw.withColumn("wind_speed_env", F.sqrt(
        F.col("u_wind") * F.col("u_wind") + F.col("v_wind") * F.col("v_wind")))
    return daily_mean(obs, CELL_DAY, {"sst": "sst_avg", "slp": "slp_avg",
                                      "wind_speed_env": "wind_speed_env_avg"})


def trailing_sql(frame: str) -> str:
    return "SELECT lat, lon, date, " + ", ".join(
        f"ROUND(AVG({src}) OVER (w {frame.format(n=n - 1)}) + {OFF_TIE}, 4) AS {out}" for n, src, out in _OUTS
    ) + " FROM cell_day WINDOW w AS (PARTITION BY lat, lon ORDER BY date)"


@query("win_trailing_mean", views="cell_day",
       oracle=trailing_sql("ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"))
def _(t):
    return trailing_means(cell_days(t), ["lat", "lon"], ["date"]).select(
        *CELL_DAY, *[r4(out) for _, _, out in _OUTS])


@query("win_trailing_mean_days", views="cell_day",
       oracle=trailing_sql("RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND CURRENT ROW"))
def _(t):
    return trailing_means(cell_days(t), ["lat", "lon"], ["date"], frame="days").select(
        *CELL_DAY, *[r4(out) for _, _, out in _OUTS])


@query("win_trailing_mean_fanout", views="cell_day tracks", oracle="""
WITH points AS (SELECT ROUND(lat * 4) / 4 AS lat, ROUND(lon * 4) / 4 AS lon, CAST(ts AS DATE) AS date,
 l_orderkey, l_linenumber FROM tracks)
SELECT c.lat, c.lon, c.date, p.l_orderkey, p.l_linenumber,
 ROUND(AVG(c.slp_avg) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) + 1.23e-6, 4) AS slp_30d_avg
FROM cell_day c LEFT JOIN points p ON p.lat = c.lat AND p.lon = c.lon AND p.date = c.date
WINDOW w AS (PARTITION BY c.lat, c.lon ORDER BY c.date, p.l_orderkey, p.l_linenumber)""")
def _(t):
    """Rows multiplied by several points of one cell-day count separately; long histories are cut."""
    points = snapped_points(t).drop("SID", "pressure")
    rows = attach_events(daily_mean(t.obs_raw, CELL_DAY, {"slp": "slp_avg"}), points)
    means = trailing_means(rows, ["lat", "lon"], ["date", "l_orderkey", "l_linenumber"],
                           {30: {"slp_avg": "slp_30d_avg"}}, chunk_rows=256)
    return means.select(*CELL_DAY, "l_orderkey", "l_linenumber", r4("slp_30d_avg"))


@query("win_trailing_3_in_year", views="monthly_x", oracle="""
SELECT year, month,
 ROUND(AVG(driver) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS driver_3m_avg,
 ROUND(AVG(monthly_index) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS monthly_index_3m_avg
FROM monthly_x WINDOW w AS (PARTITION BY year ORDER BY month)""")
def _(t):
    return trailing_in_group(t.monthly_x, ["driver", "monthly_index"]).select(
        "year", "month", r6("driver_3m_avg"), r6("monthly_index_3m_avg"))


@query("win_cumulative_exclusive", views="monthly", oracle="""
SELECT year, month, CAST(COALESCE(SUM(actual_count) OVER (PARTITION BY year ORDER BY month
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS cumulative_ytd FROM monthly""")
def _(t):
    return ytd_before(t.monthly).select("year", "month", "cumulative_ytd")


@query("win_diff_in_year", views="monthly_x", oracle="""
SELECT year, month, ROUND(COALESCE(driver - LAG(driver) OVER (PARTITION BY year ORDER BY month), 0), 6)
 AS driver_momentum FROM monthly_x""")
def _(t):
    return diff_in_group(t.monthly_x).select("year", "month", r6("driver_momentum"))


@query("win_momentum", views="monthly_x", oracle="""
SELECT m.year, m.month, m.monthly_index - COALESCE(p.monthly_index, 0) AS index_momentum
FROM monthly_x m LEFT JOIN monthly_x p ON p.year * 12 + p.month = m.year * 12 + m.month - 1""")
def _(t):
    return momentum(calendar_lag(t.monthly_x, ["monthly_index"])).select(
        "year", "month", "index_momentum")


@query("win_rank_auc", views="scores", oracle="""
SELECT ROUND((SUM(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (p * n), 9) AS roc_auc
FROM (SELECT label, RANK() OVER (ORDER BY prob) + (COUNT(*) OVER (PARTITION BY prob) - 1)
 / CAST(2.0 AS DOUBLE) AS r FROM scores) u,
 (SELECT CAST(SUM(label) AS DOUBLE) AS p, CAST(SUM(1 - label) AS DOUBLE) AS n FROM scores) c
GROUP BY p, n""")
def _(t):
    return roc_auc(t.scores).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("win_average_precision", views="scores", oracle="""
SELECT ROUND(SUM(pos * tp / (tp + fp)) / SUM(pos), 9) AS auprc FROM (
 SELECT pos, CAST(SUM(pos) OVER w AS DOUBLE) AS tp, CAST(SUM(neg) OVER w AS DOUBLE) AS fp
 FROM (SELECT prob, SUM(label) AS pos, SUM(1 - label) AS neg FROM scores GROUP BY prob) d
 WINDOW w AS (ORDER BY prob DESC)) u""")
def _(t):
    return average_precision(t.scores).select(F.round("auprc", 9).alias("auprc"))


@query("sort_year_month", views="monthly", oracle="SELECT * FROM monthly ORDER BY year, month")
def _(t):
    return ordering.order_months(t.monthly)


@query("sort_track", views="geo_tracks", oracle="""
SELECT SID, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY SID ORDER BY ts, event_id) AS INTEGER)
 AS point_no FROM geo_tracks""")
def _(t):
    return ordering.order_track(t.geo_tracks, order=["ts", "event_id"], block=F.to_date("ts")).select(
        "SID", "event_id", F.col("point_no").cast("int").alias("point_no"))


@query("sort_track_blocked", views="tracks", oracle="""
SELECT SID, l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY SID
 ORDER BY CAST(ts AS DATE), l_orderkey, l_linenumber) AS point_no FROM tracks""")
def _(t):
    """The same numbering with each event cut by year, for events with very many points."""
    rows = t.tracks.withColumn("day", F.to_date("ts"))
    return ordering.order_track(rows, order=["day", "l_orderkey", "l_linenumber"],
                                block=F.year("day")).select("SID", "l_orderkey", "l_linenumber",
                                                            "point_no")


@query("topk_importance", views="obs_raw", oracle="""
SELECT CAST(cell_id AS STRING) AS name, ROUND(SUM(slp), 2) AS gain FROM obs_raw GROUP BY cell_id
ORDER BY gain DESC, name LIMIT 10""")
def _(t):
    gains = t.obs_raw.groupBy(F.col("cell_id").cast("string").alias("name")).agg(
        F.round(F.sum("slp"), 2).alias("gain"))
    return ordering.top_k(gains, "gain", 10)


@query("limit_sample", views="obs_raw tracks", oracle="""
WITH joined AS (SELECT o.l_orderkey, o.l_linenumber, o.sst, t.SID FROM obs_raw o LEFT JOIN tracks t
 ON t.l_orderkey = o.l_orderkey AND t.l_linenumber = o.l_linenumber)
SELECT * FROM (SELECT 'with' AS kind, * FROM joined WHERE SID IS NOT NULL
 ORDER BY l_orderkey, l_linenumber LIMIT 10) a
UNION ALL SELECT * FROM (SELECT 'without', * FROM joined WHERE SID IS NULL
 ORDER BY l_orderkey, l_linenumber LIMIT 5) b
UNION ALL SELECT * FROM (SELECT 'sst', * FROM joined WHERE sst IS NOT NULL
 ORDER BY l_orderkey, l_linenumber LIMIT 5) c""")
def _(t):
    key = ["l_orderkey", "l_linenumber"]
    joined = t.obs_raw.select(*key, "sst").join(t.tracks.select(*key, "SID"), on=key, how="left")

    def tagged(kind, predicate, n):
        return ordering.preview(joined, predicate, n, key).withColumn("kind", F.lit(kind))
    return tagged("with", F.col("SID").isNotNull(), 10).unionByName(
        tagged("without", F.col("SID").isNull(), 5)).unionByName(
        tagged("sst", F.col("sst").isNotNull(), 5))


@query("latest_year_breakdown", views="monthly", oracle="""
SELECT year, month, CAST(SUM(actual_count) AS BIGINT) AS actual_count, SUM(pred_count) AS pred_count
FROM monthly WHERE year = (SELECT MAX(year) FROM monthly) GROUP BY year, month
UNION ALL SELECT MAX(year), NULL, CAST(SUM(actual_count) AS BIGINT), SUM(pred_count) FROM monthly
WHERE year = (SELECT MAX(year) FROM monthly)""")
def _(t):
    return latest_year_of(t.monthly)


@query("set_union_by_name", views="scores", oracle="""
SELECT l_orderkey, l_linenumber, prob, label FROM scores WHERE label = 1
UNION ALL SELECT l_orderkey, l_linenumber, prob, label FROM scores WHERE label = 0""")
def _(t):
    s = t.scores.select("l_orderkey", "l_linenumber", "prob", "label")
    other = s.filter("label = 0").select("label", "prob", "l_linenumber", "l_orderkey")
    return ordering.union_all(s.filter("label = 1"), other)


@query("set_distinct", views="obs_raw tracks", oracle="""
SELECT 'cell' AS kind, CAST(lat AS STRING) || '/' || CAST(lon AS STRING) AS item
FROM (SELECT DISTINCT lat, lon FROM obs_raw) a
UNION ALL SELECT 'id', SID FROM (SELECT DISTINCT SID FROM tracks) b""")
def _(t):
    cells = ordering.distinct_of(t.obs_raw, ["lat", "lon"]).select(
        F.lit("cell").alias("kind"),
        F.concat_ws("/", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("item"))
    return cells.unionByName(ordering.distinct_of(t.tracks, ["SID"]).select(
        F.lit("id").alias("kind"), F.col("SID").alias("item")))
