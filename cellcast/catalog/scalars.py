"""Projections, predicates, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.functions import cleaning, dates, features, grid
from cellcast.operators.aggregates import daily_mean, feature_means
from cellcast.operators.windows import trailing_means

KEY = ("l_orderkey", "l_linenumber")


def r6(c, name: str | None = None):
    """Rounded to six digits under its own or the given name."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


# Means of short decimals often lie exactly between two rounded values, where summation order would
# decide. Both engines add this offset first, so no such tie remains.
OFF_TIE = 1.23e-6


def r4(c, name: str | None = None):
    """Rounded to four digits, ties avoided."""
    out = F.round((F.col(c) if isinstance(c, str) else c) + F.lit(OFF_TIE), 4)
    return out.alias(name or c)


@query("fn_grid_snap", views="tracks", oracle="""
SELECT l_orderkey, l_linenumber, ROUND(lat * 4) / 4 AS lat_grid, ROUND(lon * 4) / 4 AS lon_grid,
 ROUND((lat + 0.125) * 4) / 4 AS tie_grid FROM tracks""")
def _(t):
    return t.tracks.select(*KEY, grid.snap("lat").alias("lat_grid"), grid.snap("lon").alias("lon_grid"),
                           grid.snap(F.col("lat") + 0.125).alias("tie_grid"))


@query("fn_grid_snap_even", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, ROUND_EVEN((lat + 0.125) * 4, 0) / 4 AS lat_grid,
 ROUND_EVEN((lon + 0.125) * 4, 0) / 4 AS lon_grid FROM obs_raw""")
def _(t):
    return t.obs_raw.select(*KEY, grid.snap(F.col("lat") + 0.125, mode="even").alias("lat_grid"),
                            grid.snap(F.col("lon") + 0.125, mode="even").alias("lon_grid"))


@query("fn_bbox_filter", views="tracks", oracle="""
SELECT 'box' AS kind, l_orderkey, l_linenumber, lat, lon FROM tracks
WHERE lat BETWEEN 5 AND 20 AND lon BETWEEN 100 AND 100.2
UNION ALL SELECT 'lat', l_orderkey, l_linenumber, lat, lon FROM tracks
WHERE lat BETWEEN 5 AND 20 AND lon IS NOT NULL""")
def _(t):
    def tagged(kind, df):
        return df.select(F.lit(kind).alias("kind"), *KEY, "lat", "lon")
    return tagged("box", grid.in_box(t.tracks, (5, 20), (100, 100.2))).unionByName(
        tagged("lat", grid.in_box(t.tracks, (5, 20))))


@query("fn_sentinel_numeric", views="dirty", oracle="""
SELECT event_id, CASE WHEN raw_value IN ('-999', '-9999', '', ' ') THEN NULL
 ELSE ROUND(CAST(raw_value AS DOUBLE), 6) END AS value FROM dirty""")
def _(t):
    return t.dirty.select("event_id", r6(cleaning.clean_numeric("raw_value"), "value"))


@query("fn_sentinel_below", views="dirty", oracle="""
SELECT event_id, CASE WHEN TRY_CAST(raw_value AS DOUBLE) < -999 THEN NULL
 ELSE ROUND(TRY_CAST(raw_value AS DOUBLE), 6) END AS value FROM dirty""")
def _(t):
    number = F.col("raw_value").try_cast("double")
    return t.dirty.select("event_id", r6(cleaning.null_below(number), "value"))


@query("fn_unit_convert", views="tracks", oracle="""
SELECT l_orderkey, l_linenumber, ROUND(wind_kts * CAST(1.852 AS DOUBLE), 1) AS wind_kmh FROM tracks""")
def _(t):
    return t.tracks.select(*KEY, grid.convert_unit("wind_kts").alias("wind_kmh"))


@query("fn_vector_magnitude", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, ROUND(SQRT(u_wind * u_wind + v_wind * v_wind), 6) AS wind_speed
FROM obs_raw""")
def _(t):
    return t.obs_raw.select(*KEY, r6(grid.magnitude("u_wind", "v_wind"), "wind_speed"))


@query("fn_phase_classify", views="month_index", oracle="""
SELECT oni_year, oni_month, oni_value, CAST(CASE WHEN oni_value >= 0.5 THEN 1
 WHEN oni_value <= -0.5 THEN 2 ELSE 0 END AS INTEGER) AS phase FROM month_index""")
def _(t):
    return t.month_index.withColumn("phase", features.classify_phase("oni_value"))


@query("fn_lon_normalise", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber,
 ROUND(x + 180 - FLOOR((x + 180) / 360) * 360 - 180, 6) AS lon
FROM (SELECT l_orderkey, l_linenumber, lon * 3 - 400 + u_wind * 50 AS x FROM obs_raw) u""")
def _(t):
    x = F.col("lon") * 3 - 400 + F.col("u_wind") * 50
    return t.obs_raw.select(*KEY, r6(grid.wrap_lon(x), "lon"))


@query("fn_date_parts", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, date, CAST(YEAR(date) AS INTEGER) AS year,
 CAST(MONTH(date) AS INTEGER) AS month FROM obs_raw""")
def _(t):
    return dates.with_year_month(t.obs_raw.select(*KEY, "date"))


@query("fn_timestamp_cast", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, CAST(TRY_CAST(text AS TIMESTAMP) AS DATE) AS day,
 CAST(CAST(date - DATE '1970-01-01' AS BIGINT) * 86400 AS BIGINT) AS seconds
FROM (SELECT l_orderkey, l_linenumber, date, CASE WHEN l_linenumber = 3 THEN 'not a date'
 ELSE CONCAT(CAST(date AS STRING), ' 06:00:00') END AS text FROM obs_raw) u""")
def _(t):
    text = F.when(F.col("l_linenumber") == 3, F.lit("not a date")).otherwise(
        F.concat(F.col("date").cast("string"), F.lit(" 06:00:00")))
    return t.obs_raw.select(*KEY, dates.parse_ts(text).cast("date").alias("day"),
                            dates.epoch_seconds("date").alias("seconds"))


@query("fn_month_start", views="monthly", oracle="""
SELECT year, month, MAKE_DATE(year, month, 1) AS month_start FROM monthly""")
def _(t):
    return t.monthly.select("year", "month", dates.month_start("year", "month").alias("month_start"))


@query("fn_month_name", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, STRFTIME(date, '%b') AS month_name FROM obs_raw""")
def _(t):
    return t.obs_raw.select(*KEY, dates.month_name(F.month("date")).alias("month_name"))


@query("fn_missing_source_null", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, sst, CAST(NULL AS DOUBLE) AS salinity FROM obs_raw""")
def _(t):
    df = cleaning.ensure_column(cleaning.ensure_column(t.obs_raw, "sst"), "salinity")
    return df.select(*KEY, "sst", "salinity")


@query("fn_event_label", views="obs_raw tracks", oracle="""
SELECT o.l_orderkey, o.l_linenumber, CAST(CASE WHEN t.SID IS NOT NULL THEN 1 ELSE 0 END AS INTEGER)
 AS is_event
FROM obs_raw o LEFT JOIN tracks t ON t.l_orderkey = o.l_orderkey AND t.l_linenumber = o.l_linenumber
""")
def _(t):
    joined = t.obs_raw.join(t.tracks.select(*KEY, "SID"), on=list(KEY), how="left")
    return joined.select(*KEY, features.presence("SID").alias("is_event"))


@query("fn_threshold_flag", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN sst >= 26.5 THEN 1 ELSE 0 END AS INTEGER) AS warm
FROM obs_raw""")
def _(t):
    return t.obs_raw.select(*KEY, features.flag_at_least("sst").alias("warm"))


@query("fn_anomaly_tendency", views="cell_day", oracle="""
SELECT lat, lon, date,
 ROUND(sst_avg - AVG(sst_avg) OVER (w ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) + 1.23e-6, 4)
 AS sst_anomaly,
 ROUND(slp_avg - AVG(slp_avg) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 1.23e-6, 4)
 AS slp_tendency
FROM cell_day WINDOW w AS (PARTITION BY lat, lon ORDER BY date)""")
def _(t):
    days = daily_mean(t.obs_raw, ["lat", "lon", "date"], {"sst": "sst_avg", "slp": "slp_avg"})
    trailing = trailing_means(days, ["lat", "lon"], ["date"],
                              {180: {"sst_avg": "sst_180d"}, 7: {"slp_avg": "slp_7d"}})
    return trailing.select("lat", "lon", "date",
                           r4(features.anomaly("sst_avg", "sst_180d"), "sst_anomaly"),
                           r4(features.anomaly("slp_avg", "slp_7d"), "slp_tendency"))


@query("fn_soft_threshold", views="scores", oracle="""
SELECT l_orderkey, l_linenumber, CASE WHEN prob > 0.1 THEN prob ELSE 0 END AS soft FROM scores""")
def _(t):
    return t.scores.select(*KEY, features.soft_threshold("prob").alias("soft"))


@query("fn_log1p", views="monthly_x", oracle="""
SELECT year, month, ROUND(LN(1 + monthly_index), 6) AS monthly_index_log,
 ROUND(LN(1 + GREATEST(index_PH, 0)), 6) AS index_PH_log FROM monthly_x""")
def _(t):
    return t.monthly_x.select("year", "month", r6(features.log_index("monthly_index"), "monthly_index_log"),
                              r6(features.log_index("index_PH"), "index_PH_log"))


@query("fn_interactions", views="monthly_x", oracle="""
SELECT year, month, w AS is_warm, c AS is_cold, ROUND(monthly_index * driver, 6) AS index_x_driver,
 monthly_index * w AS index_x_warm, monthly_index * c AS index_x_cold, ABS(driver) AS driver_abs
FROM (SELECT *, CAST(driver >= 0.5 AS DOUBLE) AS w, CAST(driver <= -0.5 AS DOUBLE) AS c
 FROM monthly_x) u""")
def _(t):
    df = features.phase_interactions(t.monthly_x.select("year", "month", "monthly_index", "driver"))
    return df.withColumn("index_x_driver", r6("index_x_driver")).drop("monthly_index", "driver")


@query("fn_cyclical_month", views="monthly_x", oracle="""
SELECT year, month, ROUND(SIN(2 * PI() * month / 12), 6) AS month_sin,
 ROUND(COS(2 * PI() * month / 12), 6) AS month_cos,
 ROUND(monthly_index * SIN(2 * PI() * month / 12), 6) + 0 AS index_x_month_sin,
 ROUND(monthly_index * COS(2 * PI() * month / 12), 6) + 0 AS index_x_month_cos FROM monthly_x""")
def _(t):
    df = features.cyclical(t.monthly_x.select("year", "month", "monthly_index"))
    return df.select("year", "month", *[
        (F.round(c, 6) + 0).alias(c)
        for c in ("month_sin", "month_cos", "index_x_month_sin", "index_x_month_cos")])


@query("fn_month_dummies", views="monthly_x", oracle="SELECT year, month, " + ", ".join(
    f"CAST(month = {m} AS DOUBLE) AS month_{m}, monthly_index * CAST(month = {m} AS DOUBLE) "
    f"AS index_x_month_{m}" for m in range(1, 13)) + " FROM monthly_x")
def _(t):
    return features.one_hot(t.monthly_x.select("year", "month", "monthly_index")).drop("monthly_index")


@query("fn_impute", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, ROUND(COALESCE(sst, (SELECT AVG(sst) FROM obs_raw
 WHERE YEAR(date) <= 1998)), 6) AS sst FROM obs_raw""")
def _(t):
    means = feature_means(t.obs_raw.filter(F.year("date") <= 1998), ["sst"])
    return cleaning.impute_with(t.obs_raw, means).select(*KEY, r6("sst"))


def ratio():
    """A measure with both infinities, NaN and nulls in it."""
    part = F.col("event_id") % 7
    return F.when(part == 0, F.lit(float("inf"))).when(part == 1, F.lit(float("-inf"))).when(
        part == 2, F.lit(float("nan"))).otherwise(F.col("raw_value").try_cast("double"))


@query("fn_sanitise", views="dirty", oracle="""
SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 0
 ELSE ROUND(COALESCE(TRY_CAST(raw_value AS DOUBLE), 0), 6) END AS ratio,
 CAST(0 AS BIGINT) AS inf_count, CAST(0 AS BIGINT) AS missing_count FROM dirty""")
def _(t):
    clean = cleaning.sanitise(t.dirty.select("event_id", ratio().alias("ratio")), ["ratio"])
    left = cleaning.value_of(cleaning.count_unclean(clean, ["ratio"]))
    return clean.select("event_id", r6("ratio"), left.getField("inf_count").alias("inf_count"),
                        left.getField("missing_count").alias("missing_count"))


@query("fn_coerce_numeric", views="dirty", oracle="""
SELECT event_id, ROUND(COALESCE(TRY_CAST(raw_value AS DOUBLE), 0), 6) AS raw_value FROM dirty""")
def _(t):
    return cleaning.coerce_numeric(t.dirty.select("event_id", "raw_value"), ["event_id", "raw_value"]
                                   ).withColumn("raw_value", r6("raw_value"))


@query("fn_clamp", views="dirty", oracle="""
SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 0
 ELSE ROUND(LEAST(GREATEST(COALESCE(TRY_CAST(raw_value AS DOUBLE), 0), 0), 200), 6) END AS clamped,
 CASE WHEN event_id % 7 < 3 THEN 0
 ELSE ROUND(GREATEST(COALESCE(TRY_CAST(raw_value AS DOUBLE), 0), 0), 6) END AS floored FROM dirty""")
def _(t):
    return t.dirty.select("event_id", r6(cleaning.clamp(ratio()), "clamped"),
                          r6(cleaning.clamp(ratio(), hi=None), "floored"))


@query("fn_split_label", views="scores", oracle="""
SELECT l_orderkey, l_linenumber, CASE WHEN year <= 1998 THEN 'Train'
 WHEN year BETWEEN 1999 AND 1999 THEN 'Val' ELSE 'Test' END AS split FROM scores""")
def _(t):
    return t.scores.select(*KEY, features.split_label("year", (1998, 1999)).alias("split"))


@query("fn_season_split", views="monthly", oracle="""
SELECT year, month, CASE WHEN month >= 5 THEN 'peak' ELSE 'offpeak' END AS season FROM monthly""")
def _(t):
    return t.monthly.select("year", "month", dates.season("month").alias("season"))


ROUTES = {"total": ["monthly_index", "driver"], "target": ["{index}", "driver"]}


@query("fn_feature_select", views="monthly_x", oracle="""
SELECT 'count' AS target, year, month, monthly_index AS index_value, driver FROM monthly_x
UNION ALL SELECT 'VN', year, month, index_VN, driver FROM monthly_x
UNION ALL SELECT 'PH', year, month, index_PH, driver FROM monthly_x""")
def _(t):
    def routed(target):
        names = features.route_features(ROUTES, target)
        df = features.select_features(t.monthly_x, ["year", "month"], names, ["driver", "month"])
        return df.withColumnsRenamed({names[0]: "index_value"}).withColumn("target", F.lit(target))
    return routed("count").unionByName(routed("VN")).unionByName(routed("PH"))


@query("fn_residual", views="monthly", oracle="""
SELECT year, month, pred_count - actual_count AS residual, actual_count - pred_count AS error
FROM monthly""")
def _(t):
    return t.monthly.select("year", "month",
                            features.residual("pred_count", "actual_count").alias("residual"),
                            features.annual_error("actual_count", "pred_count").alias("error"))
