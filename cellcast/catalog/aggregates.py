"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.catalog.scalars import r6
from cellcast.functions.dates import with_year_month
from cellcast.functions.features import classify_phase, split_label
from cellcast.operators import aggregates as agg
from cellcast.operators.joins import attach_outcome, attach_transition, join_month_index


@query("agg_cell_day_mean", views="obs_raw", oracle="""
SELECT lat, lon, date, ROUND(AVG(u_wind), 6) AS u_wind_avg, ROUND(AVG(v_wind), 6) AS v_wind_avg,
 ROUND(AVG(slp), 6) AS slp_avg, ROUND(AVG(sst), 6) AS sst_avg FROM obs_raw GROUP BY lat, lon, date""")
def _(t):
    means = agg.daily_mean(t.obs_raw, ["lat", "lon", "date"], {
        c: f"{c}_avg" for c in ("u_wind", "v_wind", "slp", "sst")})
    return means.select("lat", "lon", "date", *[
        r6(c) for c in ("u_wind_avg", "v_wind_avg", "slp_avg", "sst_avg")])


@query("agg_snapped_mean", views="obs_raw", oracle="""
SELECT lat, lon, date, ROUND(AVG(sst), 6) AS sst_avg FROM (
 SELECT ROUND((lat - 0.125) * 4) / 4 AS lat, ROUND((lon + 0.125) * 4) / 4 AS lon, date, sst
 FROM obs_raw) u WHERE lat BETWEEN 2 AND 20 AND lon BETWEEN 100 AND 100.25 GROUP BY lat, lon, date""")
def _(t):
    offset = t.obs_raw.select((F.col("lat") - 0.125).alias("lat"), (F.col("lon") + 0.125).alias("lon"),
                              "date", "sst")
    means = agg.snap_then_mean(offset, {"sst": "sst_avg"}, (2, 20), (100, 100.25))
    return means.select("lat", "lon", "date", r6("sst_avg"))


@query("agg_label_counts", views="scores", oracle="""
SELECT SUM(label)::BIGINT AS pos, SUM(1 - label)::BIGINT AS neg,
 CAST(FLOOR(SUM(1 - label) / GREATEST(SUM(label), 1)) AS BIGINT) AS ratio FROM scores""")
def _(t):
    return agg.class_balance(t.scores)


@query("agg_split_class_counts", views="split_scores", oracle="""
SELECT split, SUM(label)::BIGINT AS pos, SUM(1 - label)::BIGINT AS neg, COUNT(*) AS total,
 CAST(FLOOR(SUM(1 - label) / GREATEST(SUM(label), 1)) AS BIGINT) AS ratio
FROM split_scores GROUP BY split""")
def _(t):
    return agg.split_balance(t.scores.withColumn("split", split_label("year", (1998, 1999))))


@query("agg_monthly_index", views="scores", oracle="""
SELECT year, month, ROUND(SUM(prob), 6) AS monthly_index,
 ROUND(SUM(CASE WHEN prob > 0.1 THEN prob ELSE 0 END), 6) AS monthly_index_thresh,
 COUNT(CASE WHEN prob > 0.3 THEN 1 END) AS monthly_index_count,
 ROUND(AVG(prob), 6) AS monthly_index_density, COUNT(*) AS cell_count,
 ROUND(LN(1 + SUM(prob)), 6) AS monthly_index_log FROM scores GROUP BY year, month""")
def _(t):
    m = agg.monthly_index(t.scores)
    return m.select("year", "month", "monthly_index_count", "cell_count", *[r6(c) for c in (
        "monthly_index", "monthly_index_thresh", "monthly_index_density", "monthly_index_log")])


def weights(t):
    """Cell weights per outcome, from the grid itself."""
    return t.obs_raw.filter("sst > 25 AND lat < 12").groupBy("lat", "lon").agg(
        (F.count(F.lit(1)) % 7 / 10.0).alias("prob_VN"), (F.count(F.lit(1)) % 3 / 10.0).alias("prob_PH"))


@query("agg_weighted_index_by_target", views="scores obs_raw", oracle="""
SELECT s.year, s.month, ROUND(SUM(s.prob), 6) AS monthly_index,
 ROUND(SUM(s.prob * COALESCE(g.prob_VN, 0)), 6) AS index_VN,
 ROUND(SUM(s.prob * COALESCE(g.prob_PH, 0)), 6) AS index_PH
FROM scores s LEFT JOIN (SELECT lat, lon, COUNT(*) % 7 / CAST(10.0 AS DOUBLE) AS prob_VN,
 COUNT(*) % 3 / CAST(10.0 AS DOUBLE) AS prob_PH FROM obs_raw WHERE sst > 25 AND lat < 12
 GROUP BY lat, lon) g ON g.lat = s.lat AND g.lon = s.lon GROUP BY s.year, s.month""")
def _(t):
    joined = attach_transition(t.scores, weights(t))
    m = agg.monthly_index(joined, weights=["prob_VN", "prob_PH"])
    return m.select("year", "month", r6("monthly_index"), r6("index_VN"), r6("index_PH"))


@query("agg_monthly_distinct", views="tracks", oracle="""
SELECT CAST(YEAR(ts) AS INTEGER) AS year, CAST(MONTH(ts) AS INTEGER) AS month,
 COUNT(DISTINCT SID) AS actual_count FROM tracks GROUP BY 1, 2""")
def _(t):
    return agg.monthly_distinct(with_year_month(t.tracks, "ts"))


@query("agg_monthly_distinct_by_target", views="tracks", oracle="""
SELECT year, month, COUNT(DISTINCT SID) AS actual_count, """ + ", ".join(
    f"COUNT(DISTINCT CASE WHEN outcome = '{o}' THEN SID END) AS actual_{o}"
    for o in agg.OUTCOMES) + """
FROM (SELECT t.SID, CAST(YEAR(ts) AS INTEGER) AS year, CAST(MONTH(ts) AS INTEGER) AS month, o.outcome
 FROM tracks t LEFT JOIN (SELECT SID, CASE WHEN MIN(lat) < 8 THEN 'VN' WHEN MIN(lat) < 15 THEN 'None'
  ELSE 'PH' END AS outcome FROM tracks WHERE lon < 100.1 GROUP BY SID) o ON o.SID = t.SID) u
GROUP BY year, month""")
def _(t):
    low = F.min("lat")
    outcomes = t.tracks.filter("lon < 100.1").groupBy("SID").agg(
        F.when(low < 8, "VN").when(low < 15, "None").otherwise("PH").alias("outcome"))
    months = agg.entity_months(with_year_month(t.tracks, "ts"))
    return agg.monthly_distinct_by(attach_outcome(months, outcomes))


@query("agg_monthly_driver_mean", views="scores month_index", oracle="""
SELECT s.year, s.month, ROUND(AVG(COALESCE(i.oni_value, 0.25)), 6) AS driver,
 ROUND(SUM(s.prob), 6) AS monthly_index
FROM scores s LEFT JOIN month_index i ON i.oni_year = s.year AND i.oni_month = s.month GROUP BY 1, 2""")
def _(t):
    rows = join_month_index(t.scores, t.month_index, "oni_year", "oni_month").withColumn(
        "oni_value", F.coalesce("oni_value", F.lit(0.25)))
    return agg.monthly_index(rows, driver="oni_value").select(
        "year", "month", r6("driver"), r6("monthly_index"))


@query("agg_dedup_entity_month", views="tracks", oracle="""
SELECT DISTINCT SID, CAST(YEAR(ts) AS INTEGER) AS year, CAST(MONTH(ts) AS INTEGER) AS month
FROM tracks""")
def _(t):
    return agg.entity_months(with_year_month(t.tracks, "ts"))


@query("agg_summary_counts", views="tracks", oracle="""
SELECT COUNT(*) AS total_rows, COUNT(DISTINCT SID) AS distinct_ids,
 CAST(MIN(year) AS INTEGER) AS first_year, CAST(MAX(year) AS INTEGER) AS last_year
FROM (SELECT DISTINCT SID, YEAR(ts) AS year, MONTH(ts) AS month FROM tracks) u""")
def _(t):
    return agg.summary(agg.entity_months(with_year_month(t.tracks, "ts")))


@query("agg_null_profile", views="obs_raw tracks", oracle="""
SELECT COUNT(*) AS total_rows, COUNT(SID) AS event_rows, COUNT(*) - COUNT(SID) AS other_rows,
 ROUND(COUNT(SID) / COUNT(*) * 100, 6) AS event_pct, COUNT(*) - COUNT(sst) AS sst_nulls,
 ROUND((COUNT(*) - COUNT(sst)) / COUNT(*) * 100, 6) AS sst_null_pct,
 COUNT(*) - COUNT(slp) AS slp_nulls, ROUND((COUNT(*) - COUNT(slp)) / COUNT(*) * 100, 6) AS slp_null_pct
FROM obs_raw o LEFT JOIN tracks t ON t.l_orderkey = o.l_orderkey AND t.l_linenumber = o.l_linenumber""")
def _(t):
    joined = t.obs_raw.join(t.tracks.select("l_orderkey", "l_linenumber", "SID"),
                            on=["l_orderkey", "l_linenumber"], how="left")
    p = agg.null_profile(joined, ["sst", "slp"])
    return p.select(*[r6(c) if c.endswith("pct") else F.col(c) for c in p.columns])


@query("agg_phase_distribution", views="obs_raw month_index", oracle="""
SELECT CAST(CASE WHEN oni_value >= 0.5 THEN 1 WHEN oni_value <= -0.5 THEN 2 ELSE 0 END AS INTEGER)
 AS phase, COUNT(*) AS row_count
FROM obs_raw o LEFT JOIN month_index i ON i.oni_year = YEAR(date) AND i.oni_month = MONTH(date)
GROUP BY 1 ORDER BY 1""")
def _(t):
    rows = join_month_index(with_year_month(t.obs_raw), t.month_index, "oni_year", "oni_month")
    return agg.phase_distribution(rows.withColumn("phase", classify_phase("oni_value")))


@query("agg_train_means", views="obs_raw", oracle="""
SELECT ROUND(AVG(sst), 6) AS sst, ROUND(AVG(slp), 6) AS slp, ROUND(AVG(u_wind), 6) AS u_wind
FROM obs_raw WHERE YEAR(date) <= 1998""")
def _(t):
    means = agg.feature_means(t.obs_raw.filter(F.year("date") <= 1998), ["sst", "slp", "u_wind"])
    return means.select(r6("sst"), r6("slp"), r6("u_wind"))


@query("agg_months_per_year", views="monthly", oracle="""
SELECT year, COUNT(*) AS months, COUNT(*) < 8 AS incomplete FROM monthly GROUP BY year""")
def _(t):
    return agg.months_per_year(t.monthly, 8)


@query("agg_annual_rollup", views="monthly_x", oracle="""
SELECT year, """ + ", ".join(
    f"CAST(SUM(actual_{x}) AS BIGINT) AS annual_actual_{x}, SUM(pred_{x}) AS annual_pred_{x}, "
    f"SUM(actual_{x}) - SUM(pred_{x}) AS error_{x}" for x in ("count", "VN", "PH")) + """
FROM monthly_x GROUP BY year""")
def _(t):
    return agg.annual_rollup(t.monthly_x, ["count", "VN", "PH"])


@query("agg_climatology", views="monthly", oracle="""
SELECT month, ROUND(AVG(actual_count), 6) AS actual_count_all, ROUND(AVG(pred_count), 6) AS pred_count_all,
 ROUND(AVG(CASE WHEN year >= 2000 THEN actual_count END), 6) AS actual_count_test,
 ROUND(AVG(CASE WHEN year >= 2000 THEN pred_count END), 6) AS pred_count_test
FROM monthly GROUP BY month""")
def _(t):
    c = agg.climatology(t.monthly, ["actual_count", "pred_count"], F.col("year") >= 2000)
    return c.select("month", *[r6(x) for x in c.columns if x != "month"])


@query("agg_residual_histogram", views="monthly", oracle="""
SELECT CAST(FLOOR((r - lo) / 0.5) AS BIGINT) AS bin, MIN(lo) + FLOOR((r - lo) / 0.5) * 0.5 AS left_edge,
 COUNT(*) AS row_count, (SELECT ROUND(AVG(pred_count - actual_count), 6) FROM monthly) AS mean_residual
FROM (SELECT pred_count - actual_count AS r, (SELECT MIN(pred_count - actual_count) - 0.5 FROM monthly)
 AS lo FROM monthly) u GROUP BY bin, FLOOR((r - lo) / 0.5)""")
def _(t):
    rows = t.monthly.withColumn("residual", F.col("pred_count") - F.col("actual_count"))
    mean = rows.agg(r6(F.avg("residual"), "m")).scalar()
    return agg.residual_histogram(rows).withColumn("mean_residual", mean)


@query("agg_pearson", views="monthly", oracle="""
SELECT ROUND(CORR(actual_count, pred_count), 6) AS r FROM monthly""")
def _(t):
    return agg.pearson(t.monthly, "actual_count", "pred_count").select(r6("r"))


@query("agg_peak_month", views="monthly", oracle="""
SELECT year, CASE WHEN MAX(actual_count) > 0 THEN
 ARG_MIN(month, actual_count * -100 + month) ELSE -1 END AS peak_month FROM monthly GROUP BY year""")
def _(t):
    return agg.peak_month(t.monthly)


@query("agg_year_metrics", views="monthly", oracle="""
SELECT year, CAST(SUM(actual_count) AS BIGINT) AS actual_total, ROUND(SUM(pred_count), 1) AS pred_total,
 ROUND(AVG(ABS(actual_count - pred_count)), 2) AS mae FROM monthly GROUP BY year""")
def _(t):
    return agg.year_metrics(t.monthly)


@query("agg_year_driver_mean", views="monthly_x", oracle="""
SELECT year, ROUND(AVG(driver), 6) AS mean_driver, CAST(CASE WHEN AVG(driver) >= 0.5 THEN 1
 WHEN AVG(driver) <= -0.5 THEN 2 ELSE 0 END AS INTEGER) AS phase FROM monthly_x GROUP BY year""")
def _(t):
    return agg.year_phase(t.monthly_x).select("year", r6("mean_driver"), "phase")
