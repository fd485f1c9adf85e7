"""The event model, the probability months and the forecast as queries, and the sinks that keep their results.

Trained numbers have no oracle; the oracles cover what is exact around them: which rows are scored or predicted,
the values they are held against, and that every prediction is admissible.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.extras import MASTER, master
from cellcast.catalog.models import KNOTS
from cellcast.catalog.polygons import OUTCOME, VISITS, _COUNTS, visits_of
from cellcast.catalog.registry import query
from cellcast.catalog.scalars import r6
from cellcast.functions.cleaning import COUNT_CEILING
from cellcast.operators.aggregates import (MATRIX_OUTCOMES, OUTCOMES, daily_mean, outcome_crosstab,
                                           outcome_prior, smooth_transition)
from cellcast.operators.monotone import apply_knots
from cellcast.plans import events
from cellcast.plans.features import build_features
from cellcast.plans.forecast import forecast
from cellcast.plans.monthly import monthly_features, probability_months
from cellcast.plans.tracks import prepare_tracks
from cellcast.shared import checkpointed, scratch
from cellcast.sources.sinks import load_artifacts, materialise, save_artifacts, write_predictions

EVENT_FEATURES = ["lat", "month", "u_wind_avg", "slp_avg", "sst_avg", "sst_7d_avg", "slp_tendency"]
# Last year that the forecast's models see, and the last year before its first fold.
FOLDS = (1994, 1999)


@query("plan_events", views="cell_day month_index tracks", oracle=MASTER + """
SELECT year, month, COUNT(*) AS cells, COUNT(*) AS admissible FROM master GROUP BY year, month""")
def _(t):
    features = materialise(t.spark, lambda: build_features(master(t)), scratch(t.spark, "features"))
    model = events.fit_events(features, EVENT_FEATURES, bounds=(1998, 1999))
    scored = events.score_events(features, model, EVENT_FEATURES)
    fine = F.col("prob").between(0, 1) & (F.col("prob_above_thresh") <= F.col("prob"))
    return scored.groupBy("year", "month").agg(F.count(F.lit(1)).alias("cells"), F.count_if(fine).alias("admissible"))


@query("plan_probability_months", views="geo_tracks edges scores monthly monthly_x", oracle=f"""
WITH {VISITS}, total AS (SELECT COUNT(outcome) AS n, {_COUNTS.replace('AS "', 'AS "all_')} FROM visits),
grid AS (SELECT lat_grid, lon_grid, """ + ", ".join(
    f"(COUNT(CASE WHEN outcome = '{o}' THEN 1 END) + 5 * MAX(\"all_{o}\") / MAX(n)) / (COUNT(*) + 5) AS \"{o}\""
    for o in MATRIX_OUTCOMES) + """ FROM visits, total GROUP BY 1, 2),
m AS (SELECT year, month, SUM(prob) AS monthly_index, SUM(prob * COALESCE("VN", 0)) AS index_VN,
 SUM(prob * COALESCE("PH", 0)) AS index_PH FROM scores LEFT JOIN grid ON lat = lat_grid AND lon = lon_grid
 GROUP BY 1, 2)
SELECT m.year, m.month, ROUND(m.monthly_index, 6) AS monthly_index, ROUND(m.index_VN, 6) AS index_VN,
 ROUND(m.index_PH, 6) AS index_PH, COALESCE(a.actual_count, 0) AS actual_count, COALESCE(a.actual_VN, 0) AS actual_VN
FROM m LEFT JOIN monthly_x a ON a.year = m.year AND a.month = m.month""")
def _(t):
    visits = checkpointed(visits_of(t))
    grid = smooth_transition(outcome_crosstab(visits), outcome_prior(visits)).withColumnsRenamed(
        {"lat_grid": "lat", "lon_grid": "lon"})
    actuals = t.monthly_x.select("year", "month", "actual_count", "actual_VN")
    return probability_months(t.scores, grid, actuals).select(
        "year", "month", r6("monthly_index"), r6("index_VN"), r6("index_PH"), "actual_count", "actual_VN")


# Counts and indices of the outcomes that the monthly view has none for, by place in report order.
DERIVED = {o: (f"(actual_count * {k + 2} + month) % {3 + k % 3}", f"(actual_count + month * {k + 1}) % {7 + k}")
           for k, o in enumerate(OUTCOMES) if o not in ("VN", "PH")}
_ACTUALS = {"count": "actual_count", "VN": "actual_VN", "PH": "actual_PH", **{o: a for o, (a, _) in DERIVED.items()}}


def forecast_months(t):
    """Months with an actual count and an index for every target."""
    return t.monthly_x.withColumns({f"actual_{o}": F.expr(a) for o, (a, _) in DERIVED.items()} | {
        f"index_{o}": F.expr(f"CAST({i} AS DOUBLE)") for o, (_, i) in DERIVED.items()} | {
        "monthly_index_log": F.log1p("monthly_index")})


def held_out_rows(months):
    """A row per month and target: its actual count, and whether its prediction is admissible."""
    return months.select("year", "month", F.inline(F.array(*[F.struct(
        F.lit(o).alias("target"), F.col(f"actual_{o}").cast("long").alias("actual"),
        F.coalesce(F.col(f"pred_{o}").between(0, COUNT_CEILING * 10), F.lit(False)).alias("admissible"))
        for o in _ACTUALS])))


@query("plan_forecast", views="monthly monthly_x", oracle=" UNION ALL ".join(
    f"SELECT year, month, '{o}' AS target, CAST({a} AS BIGINT) AS actual, TRUE AS admissible FROM monthly_x "
    f"WHERE year > {FOLDS[1]}" for o, a in _ACTUALS.items()))
def _(t):
    rows, names = monthly_features(forecast_months(t))
    return held_out_rows(forecast(rows, names, start=FOLDS[0], end=FOLDS[1]).held_out())


# Raw points as text; every thirteenth has a sentinel for its latitude.
_KEPT = "kept AS (SELECT * FROM geo_tracks WHERE event_id % 13 <> 0 AND lat BETWEEN 0 AND 30)"


@query("plan_tracks", views="geo_tracks edges", oracle=f"""
WITH {_KEPT}, {OUTCOME.replace("geo_tracks", "kept")}
SELECT outcome, COUNT(DISTINCT SID) AS events, COUNT(*) AS event_months FROM (
 SELECT DISTINCT k.SID, YEAR(ts) AS y, MONTH(ts) AS m, outcome FROM kept k JOIN outcomes o ON o.SID = k.SID) d
GROUP BY outcome""")
def _(t):
    raw = t.geo_tracks.withColumns({
        "lat": F.when(F.col("event_id") % 13 == 0, "-999").otherwise(F.col("lat").cast("string")),
        "lon": F.col("lon").cast("string")})
    tracks = prepare_tracks(raw, t.edges, order=("event_id",))
    return tracks.months.join(tracks.outcomes, "SID").groupBy("outcome").agg(
        F.countDistinct("SID").alias("events"), F.count("*").alias("event_months"))


@query("snk_feature_checkpoint", views="cell_day", oracle="""
SELECT lat, lon, date, ROUND(sst_avg, 6) AS sst_avg FROM cell_day""")
def _(t):
    path = scratch(t.spark, "cells")
    materialise(t.spark, lambda: daily_mean(t.obs_raw, ["lat", "lon", "date"], {"sst": "sst_avg"}), path)
    # A finished table is read, not built again: this builder's rows must not be seen.
    again = materialise(t.spark, lambda: t.obs_raw.limit(0), path)
    return again.select("lat", "lon", "date", r6("sst_avg"))


@query("snk_predictions_csv", views="monthly monthly_x", oracle="""
SELECT year, month, actual_count, pred_count, pred_VN, pred_PH FROM monthly_x WHERE year > 1999""")
def _(t):
    path = scratch(t.spark, "predictions")
    write_predictions(t.monthly_x, path, after=1999)
    schema = "year int, month int, actual_count bigint, pred_count double, pred_VN double, pred_PH double"
    return t.spark.read.csv(path, header=True, schema=schema)


@query("snk_model_artifacts", views="scores", oracle="""
SELECT l_orderkey, l_linenumber, ROUND(CASE WHEN prob <= 0.05 THEN 0 """ + " ".join(
    f"WHEN prob <= {x2} THEN {y1} + ({y2} - {y1}) * (prob - {x1}) / (CAST({x2} AS DOUBLE) - {x1})"
    for (x1, y1), (x2, y2) in zip(KNOTS, KNOTS[1:])) + """ ELSE 0.9 END, 6) AS calibrated, ROUND(m, 6) AS mean_prob
FROM scores, (SELECT AVG(prob) AS m FROM scores) a""")
def _(t):
    path = scratch(t.spark, "artifacts")
    save_artifacts(path, {"knots": t.spark.createDataFrame(KNOTS, "x double, y double"),
                          "means": t.scores.agg(F.avg("prob").alias("prob"))})
    held = load_artifacts(t.spark, path, ("knots", "means"))
    mean = held["means"].first()["prob"]
    return apply_knots(t.scores, held["knots"], "prob").select(
        "l_orderkey", "l_linenumber", r6("calibrated"), F.round(F.lit(mean), 6).alias("mean_prob"))
