"""Models. Exact fits carry an oracle; trained ones are checked by invariants in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.catalog.scalars import r6
from cellcast.functions.features import cyclical, phase_interactions
from cellcast.operators import linear, models
from cellcast.operators.aggregates import feature_means
from cellcast.operators.batches import score_batches
from cellcast.operators.boosting import fit_boosted, predict_boosted
from cellcast.operators.counts import (fit_zero_inflated, fit_zero_inflated_groups, inputs,
                                       predict_zero_inflated)
from cellcast.operators.monotone import apply_knots
from cellcast.operators.sampling import temporal_split
from cellcast.operators.seasonal import fit_seasonal_poisson, predict_seasonal
from cellcast.shared import checkpointed

KEY = ["l_orderkey", "l_linenumber"]
FEATURES = ["lat", "month", "u_wind", "slp", "sst"]
SPLIT = (1998, 1999)
COUNT_FEATURES = ["monthly_index", "index_x_driver", "index_x_month_sin", "index_x_month_cos"]
INFLATION_FEATURES = ["month_sin", "month_cos", "driver"]


_fits: dict[tuple[str, str], tuple] = {}


def fitted(t):
    """Classifier, train means and the three splits; fitted once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.path(""))
    if key not in _fits:
        train, val, test = temporal_split(t.labelled, SPLIT)
        means = checkpointed(feature_means(train, FEATURES))
        model = models.fit_classifier(train, val, FEATURES, means)
        _fits.clear()
        _fits[key] = model, means, (train, val, test)
    return _fits[key]


@query("ml_event_classifier")
def _(t):
    model, means, _ = fitted(t)
    return models.raw_scores(t.labelled, model, FEATURES, means).select(*KEY, r6("raw_prob"))


@query("ml_class_weights", views="labelled", oracle="""
SELECT l_orderkey, l_linenumber, ROUND(CASE WHEN label = 1 THEN
 (SELECT CAST(SUM(1 - label) AS DOUBLE) / SUM(label) FROM labelled) ELSE 1 END, 6) AS weight FROM labelled""")
def _(t):
    return models.class_weights(t.labelled).select(*KEY, r6("weight"))


@query("ml_feature_importance")
def _(t):
    model, _, _ = fitted(t)
    return models.importances(t.labelled, model, FEATURES)


def calibrated(t):
    model, means, (_, val, _) = fitted(t)
    calibrator = models.fit_calibrator(models.raw_scores(val, model, FEATURES, means))
    return model, means, calibrator


# The monotone fit by its max-min formula over the distinct scores.
@query("ml_isotonic_calibrate", views="scores", oracle="""
WITH d AS (SELECT prob AS x, CAST(SUM(label) AS DOUBLE) AS s, COUNT(*) AS w FROM scores GROUP BY prob),
c AS (SELECT *, ROW_NUMBER() OVER (ORDER BY x) AS i, SUM(s) OVER (ORDER BY x) AS cs,
 SUM(w) OVER (ORDER BY x) AS cw FROM d),
p AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m
 FROM c a JOIN c b ON b.i >= a.i),
q AS (SELECT b AS i, MIN(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM p),
f AS (SELECT i, MAX(m) AS y FROM q GROUP BY i)
SELECT l_orderkey, l_linenumber, ROUND(f.y, 6) AS calibrated
FROM scores JOIN c ON scores.prob = c.x JOIN f ON f.i = c.i""")
def _(t):
    calibrator = models.fit_calibrator(t.scores, "prob")
    return models.calibrate(t.scores, calibrator, "prob", "calibrated").select(*KEY, r6("calibrated"))


@query("ml_score_distributed")
def _(t):
    model, means, calibrator = calibrated(t)
    return models.score(t.labelled, model, calibrator, FEATURES, means, [*KEY, "year", "month"])


# Fixed knots of a calibration map.
KNOTS = ((0.05, 0.0), (0.2, 0.02), (0.5, 0.1), (0.8, 0.4), (0.95, 0.9))


@query("ml_calibrate_apply", views="scores", oracle="""
SELECT l_orderkey, l_linenumber, ROUND(CASE WHEN prob <= 0.05 THEN 0 """ + " ".join(
    f"WHEN prob <= {x2} THEN {y1} + ({y2} - {y1}) * (prob - {x1}) / (CAST({x2} AS DOUBLE) - {x1})"
    for (x1, y1), (x2, y2) in zip(KNOTS, KNOTS[1:])) + """ ELSE 0.9 END, 6) AS calibrated FROM scores""")
def _(t):
    knots = t.spark.createDataFrame(KNOTS, "x double, y double")
    return apply_knots(t.scores, knots, "prob").select(*KEY, r6("calibrated"))


# Fixed coefficients of the linear scorer.
COEFFICIENTS, INTERCEPT = {"sst": 0.08, "slp": -0.00001, "u_wind": 0.05}, -3.0
_LOGISTIC = ("1 / (1 + EXP(-(-3.0 + 0.08 * COALESCE(sst, 0) - CAST(0.00001 AS DOUBLE) * slp"
             " + 0.05 * u_wind)))")


@query("ml_score_linear_fixed", views="labelled", oracle=f"""
SELECT l_orderkey, l_linenumber, ROUND({_LOGISTIC}, 6) AS prob FROM labelled""")
def _(t):
    rows = t.labelled.fillna(0.0, subset=["sst"])
    return linear.score_logistic(rows, COEFFICIENTS, INTERCEPT).select(*KEY, r6("prob"))


def monthly_features(t):
    return cyclical(phase_interactions(t.monthly_x))


@query("ml_tweedie_regressor")
def _(t):
    rows = monthly_features(t)
    model = fit_boosted(rows.filter("year <= 1999"), [*COUNT_FEATURES, "month"], "actual_count", ["month"])
    return predict_boosted(rows, model).select("year", "month", r6("pred"))


@query("ml_zero_inflated_count")
def _(t):
    rows = monthly_features(t)
    model = fit_zero_inflated(rows.filter("year <= 1999"), COUNT_FEATURES, INFLATION_FEATURES,
                              "actual_VN")
    return predict_zero_inflated(rows, model).select("year", "month", r6("pred"))


# Targets that take each step of the fallback: both parts can be fitted; without a zero there is no
# zero part; what never occurs has no model at all.
FALLBACKS = {"some": ("actual_VN", "zero_inflated"), "always": ("actual_VN + 1", "count"),
             "never": ("actual_VN * 0", "zeros")}


@query("ml_fit_fallback", views="monthly_x", oracle=" UNION ALL ".join(
    f"SELECT year, month, '{name}' AS target, '{kind}' AS kind, {name != 'never'} AS positive FROM monthly_x"
    for name, (_, kind) in FALLBACKS.items()))
def _(t):
    rows = monthly_features(t)
    each = F.array(*[F.struct(F.lit(k).alias("_group"), F.expr(f"CAST({target} AS DOUBLE)").alias("_y"))
                     for k, (target, _) in enumerate(FALLBACKS.values())])
    long = rows.select(inputs(COUNT_FEATURES).alias("_c"), inputs(INFLATION_FEATURES).alias("_i"), F.inline(each))
    found = fit_zero_inflated_groups(long, [(COUNT_FEATURES, INFLATION_FEATURES)] * len(FALLBACKS))
    kinds = F.array(*[F.struct(F.lit(name).alias("target"), F.lit(model.kind).alias("kind"),
                               (model.predict() > 0).alias("positive")) for name, model in zip(FALLBACKS, found)])
    return rows.select("year", "month", F.inline(kinds))


@query("ml_standardise", views="labelled", oracle="""
SELECT l_orderkey, l_linenumber, ROUND((slp - m1) / s1, 6) AS slp_z, ROUND((u_wind - m2) / s2, 6) AS u_wind_z
FROM labelled, (SELECT AVG(slp) AS m1, STDDEV_POP(slp) AS s1, AVG(u_wind) AS m2, STDDEV_POP(u_wind) AS s2
 FROM labelled WHERE year <= 1998) f""")
def _(t):
    z = linear.standardise(t.labelled, ["slp", "u_wind"], t.labelled.filter("year <= 1998"))
    return z.select(*KEY, r6("slp_z"), r6("u_wind_z"))


STACK_SQL = """s AS (SELECT kind, COUNT(*) AS n, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my,
 VAR_POP(x1) * COUNT(*) + 1 AS a, VAR_POP(x2) * COUNT(*) + 1 AS d, COVAR_POP(x1, x2) * COUNT(*) AS b,
 COVAR_POP(x1, y) * COUNT(*) AS p, COVAR_POP(x2, y) * COUNT(*) AS q FROM base GROUP BY kind),
free AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS f1, (a * q - b * p) / (a * d - b * b) AS f2,
 GREATEST(p / a, 0) AS o1, GREATEST(q / d, 0) AS o2 FROM s),
w AS (SELECT kind, n, m1, m2, my,
 CASE WHEN f1 >= 0 AND f2 >= 0 THEN f1 WHEN o1 * p >= o2 * q THEN o1 ELSE 0 END AS w1,
 CASE WHEN f1 >= 0 AND f2 >= 0 THEN f2 WHEN o1 * p >= o2 * q THEN 0 ELSE o2 END AS w2 FROM free)"""


@query("ml_nonneg_ridge", views="monthly_x", oracle=f"""
WITH base AS (SELECT 'both' AS kind, pred_count AS x1, index_VN AS x2, CAST(actual_count AS DOUBLE) AS y
  FROM monthly_x
 UNION ALL SELECT 'first', pred_count, -index_VN, actual_count FROM monthly_x
 UNION ALL SELECT 'none', -pred_count, -index_VN, actual_count FROM monthly_x), {STACK_SQL}
SELECT kind, ROUND(w1, 6) AS w1, ROUND(w2, 6) AS w2, ROUND(my - w1 * m1 - w2 * m2, 6) AS intercept FROM w""")
def _(t):
    cases = F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("pred_count") * a).alias("x1"),
                               (F.col("index_VN") * b).alias("x2"))
                      for kind, a, b in (("both", 1, 1), ("first", 1, -1), ("none", -1, -1))])
    base = t.monthly_x.select(F.col("actual_count").cast("double").alias("y"), F.inline(cases))
    return linear.fit_stack(base, "x1", "x2", "y", by=["kind"]).select(
        "kind", *[(F.round(c, 6) + 0).alias(c) for c in ("w1", "w2", "intercept")])


@query("ml_walk_forward_oof", views="monthly_x", oracle="""
SELECT t.year, t.month,
 ROUND(REGR_INTERCEPT(l.actual_count, l.monthly_index) + REGR_SLOPE(l.actual_count, l.monthly_index)
  * t.monthly_index, 6) AS pred_monthly_index,
 ROUND(REGR_INTERCEPT(l.actual_count, l.driver) + REGR_SLOPE(l.actual_count, l.driver) * t.driver, 6)
  AS pred_driver
FROM monthly_x t JOIN monthly_x l ON l.year < t.year
WHERE t.year > 1996 AND t.year <= 1999 GROUP BY t.year, t.month, t.monthly_index, t.driver""")
def _(t):
    oof = linear.walk_forward_lines(t.monthly_x, ["monthly_index", "driver"], "actual_count", 1996, 1999)
    return oof.select("year", "month", r6("pred_monthly_index"), r6("pred_driver"))


@query("ml_multi_target", views="monthly_x", oracle=f"""
WITH long AS (SELECT year, month, 'count' AS kind, CAST(actual_count AS DOUBLE) AS y, monthly_index AS z1,
  driver AS z2 FROM monthly_x
 UNION ALL SELECT year, month, 'VN', actual_VN, index_VN, driver FROM monthly_x
 UNION ALL SELECT year, month, 'PH', actual_PH, index_PH, driver FROM monthly_x),
base AS (SELECT t.kind, t.year, t.month, t.y,
  REGR_INTERCEPT(l.y, l.z1) + REGR_SLOPE(l.y, l.z1) * t.z1 AS x1,
  REGR_INTERCEPT(l.y, l.z2) + REGR_SLOPE(l.y, l.z2) * t.z2 AS x2
 FROM long t JOIN long l ON l.kind = t.kind AND l.year < t.year
 WHERE t.year > 1995 AND t.year <= 1999 GROUP BY t.kind, t.year, t.month, t.y, t.z1, t.z2),
{STACK_SQL},
lines AS (SELECT kind, REGR_SLOPE(y, z1) AS s1, REGR_INTERCEPT(y, z1) AS i1, REGR_SLOPE(y, z2) AS s2,
 REGR_INTERCEPT(y, z2) AS i2 FROM long WHERE year <= 1999 GROUP BY kind)
SELECT l.year, l.month, l.kind AS target, ROUND(GREATEST(w1 * (i1 + s1 * z1) + w2 * (i2 + s2 * z2)
 + my - w1 * m1 - w2 * m2, 0), 6) AS pred
FROM long l JOIN lines USING (kind) JOIN w USING (kind)""")
def _(t):
    long = linear.targets_long(t.monthly_x, ["count", "VN", "PH", "TW"], ["year", "month", "driver"])
    out = linear.stacked_forecast(long, ("own_index", "driver"), "y", 1995, 1999, by=["target"])
    return out.select("year", "month", "target", r6("pred"))


@query("ml_seasonal_poisson")
def _(t):
    rows = monthly_features(t)
    fits = fit_seasonal_poisson(rows.filter("year <= 1999"), ["monthly_index", "driver"], "actual_count")
    return predict_seasonal(rows, fits, "pred").select("year", "month", r6("pred"))


@query("ml_vector_assemble", views="labelled", oracle="SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CAST(COALESCE({c}, 0) AS DOUBLE) AS f{k}" for k, c in enumerate(FEATURES)) + " FROM labelled")
def _(t):
    filled = t.labelled.fillna(0.0, subset=["sst"])
    vector = models.vector_to_array("features")
    return models.assemble(filled, FEATURES).select(*KEY, *[vector[k].alias(f"f{k}") for k in range(len(FEATURES))])


def linear_scorer(coef: dict[str, float], intercept: float, keys: list[str]):
    """Loader of a linear scorer; a closure, so executors need not have this package installed."""
    def load():
        names, weights = list(coef), np.array(list(coef.values()))

        def scorer(batch: pd.DataFrame) -> pd.DataFrame:
            eta = batch[names].fillna(0.0).to_numpy() @ weights + intercept
            return batch[keys].assign(prob=np.round(1.0 / (1.0 + np.exp(-eta)), 6))

        return scorer

    return load


@query("udf_batch_scorer", views="labelled", oracle=f"""
SELECT l_orderkey, l_linenumber, ROUND({_LOGISTIC}, 6) AS prob FROM labelled""")
def _(t):
    return score_batches(t.labelled.select(*KEY, *COEFFICIENTS),
                         linear_scorer(COEFFICIENTS, INTERCEPT, KEY),
                         "l_orderkey bigint, l_linenumber int, prob double")
