"""Evaluation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.catalog.scalars import r6
from cellcast.functions.features import split_label
from cellcast.operators import evaluate
from cellcast.operators.monotone import apply_knots

def in_test():
    return F.col("year") >= 2000


@query("eval_mae", views="monthly_x", oracle="""
SELECT ROUND(AVG(ABS(actual_count - pred_count)), 6) AS mae_pred_count,
 ROUND(AVG(ABS(actual_VN - pred_VN)), 6) AS mae_pred_VN,
 ROUND(AVG(ABS(actual_PH - pred_PH)), 6) AS mae_pred_PH FROM monthly_x WHERE year >= 2000""")
def _(t):
    m = evaluate.mae(t.monthly_x, [(f"actual_{x}", f"pred_{x}") for x in ("count", "VN", "PH")], in_test())
    return m.select(*[r6(c) for c in m.columns])


@query("eval_mase", views="monthly", oracle="""
SELECT ROUND(mae, 6) AS mae, ROUND(naive_mae, 6) AS naive_mae, ROUND(mae / naive_mae, 6) AS mase FROM (
 SELECT AVG(ABS(actual_count - pred_count)) AS mae, AVG(ABS(actual_count
  - (SELECT AVG(actual_count) FROM monthly WHERE year <= 1999))) AS naive_mae
 FROM monthly WHERE year >= 2000) u""")
def _(t):
    m = evaluate.mase(t.monthly, F.col("year") <= 1999, in_test())
    return m.select(r6("mae"), r6("naive_mae"), r6("mase"))


@query("eval_bias_by_phase", views="monthly_x", oracle="""
SELECT ROUND(SUM(e), 6) AS bias, ROUND(SUM(CASE WHEN driver >= 0.5 THEN e ELSE 0 END), 6) AS bias_warm,
 ROUND(SUM(CASE WHEN driver <= -0.5 THEN e ELSE 0 END), 6) AS bias_cold,
 ROUND(SUM(CASE WHEN driver < 0.5 AND driver > -0.5 THEN e ELSE 0 END), 6) AS bias_neutral
FROM (SELECT driver, pred_count - actual_count AS e FROM monthly_x WHERE year >= 2000) u""")
def _(t):
    b = evaluate.bias_by_phase(t.monthly_x.filter(in_test()))
    return b.select(*[r6(c) for c in b.columns])


@query("eval_tweedie_deviance", views="monthly", oracle="""
SELECT CASE WHEN MIN(pred_count) > 0 THEN ROUND(AVG(CASE WHEN pred_count > 0 THEN
 2 * (-4 * SQRT(actual_count) + 2 * actual_count / SQRT(pred_count) + 2 * SQRT(pred_count)) END), 6) END
 AS tweedie_deviance FROM monthly WHERE year >= 2000""")
def _(t):
    return evaluate.tweedie_deviance(t.monthly.filter(in_test())).select(r6("tweedie_deviance"))


@query("eval_annual_mae", views="monthly", oracle="""
SELECT ROUND(AVG(ABS(a - p)), 6) AS annual_mae FROM (SELECT SUM(actual_count) AS a, SUM(pred_count) AS p
 FROM monthly WHERE year >= 1998 GROUP BY year) u""")
def _(t):
    return evaluate.annual_mae(t.monthly.filter("year >= 1998")).select(r6("annual_mae"))


@query("eval_calibration_shift", views="scores", oracle="""
SELECT ROUND(AVG(prob), 6) AS raw_mean, ROUND(AVG(CASE WHEN prob <= 0.5 THEN prob / 5
 ELSE 0.1 + (prob - 0.5) * 1.8 END), 6) AS calibrated_mean FROM scores""")
def _(t):
    knots = t.spark.createDataFrame([(0.0, 0.0), (0.5, 0.1), (1.0, 1.0)], "x double, y double")
    shift = evaluate.calibration_shift(apply_knots(t.scores, knots, "prob"), "prob", "calibrated")
    return shift.select(r6("raw_mean"), r6("calibrated_mean"))


@query("eval_classifier_report", views="split_scores", oracle="""
WITH d AS (SELECT split, prob, SUM(label) AS pos, SUM(1 - label) AS neg FROM split_scores GROUP BY 1, 2),
c AS (SELECT split, pos, neg, CAST(SUM(pos) OVER w AS DOUBLE) AS tp, CAST(SUM(neg) OVER w AS DOUBLE) AS fp
 FROM d WINDOW w AS (PARTITION BY split ORDER BY prob DESC))
SELECT split, 'auprc' AS metric, ROUND(SUM(pos * tp / (tp + fp)) / SUM(pos), 9) AS value FROM c GROUP BY split
UNION ALL SELECT split, 'roc_auc', ROUND(1 - SUM(pos * (fp - neg / CAST(2.0 AS DOUBLE)))
 / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 9) FROM c GROUP BY split""")
def _(t):
    rows = t.scores.withColumn("split", split_label("year", (1998, 1999)))
    return evaluate.classifier_report(rows).select("split", "metric", F.round("value", 9).alias("value"))
