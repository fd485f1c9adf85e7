import math
import random

import pytest
from pyspark.sql import functions as F

from cellcast.catalog.extras import master
from cellcast.functions.dates import with_year_month
from cellcast.operators.aggregates import (OUTCOMES, cell_visits, entity_months, monthly_distinct_by,
                                           outcome_crosstab, outcome_prior, smooth_transition)
from cellcast.operators.geo import first_hit
from cellcast.operators.joins import attach_outcome
from cellcast.operators.counts import fit_zero_inflated
from cellcast.plans import events, forecast
from cellcast.plans.features import ALL_FEATURES, build_features
from cellcast.plans.master import build_master
from cellcast.plans.monthly import count_features, monthly_features, probability_months
from cellcast.shared import scratch
from cellcast.sources.sinks import materialise
from tests.plans_helper import plan_of

# The master and feature columns.
MASTER = ["lat", "lon", "date", "year", "month", "u_wind_avg", "v_wind_avg", "slp_avg",
          "wind_speed_env_avg", "sst_avg", "oni_value", "phase", "SID"]


@pytest.fixture(scope="module")
def features(spark, tables):
    path = scratch(spark, "features")
    return materialise(spark, lambda: build_features(master(tables)), path)


def test_master_schema_and_keys(tables):
    m = master(tables)
    assert m.columns == MASTER
    assert m.count() == m.select("lat", "lon", "date").distinct().count()


def test_master_without_surface_source(spark, tables):
    obs = tables.obs_raw.withColumn("wind_speed_env", F.lit(1.0))
    index = spark.createDataFrame([(1997, 1, 0.7)], "index_year int, index_month int, oni_value double")
    points = spark.createDataFrame([], "lat double, lon double, date date, SID string")
    m = build_master(obs, None, index, points)
    assert m.filter("sst_avg IS NOT NULL").count() == 0 and dict(m.dtypes)["sst_avg"] == "double"


def test_features_are_complete(features):
    assert len(ALL_FEATURES) == len(set(ALL_FEATURES)) == 24
    assert set(ALL_FEATURES) <= set(features.columns) and "is_event" in features.columns


def test_features_in_chunks_match_plain(spark, tables):
    m = master(tables)
    plain = build_features(m)
    cut = build_features(m, chunk_rows=256)
    cols = ["lat", "lon", "date", "sst_180d_avg", "slp_90d_avg"]
    a = plain.select(*cols[:3], *[F.round(c, 6).alias(c) for c in cols[3:]])
    b = cut.select(*cols[:3], *[F.round(c, 6).alias(c) for c in cols[3:]])
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_event_plan_round_trip(spark, features):
    names = ["lat", "month", "sst_avg", "slp_avg", "sst_7d_avg", "slp_tendency"]
    model = events.fit_events(features, names, bounds=(1998, 1999), ratio=3, rounds=2, depth=2)
    report = {(r.split, r.metric): r.value for r in model.report.collect()}
    assert set(report) == {(s, m) for s in ("Val", "Test") for m in ("roc_auc", "auprc")}
    assert report["Test", "roc_auc"] > 0.8
    shift = model.shift.first()
    assert 0 < shift.calibrated_mean < 1
    path = scratch(spark, "model")
    model.save(path)
    again = events.EventModel.load(spark, path)
    one = events.score_events(features, model, names, ["lat", "lon", "date"])
    two = events.score_events(features, again, names, ["lat", "lon", "date"])
    assert one.count() == features.count()
    both = one.join(two.withColumnRenamed("prob", "other"), ["lat", "lon", "date"])
    assert both.agg(F.max(F.abs(F.col("prob") - F.col("other")))).first()[0] < 1e-12
    assert "Exchange" not in plan_of(one).split("Subqueries")[0]


def test_scores_to_months_per_outcome(spark, tables):
    scored = tables.scores
    outcomes = first_hit(tables.geo_tracks, tables.edges, order=["ts", "event_id"])
    visits = cell_visits(tables.geo_tracks.select(
        "SID", F.round("lat").alias("lat_grid"), F.round("lon").alias("lon_grid")).join(outcomes, "SID"))
    grid = smooth_transition(outcome_crosstab(visits), outcome_prior(visits)).withColumnsRenamed(
        {"lat_grid": "lat", "lon_grid": "lon"})
    actuals = monthly_distinct_by(attach_outcome(
        entity_months(with_year_month(tables.tracks, "ts")),
        tables.tracks.select("SID").distinct().withColumn("outcome", F.lit("VN"))))
    months = probability_months(scored, grid, actuals)
    assert {f"index_{o}" for o in OUTCOMES} <= set(months.columns)
    got = months.agg(F.sum("monthly_index"), F.sum("actual_VN"), F.sum("actual_count")).first()
    assert got[0] == pytest.approx(tables.scores.agg(F.sum("prob")).first()[0])
    assert got[1] == got[2] > 0


def month_table(spark):
    rng = random.Random(4)
    rows = []
    for y in range(2001, 2007):
        for m in range(1, 13):
            x = 3 + 2 * math.sin(m / 2) + rng.random()
            rows.append((y, m, x, x / 2, float(int(x)), x / 100, math.log1p(x), rng.uniform(-1, 1),
                         int(x), x / 4, int(x) % 2))
    return spark.createDataFrame(
        rows, "year int, month int, monthly_index double, monthly_index_thresh double, "
        "monthly_index_count double, monthly_index_density double, monthly_index_log double, "
        "driver double, actual_count int, index_VN double, actual_VN int")


def test_monthly_features_both_modes(spark):
    for legacy in (False, True):
        df, names = monthly_features(month_table(spark), legacy)
        assert len(names) == len(set(names)) and set(names) <= set(df.columns)
        assert df.count() == 72 and df.select(*names).dropna().count() == 72
    df, names = monthly_features(month_table(spark))
    for target in ("count", "VN"):
        assert set(sum(count_features(target), [])) <= set(df.columns)


def test_forecast_stack_and_skips(spark):
    df, names = monthly_features(month_table(spark))
    some = ["monthly_index", "monthly_index_log", "driver", "month_sin", "month_cos"]
    out = forecast.forecast(df, some, ("count", "VN", "JP"), start=2004, end=2005, trees=8)
    assert set(out.models) | set(out.failed) == {"count", "VN"} and "count" in out.models
    assert out.models["count"].weights is not None
    preds = out.months.select("year", "actual_count", "pred_count").collect()
    assert len(preds) == 72 and all(0 <= r.pred_count < 200 for r in preds)
    error = sum(abs(r.pred_count - r.actual_count) for r in preds if r.year == 2006) / 12
    assert error < 1.0
    report = forecast.held_out_report(out.months, list(out.models), end=2005)
    assert report["mase"].first().mase < 1.0
    assert report["annual"].count() == 1 and report["bias"].count() == 1


def test_forecast_failure_of_one_target_is_recorded(spark):
    """A target without a single value admits no model; one with negative counts does."""
    df, _ = monthly_features(month_table(spark))
    df = df.withColumns({"actual_JP": F.lit(None).cast("int"),
                         "actual_VN": F.when(F.col("month") == 5, -3).otherwise(F.col("actual_VN"))})
    df = df.withColumn("index_JP", F.col("index_VN")).withColumn("index_JP_log", F.col("index_VN_log"))
    out = forecast.forecast(df, ["driver"], ("count", "JP", "VN"), start=2005, end=2005, trees=2)
    assert list(out.failed) == ["JP"] and set(out.models) == {"count", "VN"}
    assert out.months.filter("pred_VN < 0 OR isnan(pred_VN)").count() == 0


def test_forecast_raises_what_says_nothing_about_the_rows(spark, monkeypatch):
    df, _ = monthly_features(month_table(spark))

    def fit(*_):
        raise RuntimeError("an executor was lost")

    monkeypatch.setattr(forecast, "fit_zero_inflated_groups", fit)
    with pytest.raises(RuntimeError):
        forecast.forecast(df, ["driver"], ("count",), start=2004, end=2005)


def test_saved_forecast_predicts_the_same(spark):
    df, _ = monthly_features(month_table(spark))
    out = forecast.forecast(df, ["monthly_index", "driver", "month"], ("count", "VN"), start=2004, end=2005, trees=4)
    assert {r.year for r in out.held_out().select("year").distinct().collect()} == {2006}
    path = scratch(spark, "forecast")
    out.save(path)
    again = forecast.with_predictions(df, forecast.load_models(spark, path))
    both = out.months.select("year", "month", "pred_count", "pred_VN").join(
        again.select("year", "month", F.col("pred_count").alias("c"), F.col("pred_VN").alias("v")), ["year", "month"])
    assert both.count() == 72
    assert both.agg(F.max(F.abs(F.col("c") - F.col("pred_count")) + F.abs(F.col("v") - F.col("pred_VN")))).first()[0] < 1e-12


def test_folds_see_only_earlier_years(spark):
    """The stack of one target equals the one of models fitted fold by fold."""
    df, _ = monthly_features(month_table(spark))
    out = forecast.forecast(df, ["monthly_index", "month"], ("count",), start=2004, end=2005, trees=3)
    count, inflation = count_features("count")
    changed = df.withColumn("actual_count", F.when(F.col("year") == 2006, 99).otherwise(F.col("actual_count")))
    same = forecast.forecast(changed, ["monthly_index", "month"], ("count",), start=2004, end=2005, trees=3)
    assert same.models["count"].weights == pytest.approx(out.models["count"].weights)
    alone = fit_zero_inflated(df.filter("year <= 2005"), count, inflation, "actual_count")
    assert out.models["count"].counts.beta == pytest.approx(alone.beta, abs=1e-6)
