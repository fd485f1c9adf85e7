"""Scores to months, and monthly features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.cleaning import sanitise
from cellcast.functions.features import cyclical, log_index, one_hot, phase_interactions
from cellcast.operators.aggregates import monthly_index
from cellcast.operators.joins import attach_transition, calendar_lag, join_actuals
from cellcast.operators.linear import score_logistic
from cellcast.operators.windows import diff_in_group, momentum, trailing_in_group, ytd_before


def cell_scores_to_months(features: DataFrame, coef: Mapping[str, float], intercept: float,
                          driver: str = "oni_value") -> DataFrame:
    """Fixed logistic score per cell and day, rolled up by month with the mean driver, one pass."""
    filled = features.fillna(0.0, subset=list(coef))
    return monthly_index(score_logistic(filled, dict(coef), intercept), driver=driver)


def probability_months(scored: DataFrame, transition: DataFrame, actuals: DataFrame,
                       driver: str | None = None) -> DataFrame:
    """Calibrated cell scores to months: total and per-outcome indices with the actual counts.

    ``transition`` holds ``prob_<outcome>`` per cell. One broadcast lookup and one aggregate over the
    scores; everything after it has one row per month.
    """
    weights = [c for c in transition.columns if c.startswith("prob_")]
    rows = attach_transition(scored.select("year", "month", "lat", "lon", F.col("prob").alias("p"), *(
        [driver] if driver else [])), transition)
    months = monthly_index(rows, "p", weights, driver)
    if driver:
        months = months.withColumn("driver", F.coalesce("driver", F.lit(0.0)))
    return join_actuals(months, actuals)


def monthly_features(months: DataFrame, legacy: bool = False) -> tuple[DataFrame, list[str]]:
    """Lags, trailing means, phase interactions and season encoding; frame and feature names.

    ``months`` holds year, month, the ``monthly_index*`` columns, ``driver``, ``actual_count`` and
    an ``index_<target>`` per outcome. ``legacy`` uses month dummies and no history of the year. The
    features are the indices and the driver, and whatever the steps add to them.
    """
    own = [c for c in months.columns if c.startswith("index_")]
    given = [c for c in months.columns if c.startswith("monthly_index")] + ["driver", *own]
    df = months.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in own})
    steps = [lambda d: calendar_lag(d, ["driver", "monthly_index"]),
             lambda d: trailing_in_group(d, ["driver", "monthly_index"]), phase_interactions]
    if legacy:
        steps += [one_hot]
    else:
        steps += [lambda d: calendar_lag(d, ["actual_count"]), ytd_before, momentum, diff_in_group,
                  cyclical, lambda d: d.withColumns({f"{c}_log": log_index(c) for c in own})]
    added: list[str] = []
    for step in steps:
        before = set(df.columns)
        df = step(df)
        added += [c for c in df.columns if c not in before]
    names = [*given, *added] + ([] if legacy else ["month"])
    return sanitise(df, [*given, *added]), names


def count_features(target: str, total: str = "count", driver: str = "driver"
                   ) -> tuple[list[str], list[str]]:
    """Inputs of a target's count part and of its zero part, by role.

    A target's own index drives the count, together with the year's history and with how the index
    plays with the driver and the season; season and driver decide the zeros, and for an outcome also
    its own index.
    """
    index = "monthly_index" if target == total else f"index_{target}"
    season = [f"month_{wave}" for wave in ("sin", "cos")]
    with_driver, *with_season = (f"index_x_{c}" for c in (driver, *season))
    history = ["cumulative_ytd", "index_momentum", f"actual_{total}_lag1"]
    zeros = [*season, driver] + ([] if target == total else [index, with_driver])
    return [f"{index}_log", with_driver, *with_season, *history], zeros
