"""Poisson regression per season with a cross-validated penalty; all fits step together over grouped sums."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.cleaning import clamp, finite
from cellcast.functions.dates import season
from cellcast.operators.models import PENALTY_POINTS, penalty_grid
from cellcast.operators.newton import constant, linear_term, newton
from cellcast.operators.windows import numbered
from cellcast.shared import checkpointed

log = logging.getLogger(__name__)
_ETA = 30.0


@dataclass(frozen=True)
class PoissonFit:
    """exp(intercept + sum of coefficient times feature), clamped; the penalty and its held-out error."""

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    penalty: float
    error: float

    def predict(self) -> Column:
        eta = F.lit(self.intercept)
        for name, b in zip(self.features, self.coefficients):
            eta = eta + F.coalesce(finite(name), F.lit(0.0)) * F.lit(b)
        return clamp(F.exp(F.greatest(F.lit(-_ETA), F.least(F.lit(_ETA), eta))))


def _folds(rows: DataFrame, order: Sequence[str], folds: int) -> DataFrame:
    """Contiguous folds of each season by ``order`` as ``ntile`` makes them, without sorting a season in one task."""
    ranked = numbered(rows, ["_season"], [*order, "_tie"], order[0], "_no")
    sizes = rows.groupBy("_season").agg(F.count("*").alias("_n"))
    at, short, longer = F.col("_no") - 1, F.floor(F.col("_n") / folds), F.col("_n") % folds
    late = longer + F.floor((at - longer * (short + 1)) / F.greatest(short, F.lit(1)))
    fold = F.when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(late)
    return ranked.join(F.broadcast(sizes), "_season").select("_season", "_y", "_x", fold.cast("int").alias("_fold"))


def _ridge(rows: DataFrame, groups: int, width: int, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intercept and coefficients per group of ``rows`` (``_group``, ``_y``, ``_x``), and which groups settled.

    The mean Poisson loss plus half the penalty times the squared coefficients of the standardised inputs.
    """
    sums = rows.groupBy("_group").agg(F.avg("_y").alias("y"), *[
        fold(F.col("_x")[k]).alias(f"{name}{k}") for k in range(width)
        for name, fold in (("m", F.avg), ("s", F.stddev_pop))]).collect()
    centre, scale = np.zeros((groups, width)), np.ones((groups, width))
    start = np.zeros((groups, width + 1))
    for r in sums:
        g = r["_group"]
        centre[g] = [r[f"m{k}"] for k in range(width)]
        scale[g] = [r[f"s{k}"] if r[f"s{k}"] > 1e-12 else 1.0 for k in range(width)]
        start[g, 0] = np.log(max(r["y"], 1e-9))
    own = [F.slice(constant(a), F.col("_group") * width + 1, F.lit(width)) for a in (centre, scale)]
    moved = F.zip_with(F.zip_with("_x", own[0], lambda a, b: a - b), own[1], lambda a, b: a / b)
    pull = np.repeat(penalties[:, None], width + 1, axis=1)
    pull[:, 0] = 0.0
    fits = newton(rows.withColumn("_x", F.concat(F.array(F.lit(1.0)), moved)), width + 1, start,
                  lambda eta: F.exp(eta), lambda eta: F.col("_y") - F.exp(eta),
                  lambda eta: F.exp(eta) - F.col("_y") * eta, pull)
    raw = fits.coefficients[:, 1:] / scale
    return np.column_stack((fits.coefficients[:, 0] - (raw * centre).sum(axis=1), raw)), fits.settled


def fit_seasonal_poisson(df: DataFrame, features: Sequence[str], y: str, folds: int = 3,
                         points: int = PENALTY_POINTS, month: str = "month",
                         order: Sequence[str] = ("year", "month")) -> dict[str, PoissonFit]:
    """One Poisson regression per season; the penalty is chosen by absolute error on contiguous folds.

    All fits (season, left-out fold, penalty) take their Newton steps together: a step is one job of sums over the
    rows, whether a row is a month or a cell and day. What reaches the driver is sums and errors per fit.
    Ties go to the smaller penalty; rows without a value are left out; a season without rows has no model.
    """
    grid, names = penalty_grid(points), tuple(features)
    inputs = F.array(*[F.coalesce(finite(c), F.lit(0.0)).cast("double") for c in names])
    rows = df.filter(F.col(y).isNotNull()).select(
        season(month).alias("_season"), *order, F.greatest(F.col(y).cast("double"), F.lit(0.0)).alias("_y"),
        inputs.alias("_x"), F.xxhash64(y, *names).alias("_tie"))
    rows = checkpointed(_folds(checkpointed(rows), order, folds))
    seasons = [r[0] for r in rows.select("_season").distinct().orderBy("_season").collect()]
    if not seasons:
        return {}
    number = F.array_position(F.lit(seasons), F.col("_season")).cast("int") - 1
    left_out = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    place = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))

    def group(fold: Column) -> Column:
        return (F.col("_s") * folds + fold) * points + F.col("_place")

    numbers = rows.withColumn("_s", number)
    trained = numbers.withColumn("_out", left_out).where("_out <> _fold").withColumn("_place", place).select(
        group(F.col("_out")).alias("_group"), "_y", "_x")
    count = len(seasons) * folds * points
    penalties = np.tile(grid, len(seasons) * folds)
    beta, settled = _ridge(trained, count, len(names), penalties)
    if not settled.all():
        log.warning("%d of %d seasonal fits did not settle", int((~settled).sum()), count)
    known = {r[0] for r in trained.select("_group").distinct().collect()}
    tested = numbers.withColumn("_place", place).select(
        "_s", "_place", group(F.col("_fold")).alias("_group"), "_y",
        F.concat(F.array(F.lit(1.0)), "_x").alias("_x"))
    eta = linear_term(F.col("_x"), F.col("_group"), beta)
    errors = tested.withColumn("_miss", F.abs(F.exp(eta) - F.col("_y"))).groupBy("_s", "_place", "_group").agg(
        F.sum("_miss").alias("miss"), F.count("*").alias("n")).collect()
    miss, seen = np.zeros((len(seasons), points)), np.zeros((len(seasons), points))
    for r in errors:
        if r["_group"] in known:
            miss[r["_s"], r["_place"]] += r["miss"]
            seen[r["_s"], r["_place"]] += r["n"]
    error = miss / np.maximum(seen, 1)
    best = error.argmin(axis=1)
    final, _ = _ridge(numbers.select(F.col("_s").alias("_group"), "_y", "_x"), len(seasons), len(names),
                      np.array(grid)[best])
    return {name: PoissonFit(names, float(final[k, 0]), tuple(final[k, 1:].tolist()), grid[best[k]],
                             float(error[k, best[k]])) for k, name in enumerate(seasons)}


def predict_seasonal(df: DataFrame, fitted: dict[str, PoissonFit], out: str = "pred_count",
                     month: str = "month") -> DataFrame:
    """Seasonal predictions, never below 0; a season without a model predicts 0."""
    value = F.lit(0.0)
    for name, fit in fitted.items():
        value = F.when(season(month) == name, F.greatest(fit.predict(), F.lit(0.0))).otherwise(value)
    return df.withColumn(out, value)
