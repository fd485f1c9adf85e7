"""Regressions of many groups at once by Newton steps over sums.

Every row carries the number of its model and its inputs as an array. A step is one grouped job: with the current
coefficients as constants of the plan, each row gives a weight, a residual and its part of the loss, and the job
sums weight times input products, residual times inputs, and the loss per model: partial aggregates, whatever
the rows. Only the small systems of the models are solved outside, and models that have settled drop out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ETA = 30.0


def constant(values: np.ndarray, kind: str = "double") -> Column:
    """Numbers as one constant array of the plan, made in one call whatever their count."""
    return F.split(F.lit(",".join(map(repr, np.asarray(values).ravel().tolist()))), ",").cast(f"array<{kind}>")


def linear_term(x: Column, group: Column, coefficients: np.ndarray) -> Column:
    """Inner product of ``x`` with its group's row of ``coefficients``, held within +-30."""
    width = coefficients.shape[1]
    own = F.slice(constant(coefficients), group * width + 1, F.lit(width))
    total = F.aggregate(F.zip_with(x, own, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-ETA), F.least(F.lit(ETA), total))


def products(x: str, width: int, weight: Column) -> list[Column]:
    """Sums of ``weight * x[i] * x[j]`` for i <= j."""
    return [F.sum(weight * F.col(x)[i] * F.col(x)[j]) for i in range(width) for j in range(i, width)]


def moments(x: str, width: int, residual: Column) -> list[Column]:
    return [F.sum(residual * F.col(x)[i]) for i in range(width)]


def symmetric(flat: Sequence[float], width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = flat
    return out + np.triu(out, 1).T


@dataclass
class Fits:
    """Coefficients (group, input), the loss of each group, and which groups settled."""

    coefficients: np.ndarray
    loss: np.ndarray
    settled: np.ndarray


def newton(rows: DataFrame, width: int, start: np.ndarray, weight: Callable[[Column], Column],
           residual: Callable[[Column], Column], loss: Callable[[Column], Column], penalty: np.ndarray,
           group: str = "_group", x: str = "_x", rounds: int = 60, tol: float = 1e-9) -> Fits:
    """Minimises mean ``loss`` plus half ``penalty`` times the squared coefficients, per group of ``rows``.

    ``weight``, ``residual`` (minus the loss's slope) and ``loss`` are given the linear term. A step that does not
    lower a group's loss is halved; a group whose loss no longer falls by ``tol`` has settled.
    """
    count = len(start)
    best, trial = start.copy(), start.copy()
    lowest, settled = np.full(count, np.inf), np.zeros(count, dtype=bool)
    step, size = np.zeros_like(start), np.ones(count)
    triangle = width * (width + 1) // 2
    for _ in range(rounds):
        open_ = np.flatnonzero(~settled)
        if not len(open_):
            break
        eta = F.col("_eta")
        held = rows if len(open_) == count else rows.where(F.get(constant(settled.astype(int), "int"), F.col(group)) == 0)
        sums = held.withColumn("_eta", linear_term(F.col(x), F.col(group), trial)).groupBy(group).agg(
            F.count("*").alias("n"), F.sum(loss(eta)).alias("loss"),
            F.array(*products(x, width, weight(eta))).alias("curve"),
            F.array(*moments(x, width, residual(eta))).alias("slope")).collect()
        seen = np.zeros(count, dtype=bool)
        for r in sums:
            g, n = r[group], r["n"]
            seen[g] = True
            reached = r["loss"] / n + 0.5 * float((penalty[g] * trial[g] ** 2).sum())
            if not np.isfinite(reached) or reached > lowest[g]:
                size[g] /= 2
                if size[g] < 1e-6:
                    settled[g] = True
                trial[g] = best[g] + size[g] * step[g]
                continue
            gained, lowest[g], best[g] = lowest[g] - reached, reached, trial[g].copy()
            if gained <= tol * max(1.0, abs(reached)):
                settled[g] = True
                continue
            curve = symmetric(np.array(r["curve"][:triangle]) / n, width) + np.diag(penalty[g] + 1e-12)
            slope = np.array(r["slope"]) / n - penalty[g] * best[g]
            step[g], size[g] = np.linalg.lstsq(curve, slope, rcond=None)[0], 1.0
            trial[g] = best[g] + step[g]
        settled |= ~seen & ~settled
    return Fits(best, lowest, settled)
