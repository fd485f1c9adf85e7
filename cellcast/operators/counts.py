"""Zero-inflated negative binomial regressions by expectation-maximisation, many models at once.

A round is one job for all models (targets, folds): with the current coefficients as constants, every row gives its
posterior of a structural zero, and the job sums what one Newton step of the count part, one of the zero part, the
dispersion and the likelihood need, per model. Only systems of a few unknowns are solved outside, and models
that have settled drop out.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.cleaning import clamp, finite
from cellcast.operators.newton import constant, linear_term, moments, newton, products, symmetric
from cellcast.shared import checkpointed

log = logging.getLogger(__name__)

_ETA = 30.0
_TINY = 1e-9
_HALVINGS = 4


@dataclass
class CountModel:
    """Coefficients on standardised inputs. ``kind`` is zero_inflated, count or zeros."""

    kind: str
    count_features: list[str]
    inflation_features: list[str]
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    beta: list[float] = field(default_factory=list)
    gamma: list[float] = field(default_factory=list)
    alpha: float = 0.0
    log_likelihoods: list[float] = field(default_factory=list)
    settled: bool = True

    def _eta(self, features: Sequence[str], coef: Sequence[float]) -> str:
        terms = [_num(coef[0])] + [
            f"({_clean(c)} - {_num(self.centre[c])}) / {_num(self.scale[c])} * {_num(b)}"
            for c, b in zip(features, coef[1:])]
        return f"greatest({_num(-_ETA)}, least({_num(_ETA)}, {' + '.join(terms)}))"

    def mean(self) -> Column:
        """Expected count given that the row is not a structural zero."""
        return F.expr(f"exp({self._eta(self.count_features, self.beta)})")

    def structural(self) -> Column:
        """Probability of a structural zero."""
        if self.kind != "zero_inflated":
            return F.lit(0.0)
        return F.expr(f"1D / (1D + exp(-{self._eta(self.inflation_features, self.gamma)}))")

    def predict(self) -> Column:
        """Expected count, clamped."""
        if self.kind == "zeros":
            return F.lit(0.0)
        return clamp(self.mean() * (F.lit(1.0) - self.structural()))


# The likelihood is built as SQL text: a round needs it with new numbers, and one parsed expression is
# far cheaper to make than a few hundred Column calls.

def _num(value: float) -> str:
    return f"({float(value)!r}D)"


def _clean(name: str) -> str:
    c = f"CAST(`{name}` AS DOUBLE)"
    return f"coalesce(CASE WHEN NOT isnan({c}) AND abs({c}) <> double('Infinity') THEN {c} END, 0D)"


def _log_count() -> str:
    """Log probability of ``_y`` with mean ``_mu`` and dispersion ``_alpha`` (Poisson when it vanishes)."""
    r = "(1D / _alpha)"
    spread = (f"{log_gamma(f'(_y + {r})')} - {log_gamma(r)} - {log_gamma('(_y + 1D)')} + "
              f"{r} * ln({r} / (_mu + {r})) + _y * ln(_mu / (_mu + {r}))")
    return (f"CASE WHEN _alpha < {_num(_TINY)} THEN _y * ln(_mu) - _mu - {log_gamma('(_y + 1D)')} "
            f"ELSE {spread} END")


def log_gamma(x: str) -> str:
    """Stirling series after shifting the argument by 8; error below 1e-9 for x > 0."""
    z = f"({x} + 8D)"
    product = " * ".join(f"({x} + {i}D)" for i in range(8))
    return (f"(({z} - 0.5D) * ln({z}) - {z} + {_num(0.5 * math.log(2 * math.pi))} + 1D / (12D * {z})"
            f" - 1D / (360D * {z} * {z} * {z}) + 1D / (1260D * {z} * {z} * {z} * {z} * {z})"
            f" - ln({product}))")


def inputs(columns: Sequence[str], width: int | None = None) -> Column:
    """The columns as one array of finite numbers (missing: 0), filled up with zeros to ``width``."""
    values = [F.coalesce(finite(c), F.lit(0.0)).cast("double") for c in columns]
    return F.array(*values, *[F.lit(0.0)] * ((width or len(columns)) - len(columns)))


def _standardised(rows: DataFrame, name: str, centre: np.ndarray, scale: np.ndarray) -> Column:
    width = centre.shape[1]
    own = [F.slice(constant(a), F.col("_group") * width + 1, F.lit(width)) for a in (centre, scale)]
    moved = F.zip_with(F.zip_with(name, own[0], lambda a, b: a - b), own[1], lambda a, b: a / b)
    return F.concat(F.array(F.lit(1.0)), moved)


def _scales(rows: DataFrame, groups: int, widths: dict[str, int]) -> tuple[dict, list]:
    found = rows.groupBy("_group").agg(
        F.avg("_y").alias("my"), F.avg((F.col("_y") == 0).cast("double")).alias("zeros"),
        *[fold(F.col(name)[k]).alias(f"{kind}{name}{k}") for name, width in widths.items() for k in range(width)
          for kind, fold in (("m", F.avg), ("s", F.stddev_pop))]).collect()
    parts = {name: (np.zeros((groups, width)), np.ones((groups, width))) for name, width in widths.items()}
    for r in found:
        for name, width in widths.items():
            parts[name][0][r["_group"]] = [r[f"m{name}{k}"] for k in range(width)]
            parts[name][1][r["_group"]] = [r[f"s{name}{k}"] or 1.0 for k in range(width)]
    return parts, found


def fit_zero_inflated_groups(rows: DataFrame, names: Sequence[tuple[Sequence[str], Sequence[str]]],
                             rounds: int = 40, tol: float = 1e-5, reg: float = 1e-3) -> list[CountModel]:
    """A model for each group of ``rows``: ``_group``, ``_y``, and the raw inputs ``_c`` of the count part and ``_i``
    of the zero part as arrays of one width; ``names`` gives each group's input names.

    E(Y) = mu (1 - pi). A round that does not raise a group's likelihood is halved, and given up after a few
    halvings; a group settles when a round gains less than ``tol`` of its likelihood. A group whose values are all 0
    (or that has no row) predicts zeros; one without a zero has a count part only.
    """
    groups = len(names)
    widths = {"_c": max((len(c) for c, _ in names), default=1), "_i": max((len(i) for _, i in names), default=1)}
    rows = checkpointed(rows.select("_group", "_y", "_c", "_i"))
    scales, found = _scales(rows, groups, widths)
    mean, zeros = np.zeros(groups), np.zeros(groups)
    for r in found:
        mean[r["_group"]], zeros[r["_group"]] = r["my"], r["zeros"]
    live = mean > 0
    data = rows.where(F.get(constant(live.astype(int), "int"), F.col("_group")) == 1)
    data = checkpointed(data.withColumns({
        "_c": _standardised(rows, "_c", *scales["_c"]), "_i": _standardised(rows, "_i", *scales["_i"])}).hint("rebalance"))
    wc, wi = widths["_c"] + 1, widths["_i"] + 1
    beta = np.zeros((groups, wc))
    beta[:, 0] = np.log(np.maximum(mean, 1e-9))
    pull = np.full((groups, wc), reg)
    pull[:, 0] = 0.0
    beta = newton(data, wc, beta, lambda eta: F.exp(eta), lambda eta: F.col("_y") - F.exp(eta),
                  lambda eta: F.exp(eta) - F.col("_y") * eta, pull, x="_c", rounds=30, tol=1e-7).coefficients
    gamma, inflated = np.zeros((groups, wi)), live & (zeros > 0)
    share = np.clip(zeros / 2, 0.01, 0.99)
    gamma[:, 0] = np.where(inflated, np.log(share / (1 - share)), -_ETA)
    now = {"beta": beta, "gamma": gamma, "alpha": np.zeros(groups)}
    trial = {k: v.copy() for k, v in now.items()}
    step = {k: np.zeros_like(v) for k, v in now.items()}
    best, tries = np.full(groups, -np.inf), np.zeros(groups, dtype=int)
    likelihoods: list[list[float]] = [[] for _ in range(groups)]
    settled = ~live
    for _ in range(rounds + 1):
        if settled.all():
            break
        for r in _sums(data, trial, settled, wc, wi):
            g, n, reached = r["_group"], r["n"], r["ll"]
            if reached is None or not math.isfinite(reached) or reached <= best[g]:
                tries[g] += 1
                if tries[g] > _HALVINGS:
                    settled[g] = True
                for k in now:
                    step[k][g] /= 2
                    trial[k][g] = now[k][g] + step[k][g]
                continue
            gained, best[g], tries[g] = reached - best[g], reached, 0
            likelihoods[g].append(float(reached))
            for k in now:
                now[k][g] = trial[k][g]
            if gained < tol * abs(reached):
                settled[g] = True
                continue
            for name, width, curve, slope in (("beta", wc, r["cc"], r["cs"]), ("gamma", wi, r["ic"], r["is_"])):
                ridge = np.append(0.0, np.full(width - 1, reg))
                system = symmetric(np.array(curve) / n, width) + np.diag(ridge + 1e-9)
                step[name][g] = np.linalg.lstsq(system, np.array(slope) / n - ridge * now[name][g], rcond=None)[0]
            if not inflated[g]:
                step["gamma"][g] = 0.0
            step["alpha"][g] = (max(0.0, r["num"] / r["den"]) if r["den"] else 0.0) - now["alpha"][g]
            for k in now:
                trial[k][g] = now[k][g] + step[k][g]
    if not settled.all():
        log.warning("%d of %d count models did not settle in %d rounds", int((~settled).sum()), groups, rounds)
    out = []
    for g, (count, inflation) in enumerate(names):
        model = CountModel("zeros", list(count), list(inflation))
        if live[g]:
            model = CountModel(
                "zero_inflated" if inflated[g] else "count", list(count), list(inflation),
                *[{**dict(zip(inflation, scales["_i"][k][g].tolist())), **dict(zip(count, scales["_c"][k][g].tolist()))}
                  for k in (0, 1)], now["beta"][g, :len(count) + 1].tolist(),
                now["gamma"][g, :len(inflation) + 1].tolist(), float(now["alpha"][g]), likelihoods[g], bool(settled[g]))
        out.append(model)
    return out


def _sums(data: DataFrame, at: dict[str, np.ndarray], settled: np.ndarray, wc: int, wi: int) -> list:
    """Per open group: rows, log-likelihood, and the sums of both Newton steps and of the dispersion."""
    group = F.col("_group")
    rows = data.where(F.get(constant(settled.astype(int), "int"), group) == 0).withColumns({
        "_mu": F.exp(linear_term(F.col("_c"), group, at["beta"])),
        "_pi": F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_term(F.col("_i"), group, at["gamma"]))),
        "_alpha": F.greatest(F.get(constant(at["alpha"]), group), F.lit(0.0))})
    none = f"CASE WHEN _alpha < {_num(_TINY)} THEN -_mu ELSE ln(1D + _mu * _alpha) / -_alpha END"
    rows = rows.withColumn("_zero", F.expr(f"_pi + (1D - _pi) * exp({none})")).withColumns({
        "_z": F.expr("CASE WHEN _y = 0 THEN _pi / _zero ELSE 0D END"),
        "_ll": F.expr(f"CASE WHEN _y = 0 THEN ln(_zero) ELSE ln(1D - _pi) + {_log_count()} END")})
    share = F.expr("(1D - _z) / (1D + _mu * _alpha)")
    return rows.groupBy("_group").agg(
        F.count("*").alias("n"), F.sum("_ll").alias("ll"),
        F.array(*products("_c", wc, share * F.col("_mu"))).alias("cc"),
        F.array(*moments("_c", wc, share * (F.col("_y") - F.col("_mu")))).alias("cs"),
        F.array(*products("_i", wi, F.expr("_pi * (1D - _pi)"))).alias("ic"),
        F.array(*moments("_i", wi, F.expr("_z - _pi"))).alias("is_"),
        F.expr("sum((1D - _z) * ((_y - _mu) * (_y - _mu) - _mu))").alias("num"),
        F.expr("sum((1D - _z) * _mu * _mu)").alias("den")).collect()


def fit_zero_inflated(df: DataFrame, count_features: Sequence[str], inflation_features: Sequence[str], y: str,
                      rounds: int = 40, tol: float = 1e-5, reg: float = 1e-3) -> CountModel:
    """One model; see ``fit_zero_inflated_groups``. Negative values count as 0, rows without one are left out."""
    rows = df.filter(F.col(y).isNotNull()).select(
        F.lit(0).alias("_group"), F.greatest(F.col(y).cast("double"), F.lit(0.0)).alias("_y"),
        inputs(count_features).alias("_c"), inputs(inflation_features).alias("_i"))
    return fit_zero_inflated_groups(rows, [(list(count_features), list(inflation_features))], rounds, tol, reg)[0]


def predict_zero_inflated(df: DataFrame, model: CountModel, out: str = "pred") -> DataFrame:
    return df.withColumn(out, model.predict())
