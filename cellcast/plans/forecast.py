"""Monthly counts per target: a walk-forward stack of two count models, all targets and folds fitted together.

Every (target, fold) is a group of one long table: its rows are the months before the fold's year. The zero-inflated
models of all groups take their rounds in the same jobs, and so do their boosted trees; the stack weights come from one
grouped pass over the out-of-fold predictions. The number of jobs does not grow with targets or folds.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.cleaning import clamp
from cellcast.operators import boosting, evaluate
from cellcast.operators.aggregates import OUTCOMES, annual_rollup
from cellcast.operators.counts import CountModel, fit_zero_inflated_groups, inputs
from cellcast.operators.joins import drop_incomplete_years
from cellcast.operators.linear import fit_stack
from cellcast.operators.newton import constant, linear_term
from cellcast.plans.monthly import count_features
from cellcast.shared import checkpointed

# Targets in report order, first and last fold year.
TARGETS = ("count", *OUTCOMES)
FOLD_YEARS = (1990, 2019)
CATEGORICAL = ("month",)
_MODEL = ("target string, counts string, weights array<double>, start double, feature array<int>, mask array<bigint>, "
          "value array<double>, gain array<double>, features array<string>, cuts array<array<double>>, "
          "categorical array<string>, depth int")


@dataclass(frozen=True)
class TargetModel:
    """A zero-inflated model, boosted trees (group ``place`` of ``trees``) and their stack weights (none when
    there was no fold to fit them on)."""

    counts: CountModel
    trees: boosting.BoostedCounts
    place: int
    weights: tuple[float, float, float] | None

    def predict(self, bins: Column) -> Column:
        boosted = boosting.predicted(self.trees, bins, self.place)
        if self.weights is None:
            return boosted
        w1, w2, b = self.weights
        return F.greatest(self.counts.predict() * w1 + boosted * w2 + b, F.lit(0.0))


def with_predictions(months: DataFrame, models: Mapping[str, TargetModel]) -> DataFrame:
    """``months`` with ``pred_<target>``: column expressions, no shuffle."""
    if not models:
        return months
    binned = next(iter(models.values())).trees.binning.binned(months, "_bins")
    return binned.withColumns({f"pred_{t}": m.predict(F.col("_bins")) for t, m in models.items()}).drop("_bins")


@dataclass
class Forecast:
    """Monthly table with ``pred_<target>``, the models, and the targets that failed and why."""

    months: DataFrame
    end: int
    models: dict[str, TargetModel] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def held_out(self, year: str = "year") -> DataFrame:
        """Only months that no model has seen."""
        return self.months.filter(F.col(year) > self.end)

    def save(self, path: str) -> None:
        """All models as one Parquet table, a row per target."""
        rows = []
        for target, m in self.models.items():
            k, b = m.place, m.trees.binning
            rows.append((target, json.dumps(m.counts.__dict__), list(m.weights) if m.weights else None,
                         m.trees.start[k], *[a[k].ravel().tolist() for a in (
                             m.trees.feature, m.trees.mask, m.trees.value, m.trees.gain)],
                         list(b.features), [list(c) for c in b.cuts], list(b.categorical), m.trees.depth))
        self.months.sparkSession.createDataFrame(rows, _MODEL).coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[str, TargetModel]:
    """What ``Forecast.save`` wrote; ``with_predictions`` applies it to new months."""
    out = {}
    for r in spark.read.parquet(path).collect():
        binning = boosting.Binning(tuple(r["features"]), tuple(map(tuple, r["cuts"])), tuple(r["categorical"]))
        shape = (1, -1, 2 ** (r["depth"] + 1) - 1)
        arrays = [np.array(r[n], dtype=t).reshape(shape) for n, t in (
            ("feature", np.int64), ("mask", np.int64), ("value", float), ("gain", float))]
        trees = boosting.BoostedCounts(binning, (), r["depth"], ((),), (r["start"],), *arrays)
        out[r["target"]] = TargetModel(CountModel(**json.loads(r["counts"])), trees, 0,
                                       tuple(r["weights"]) if r["weights"] else None)
    return {t: out[t] for t in sorted(out, key=lambda t: (TARGETS.index(t) if t in TARGETS else len(TARGETS), t))}


def forecast(months: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGETS,
             start: int = FOLD_YEARS[0], end: int = FOLD_YEARS[1], rounds: int = 40,
             trees: int = boosting.ROUNDS) -> Forecast:
    """A model per target that has a column; a target without a value up to ``end`` is recorded and skipped.

    Fold years are those in (start, end] that have rows before them; a model of fold f has seen the months before
    year f, the final one all months up to ``end``.
    """
    rows = checkpointed(months)
    named = [t for t in targets if f"actual_{t}" in rows.columns]
    values = {t: F.greatest(F.col(f"actual_{t}").cast("double"), F.lit(0.0)) for t in named}
    known = rows.filter(F.col("year") <= end).groupBy("year").agg(
        *[F.count(f"actual_{t}").alias(t) for t in named]).collect() if named else []
    out = Forecast(rows, end)
    years = {t: sorted(r["year"] for r in known if r[t]) for t in named}
    out.failed = {t: f"ValueError: {t} has no value up to {end}" for t in named if not years[t]}
    fitted = [t for t in named if years[t]]
    if not fitted:
        return out
    # Models are numbered (target, fold); the final one of a target counts as the fold after ``end``.
    folds = {t: [y for y in years[t] if y > start and y > years[t][0]] for t in fitted}
    groups = [(t, f) for t in fitted for f in [*folds[t], end + 1]]
    place = {g: k for k, g in enumerate(groups)}
    parts = {t: count_features(t) for t in fitted}
    wide = [max(len(p[k]) for p in parts.values()) for k in (0, 1)]
    per_target = F.array(*[F.struct(
        F.lit(t).alias("target"), values[t].alias("_y"), inputs(parts[t][0], wide[0]).alias("_c"),
        inputs(parts[t][1], wide[1]).alias("_i"),
        F.lit([place[t, f] for f in [*folds[t], end + 1]]).alias("_places"),
        F.lit([*folds[t], end + 1]).alias("_folds")) for t in fitted])
    used = list(dict.fromkeys(features))
    long = checkpointed(rows.select("year", *[c for c in used if c != "year"], F.inline(per_target)).where("_y IS NOT NULL"))
    each = long.select("*", F.explode(F.arrays_zip(F.col("_places").alias("g"), F.col("_folds").alias("f"))).alias("_f"))
    train = checkpointed(each.where("year < _f.f").select("*", F.col("_f.g").alias("_group")).drop("_f", "_places", "_folds"))
    counts = fit_zero_inflated_groups(train, [parts[t] for t, _ in groups], rounds)
    boosted = boosting.fit_boosted(train, used, "_y", [c for c in CATEGORICAL if c in used], ["_group"], rounds=trees)
    at = {g[0]: k for k, g in enumerate(boosted.groups)}

    weights = {}
    if any(folds.values()):
        tested = each.where(f"year = _f.f AND year <= {end}").select("*", F.col("_f.g").alias("_group"))
        oof = boosting.predict_boosted(tested, boosted, "x2").withColumn("x1", _count_prediction(counts, wide))
        found = fit_stack(oof.select("target", "x1", "x2", "_y"), "x1", "x2", "_y", by=["target"]).collect()
        weights = {r["target"]: (r["w1"], r["w2"], r["intercept"]) for r in found}
    out.models = {t: TargetModel(counts[place[t, end + 1]], boosted, at[place[t, end + 1]], weights.get(t))
                  for t in fitted}
    out.months = with_predictions(rows, out.models)
    return out


def _count_prediction(models: Sequence[CountModel], wide: Sequence[int]) -> Column:
    """Expected counts of each row's own model (``_group``), from the raw inputs ``_c`` and ``_i``."""
    def raw(names: list[str], coefficients: list[float], m: CountModel, width: int) -> list[float]:
        slopes = [b / m.scale[c] for c, b in zip(names, coefficients[1:])]
        base = coefficients[0] - sum(s * m.centre[c] for c, s in zip(names, slopes))
        return [base, *slopes, *[0.0] * (width - len(slopes))]

    live = np.array([m.kind != "zeros" for m in models]).astype(int)
    none = [[0.0] * (w + 1) for w in wide]
    beta = np.array([raw(m.count_features, m.beta, m, wide[0]) if m.kind != "zeros" else none[0] for m in models])
    gamma = np.array([raw(m.inflation_features, m.gamma, m, wide[1]) if m.kind == "zero_inflated"
                      else [-30.0, *none[1][1:]] for m in models])
    group, one = F.col("_group"), F.array(F.lit(1.0))
    mu = F.exp(linear_term(F.concat(one, "_c"), group, beta))
    pi = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_term(F.concat(one, "_i"), group, gamma)))
    structural = F.when(F.get(constant((gamma[:, 0] == -30.0).astype(int), "int"), group) == 1, 0.0).otherwise(pi)
    return F.when(F.get(constant(live, "int"), group) == 1, clamp(mu * (F.lit(1.0) - structural))).otherwise(0.0)


def held_out_report(months: DataFrame, targets: Sequence[str], end: int = FOLD_YEARS[1],
                min_months: int = 6) -> Mapping[str, DataFrame]:
    """Measures on complete years after ``end``: errors, bias by phase, deviance, yearly sums."""
    train, test = F.col("year") <= end, F.col("year") > end
    whole = drop_incomplete_years(months, min_months)
    held = whole.filter(test)
    measures = {
        "mae": evaluate.mae(held, [(f"actual_{t}", f"pred_{t}") for t in targets]),
        "annual": annual_rollup(held, targets),
    }
    if "count" in targets:
        measures |= {
            "mase": evaluate.mase(months.filter(train).unionByName(held), train, test),
            "bias": evaluate.bias_by_phase(held),
            "tweedie_deviance": evaluate.tweedie_deviance(held),
            "annual_mae": evaluate.annual_mae(held),
        }
    return measures
