"""Boosted trees for counts: histograms, a Tweedie loss on a log link, any number of models at once.

Every row keeps its features as bin numbers. A level of a tree is one grouped job over (model, node, feature, bin)
that sums gradient, curvature and rows: partial aggregates, so what is shuffled is bounded by the bins, not by the
rows. Splits are searched in those sums, one group per model and node; a leaf's value is a Newton step. Models
(targets, folds) differ only in a key of the rows, so hundreds are grown by the same jobs as one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.cleaning import clamp
from cellcast.operators.newton import constant
from cellcast.shared import checkpointed

# Variance power; leaves of at least so many rows; share of features a tree may use.
POWER, MIN_ROWS, FEATURE_SHARE, SEED = 1.5, 25, 0.8, 42
# Trees of up to eight leaves. Rounds times step is 3, the total step of many slower rounds.
DEPTH, ROUNDS, STEP = 3, 20, 0.15
# Bins of a feature, the one for missing values included; a side of a split is a 64-bit mask of bins.
BINS = 63
# Rows are written with their current score after so many trees; until then those trees are walked again.
REFRESH = 10
# Sums of one level that are searched on the driver; more are searched in a task per model and node.
FEW_SUMS = 200_000
_RIDGE, _ETA = 1e-6, 30.0
_SPLITS = ("_boosted int, _node int, gain double, feature int, mask bigint, here double, left double, right double")
_MODELS = "group int, start double, feature array<int>, mask array<bigint>, value array<double>, gain array<double>"


@dataclass(frozen=True)
class Binning:
    """How a value becomes a bin: cuts of a numeric feature, or the values of a categorical one."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    categorical: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> Binning:
        """Quantile cuts over all rows (a mergeable sketch); categories by frequency, then by value. Beyond
        ``BINS - 1`` categories the rarest share the bin of unknown values."""
        numeric = [c for c in features if c not in categorical]
        shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
        clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in numeric])
        found = dict(zip(numeric, clean.approxQuantile(numeric, shares, 0.002))) if numeric else {}
        for c in categorical:
            most = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).count()
            found[c] = [r["v"] for r in most.orderBy(F.desc("count"), "v").limit(BINS - 1).collect()]
        cuts = [tuple(sorted(v for v in set(found[c]) if abs(v) < float("inf"))) for c in features]
        return cls(tuple(features), tuple(cuts), tuple(categorical))

    def binned(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with ``out``, the bins of its features in order; a missing or unknown value has the last."""
        numeric = [(f"_{out}_{k}", c, cuts) for k, (c, cuts) in enumerate(zip(self.features, self.cuts))
                   if c not in self.categorical]
        df = df.withColumns({n: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for n, c, _ in numeric})
        if numeric:
            df = Bucketizer(inputCols=[n for n, _, _ in numeric], outputCols=[f"{n}_b" for n, _, _ in numeric],
                            splitsArray=[[float("-inf"), *(cuts or [0.0]), float("inf")] for _, _, cuts in numeric],
                            handleInvalid="keep").transform(df)
        bins = []
        for k, (c, cuts) in enumerate(zip(self.features, self.cuts)):
            if c in self.categorical:
                place = F.array_position(F.lit(list(cuts)), F.col(c).cast("double")) if cuts else F.lit(0)
                bins.append(F.coalesce(F.nullif(place, F.lit(0)).cast("int") - 1, F.lit(BINS - 1)))
            else:
                bins.append(F.when(F.isnan(f"_{out}_{k}"), F.lit(BINS - 1)).otherwise(
                    F.col(f"_{out}_{k}_b").cast("int")))
        return df.withColumn(out, F.array(*bins)).drop(*[n for n, _, _ in numeric], *[f"{n}_b" for n, _, _ in numeric])


@dataclass(frozen=True)
class BoostedCounts:
    """Models by group (values of ``by``): start score and trees as flat arrays of ``2 ** (depth + 1) - 1`` slots."""

    binning: Binning
    by: tuple[str, ...]
    depth: int
    groups: tuple[tuple, ...]
    start: tuple[float, ...]
    feature: np.ndarray  # (groups, trees, slots); -1 marks a leaf
    mask: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a model: the flat arrays."""
        rows = [(k, float(s), self.feature[k].ravel().tolist(), self.mask[k].ravel().tolist(),
                 self.value[k].ravel().tolist(), self.gain[k].ravel().tolist()) for k, s in enumerate(self.start)]
        return spark.createDataFrame(rows, _MODELS)

    def importance(self) -> dict[str, float]:
        """Total gain of each feature."""
        return {c: float(self.gain[self.feature == k].sum()) for k, c in enumerate(self.binning.features)}


def _fields(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def _walked(bins: Column, group: Column, feature: np.ndarray, mask: np.ndarray, value: np.ndarray, depth: int,
            start: Column) -> Column:
    """``start`` plus the values of the leaves that a row's bins lead to in its group's trees."""
    trees, slots = feature.shape[1:]
    if not trees:
        return start
    features, masks, values = constant(feature, "int"), constant(mask, "bigint"), constant(value)

    def leaf(base: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            split = F.get(features, base + node)
            right = F.lit(1) - F.getbit(F.get(masks, base + node), F.get(bins, F.greatest(split, F.lit(0)))).cast("int")
            return F.when(split >= 0, node * 2 + 1 + right).otherwise(node)
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)

    bases = F.sequence(group * (trees * slots), group * (trees * slots) + (trees - 1) * slots, F.lit(slots))
    return F.aggregate(bases, start, lambda total, base: total + F.get(values, base + leaf(base)))


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, categorical: np.ndarray, allowed: np.ndarray,
                min_rows: int = MIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node (first axis) the gain, feature and left bins of its best split; sums are (node, feature, bin).

    Bins of a categorical feature are first put in the order of their own Newton steps.
    """
    total = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    order = np.broadcast_to(np.arange(g.shape[2]), g.shape).copy()
    step = np.where(h > 0, g / (h + _RIDGE), np.inf)
    order[:, categorical] = np.argsort(step[:, categorical], axis=2, kind="stable")
    gl, hl, nl = (np.cumsum(np.take_along_axis(a, order, axis=2), axis=2) for a in (g, h, n))
    rows = nl[:, :, -1:]
    gain = gl ** 2 / (hl + _RIDGE) + (total[0] - gl) ** 2 / (total[1] - hl + _RIDGE) - total[0] ** 2 / (
        total[1] + _RIDGE)
    fits = (nl >= min_rows) & (rows - nl >= min_rows) & allowed[None, :, None]
    # Sums differ in their last digits with the order of partial sums; equal gains must not be told apart by them.
    gain = np.where(fits, np.round(gain / (np.abs(gain).max(axis=(1, 2), keepdims=True) + 1e-300), 9)
                    * np.abs(gain).max(axis=(1, 2), keepdims=True), -np.inf)
    flat = gain.reshape(len(g), -1)
    at = flat.argmax(axis=1)
    best, feature, cut = flat[np.arange(len(g)), at], at // g.shape[2], at % g.shape[2]
    left = np.zeros(len(g), dtype=np.int64)
    for k in np.flatnonzero(best > 0):
        for b in order[k, feature[k], :cut[k] + 1]:
            left[k] |= np.int64(1) << np.int64(b)
    return best, feature, left


def _splits(kinds: np.ndarray, allowed: np.ndarray, min_rows: int):
    def split(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        """The best split of one node and the Newton steps of the node and of both sides."""
        g, h, n = (np.zeros((1, len(kinds), BINS)) for _ in range(3))
        place = (0, sums["_feature"].to_numpy(), sums["_bin"].to_numpy())
        g[place], h[place], n[place] = sums["g"], sums["h"], sums["n"]
        best, feature, left = best_splits(g, h, n, kinds, allowed, min_rows)
        side = (left[0] >> np.arange(BINS)) & 1 == 1
        steps = [-g[0, feature[0], part].sum() / (h[0, feature[0], part].sum() + _RIDGE)
                 for part in (side | True, side, ~side)]
        return pd.DataFrame([[*key, best[0], feature[0], left[0], *steps]], columns=[
            "_boosted", "_node", "gain", "feature", "mask", "here", "left", "right"])
    return split


def fit_boosted(df: DataFrame, features: Sequence[str], y: str, categorical: Sequence[str] = (),
                by: Sequence[str] = (), power: float = POWER, rounds: int = ROUNDS, step: float = STEP,
                depth: int = DEPTH, min_rows: int = MIN_ROWS, feature_share: float = FEATURE_SHARE,
                seed: int = SEED, binning: Binning | None = None) -> BoostedCounts:
    """Boosted trees for ``y`` per group of ``by``. Negative values count as 0; rows without a value are left out.

    Bins are those of all rows, shared by the groups. A group whose values are all 0 predicts (nearly) 0. What
    reaches the driver per level is at most ``FEW_SUMS`` sums, or else one split per group and node.
    """
    by, spark, slots = list(by), df.sparkSession, 2 ** (depth + 1) - 1
    known = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    binning = binning or Binning.of(known, features, categorical)
    rows = binning.binned(known.select(*by, *dict.fromkeys(features), F.greatest(
        F.col(y).cast("double"), F.lit(0.0)).alias("_y")), "_bins").select(*by, "_y", "_bins")
    means = rows.groupBy(*by).agg(F.avg("_y").alias("_mean"))
    means = (means.orderBy(*by) if by else means).collect()
    means = [r for r in means if r["_mean"] is not None]
    if not means:
        raise ValueError(f"{y} has no value")
    groups = tuple(tuple(r[c] for c in by) for r in means)
    start = np.log(np.maximum([r["_mean"] for r in means], 1e-9))
    if by:
        starts = spark.createDataFrame([(*g, k, float(s)) for k, (g, s) in enumerate(zip(groups, start))],
                                       ", ".join([*_fields(df, by), "_boosted int", "_score double"]))
        placed = rows.join(F.broadcast(starts), [rows[c].eqNullSafe(starts[c]) for c in by])
    else:
        placed = rows.withColumns({"_boosted": F.lit(0), "_score": F.lit(float(start[0]))})
    data = checkpointed(placed.select("_boosted", "_y", "_bins", "_score").hint("rebalance"))
    random = np.random.default_rng(seed)
    kinds = np.array([c in binning.categorical for c in binning.features])
    shape = (len(groups), rounds, slots)
    feature, mask = np.full(shape, -1, dtype=np.int64), np.zeros(shape, dtype=np.int64)
    value, gains = np.zeros(shape), np.zeros(shape)

    places = np.broadcast_to(np.arange(float(slots)), (len(groups), 1, slots))

    def scored(first: int, last: int, tree: int | None) -> DataFrame:
        """Rows with the score after trees before ``last``, and with ``tree`` the node they are at."""
        walk = [F.col("_bins"), F.col("_boosted")]
        used = [a[:, first:last] for a in (feature, mask, value)]
        rows = data.withColumn("_score", _walked(*walk, *used, depth, F.col("_score")))
        if tree is None:
            return rows
        own = feature[:, tree:tree + 1], mask[:, tree:tree + 1]
        return rows.withColumn("_node", _walked(*walk, *own, places, depth, F.lit(0.0)).cast("int"))

    low, high = F.lit(-_ETA), F.lit(_ETA)
    first = 0
    for tree in range(rounds):
        if tree - first == REFRESH:
            data, first = checkpointed(scored(first, tree, None)), tree
        allowed = np.zeros(len(kinds), dtype=bool)
        allowed[random.permutation(len(kinds))[:max(1, round(feature_share * len(kinds)))]] = True
        for level in range(depth):
            begin, count = 2 ** level - 1, 2 ** level
            at = scored(first, tree, tree).where(F.col("_node").between(begin, begin + count - 1))
            score = F.greatest(low, F.least(high, F.col("_score")))
            less, more = F.col("_y") * F.exp(score * (1 - power)), F.exp(score * (2 - power))
            sums = at.select("_boosted", "_node", (more - less).alias("_g"),
                             ((2 - power) * more - (1 - power) * less).alias("_h"),
                             F.posexplode("_bins").alias("_feature", "_bin")).groupBy(
                "_boosted", "_node", "_feature", "_bin").agg(
                F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count("*").alias("n"))
            grows = False
            split = _splits(kinds, allowed, min_rows)
            if len(groups) * count * len(kinds) * BINS <= FEW_SUMS:
                found = [split(key, part) for key, part in sums.toPandas().groupby(["_boosted", "_node"])]
                found = pd.concat(found).to_dict("records") if found else []
            else:
                found = sums.groupBy("_boosted", "_node").applyInPandas(split, _SPLITS).collect()
            for r in found:
                at = (r["_boosted"], tree, r["_node"])
                if level == 0:
                    value[at] = step * r["here"]
                if r["gain"] > 1e-12:
                    grows = True
                    feature[at], mask[at], gains[at] = r["feature"], r["mask"], r["gain"]
                    value[r["_boosted"], tree, 2 * r["_node"] + 1] = step * r["left"]
                    value[r["_boosted"], tree, 2 * r["_node"] + 2] = step * r["right"]
            if not grows:
                break
    return BoostedCounts(binning, tuple(by), depth, groups, tuple(start.tolist()), feature, mask, value, gains)


def _count(score: Column) -> Column:
    return clamp(F.exp(F.greatest(F.lit(-_ETA), F.least(F.lit(_ETA), score))))


def predicted(model: BoostedCounts, bins: Column, group: int = 0) -> Column:
    """Counts that one group's model gives to rows with ``bins``, clamped."""
    own = [a[group:group + 1] for a in (model.feature, model.mask, model.value)]
    return _count(_walked(bins, F.lit(0), *own, model.depth, F.lit(model.start[group])))


def predict_boosted(df: DataFrame, model: BoostedCounts, out: str = "pred") -> DataFrame:
    """``df`` with the predicted counts, clamped; rows of a group without a model get null."""
    columns = [c for c in df.columns if c != out]
    binned = model.binning.binned(df, "_bins")
    if model.by:
        starts = df.sparkSession.createDataFrame(
            [(*g, k, s) for k, (g, s) in enumerate(zip(model.groups, model.start))],
            ", ".join([*_fields(df, model.by), "_boosted int", "_start double"]))
        same = [binned[c].eqNullSafe(starts[c]) for c in model.by]
        binned = binned.join(F.broadcast(starts), same, "left").select(binned["*"], "_boosted", "_start")
    else:
        binned = binned.withColumns({"_boosted": F.lit(0), "_start": F.lit(model.start[0])})
    score = _walked(F.col("_bins"), F.col("_boosted"), model.feature, model.mask, model.value, model.depth, F.col("_start"))
    return binned.withColumn(out, F.when(F.col("_start").isNotNull(), _count(score))).select(*columns, out)


def deviance(df: DataFrame, y: str, pred: str, power: float = POWER, by: Sequence[str] = ()) -> DataFrame:
    """Mean Tweedie deviance of positive predictions, per group."""
    y_, m = F.col(y).cast("double"), F.greatest(F.col(pred), F.lit(1e-9))
    part = 2 * (F.pow(y_, 2 - power) / ((1 - power) * (2 - power)) - y_ * F.pow(m, 1 - power) / (1 - power)
                + F.pow(m, 2 - power) / (2 - power))
    return df.where(y_.isNotNull()).groupBy(*by).agg(F.avg(part).alias("deviance"))
