"""Monotone maps: fitted by pooling adjacent violators block by block, applied by the knots around a score.

Pools merge to the same solution in any order, so blocks of neighbouring pools are pooled as groups of one job,
then blocks shifted by half, until neither alignment changes anything. No task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer, QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.operators.windows import FIRST, HERE, running_totals
from cellcast.shared import checkpointed, small

# Pools, or distinct scores, that one task sorts.
BLOCK_ROWS = 1 << 17
# Maps of up to so many knots become parameters of the plan.
FEW_KNOTS = 10_000
_POOL = "low double, high double, total double, weight double"


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent pools whose means do not rise are merged until all rise, of pools in order."""
    ends: list[int] = []
    sums: list[float] = []
    weights: list[float] = []
    for at, (s, w) in enumerate(zip(total.tolist(), weight.tolist())):
        while ends and sums[-1] * w >= s * weights[-1]:
            s, w = s + sums.pop(), w + weights.pop()
            ends.pop()
        ends.append(at)
        sums.append(s)
        weights.append(w)
    last = np.array(ends, dtype=np.int64)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    return low[first], high[last], np.array(sums), np.array(weights)


def _pool_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low")
    return pd.DataFrame(dict(zip(("low", "high", "total", "weight"), pooled(
        *(rows[c].to_numpy(float) for c in ("low", "high", "total", "weight"))))))


def isotonic_pools(df: DataFrame, score: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pools (``low``, ``high`` score, ``total`` of labels, ``weight``) of the monotone least-squares fit.

    Equal scores are merged first, by a partial aggregate; rows without a score or a label take no part. A round
    pools blocks of ``block_rows`` neighbours; the rounds end with one block, or when two alignments agree.
    """
    known = F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()
    pools = checkpointed(df.where(known).groupBy(F.col(score).cast("double").alias("low")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count("*").cast("double").alias("weight")).select(
        "low", F.col("low").alias("high"), "total", "weight"))
    count, shift, quiet = pools.count(), 0, 0
    while quiet < 2:
        if count <= block_rows:
            return checkpointed(pools.withColumn("_block", F.lit(0)).groupBy("_block").applyInPandas(_pool_block, _POOL))
        ranked = running_totals(pools.withColumn("_one", F.lit(1)), ["_one"], order="low",
                                blocks=-(-count // block_rows) + 1)
        block = F.floor((F.col("cum__one") - 1 + shift) / block_rows)
        pools = checkpointed(ranked.withColumn("_block", block).groupBy("_block").applyInPandas(_pool_block, _POOL))
        left = pools.count()
        quiet = quiet + 1 if left == count else 0
        count, shift = left, block_rows // 2 - shift
    return pools


def isotonic_knots(df: DataFrame, score: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The fit as knots ``(x, y)``: both ends of every pool, at its mean."""
    mean = F.col("total") / F.col("weight")
    ends = F.array_distinct(F.array("low", "high"))
    return isotonic_pools(df, score, label, block_rows).select(F.explode(ends).alias("x"), mean.alias("y"))


def _between(x: Column, below: Column, above: Column) -> Column:
    rise = (above["y"] - below["y"]) * (x - below["x"]) / F.nullif(above["x"] - below["x"], F.lit(0.0))
    return F.coalesce(below["y"] + rise, below["y"], above["y"])


def _few(df: DataFrame, points: list[tuple[float, float]], score: str, out: str) -> DataFrame:
    xs, ys = (F.lit([p[i] for p in points]) for i in (0, 1))
    splits = [float("-inf"), *[p[0] for p in points], float("inf")]
    s = F.col("_score")
    found = Bucketizer(splits=splits, inputCol="_score", outputCol="_segment", handleInvalid="keep").transform(
        df.withColumn("_score", F.col(score).cast("double")))
    high = F.least(F.col("_segment").cast("int"), F.lit(len(points) - 1))
    low = F.greatest(F.col("_segment").cast("int") - 1, F.lit(0))
    x0, x1, y0, y1 = F.get(xs, low), F.get(xs, high), F.get(ys, low), F.get(ys, high)
    between = F.when(x1 > x0, y0 + (y1 - y0) * (s - x0) / F.nullif(x1 - x0, F.lit(0.0))).otherwise(y0)
    value = F.when(s.isNull() | F.isnan(s), None).when(s <= points[0][0], points[0][1]).when(
        s >= points[-1][0], points[-1][1]).otherwise(between)
    return found.withColumn(out, value).drop("_score", "_segment")


def mapped_scores(scores: DataFrame, knots: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(x, value)`` for every distinct ``x`` of ``scores``, by the knots next below and above it.

    Scores and knots lie on one line, cut into blocks by quantiles of both; a block looks for its rows' knots
    itself, and takes those beyond its ends from one row per block.
    """
    line = checkpointed(scores.select("x", F.lit(None).cast("double").alias("y"), F.lit(True).alias("asked")).unionByName(
        knots.select("x", "y", F.lit(False).alias("asked"))).groupBy("x").agg(
        F.max("y").alias("y"), F.max("asked").alias("asked")))
    blocks = max(2, -(-line.count() // block_rows))
    line = QuantileDiscretizer(numBuckets=blocks, inputCol="x", outputCol="_block", handleInvalid="keep",
                               relativeError=1.0 / (4 * blocks)).fit(line).transform(line)
    knot = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    along, over = Window.partitionBy("_block").orderBy("x"), Window.orderBy("_block")
    ends = line.groupBy("_block").agg(F.min(knot).alias("_first"), F.max(knot).alias("_last"))
    # One row per block: ``blocks`` rows in all.
    ends = ends.select(
        "_block", F.last("_last", ignorenulls=True).over(over.rowsBetween(FIRST, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    near = line.withColumns({
        "_below": F.last(knot, ignorenulls=True).over(along.rowsBetween(FIRST, HERE)),
        "_above": F.first(knot, ignorenulls=True).over(along.rowsBetween(HERE, Window.unboundedFollowing))})
    found = near.where("asked").join(small(ends), "_block")
    below, above = F.coalesce("_below", "_before"), F.coalesce("_above", "_after")
    return found.select("x", below.alias("_below"), above.alias("_above")).select(
        "x", _between(F.col("x"), F.col("_below"), F.col("_above")).alias("value"))


def apply_knots(df: DataFrame, knots: DataFrame, score: str, out: str = "calibrated", x: str = "x",
                y: str = "y", few_knots: int = FEW_KNOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Piecewise linear map given by ``knots``, constant outside their range; no or NaN score gives null.

    Knots of one x count by their mean. Up to ``few_knots`` they are parameters of the plan and each row finds its
    segment by binary search, without a shuffle. More are met on blocks of the line by the distinct scores,
    and rows take their score's value by an equi-join, whose one row per score lets a crowded score be split.
    """
    points = knots.groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(F.col(y).cast("double")).alias("y")).where(
        "x IS NOT NULL AND NOT isnan(x)")
    held = points.limit(few_knots + 1).collect()
    if not held:
        raise ValueError("a map needs a knot")
    if len(held) <= few_knots:
        return _few(df, sorted((p["x"], p["y"]) for p in held), score, out)
    own = df.withColumn("_score", F.nanvl(F.col(score).cast("double"), F.lit(None)))
    asked = own.select(F.col("_score").alias("x")).where("x IS NOT NULL").distinct()
    values = checkpointed(mapped_scores(asked, points, block_rows)).withColumnRenamed("x", "_score")
    return own.join(small(values), "_score", "left").withColumn(out, F.col("value")).drop("_score", "value")
