"""Spark ML fits: event classifier, calibration, scoring, count regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.cleaning import clamp, impute_with
from cellcast.functions.features import PROB_SOFT, soft_threshold
from cellcast.operators.monotone import BLOCK_ROWS, apply_knots, isotonic_knots
from cellcast.shared import checkpointed, value_of

# Settings of the event classifier.
MAX_DEPTH, STEP, ROUNDS, SEED = 8, 0.1, 500, 42
# Rows of one training partition (a row is some 150 to 300 bytes in memory), and the least worth a task.
TRAIN_ROWS, TASK_ROWS = 250_000, 10_000
# Fixed value: variance power of the count regression.
TWEEDIE_POWER = 1.5
# Penalty grid of the seasonal count regressions, 30 points from 1e-4 to 1e4.
PENALTY_LOG10_RANGE, PENALTY_POINTS = (-4.0, 4.0), 30


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Positives weigh negatives / positives, negatives 1."""
    counts = value_of(df.agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
                             F.count(F.when(F.col(label) == 0, 1)).alias("neg")))
    heavy = counts.getField("neg") / F.greatest(counts.getField("pos"), F.lit(1))
    return df.withColumn(out, F.when(F.col(label) == 1, heavy).otherwise(F.lit(1.0)))


def in_parts(df: DataFrame, most: int = TRAIN_ROWS, least: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt evenly over partitions of at most about ``most`` rows, however many rows there are.

    Fewer rows than fill the cores go in parts of about ``least``.
    """
    rows = df.count()
    spread = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / least))
    return df.repartition(max(1, spread, math.ceil(rows / most)))


def fit_classifier(train: DataFrame, val: DataFrame, features: Sequence[str],
                   means: DataFrame, label: str = "label", rounds: int = ROUNDS,
                   depth: int = MAX_DEPTH, step: float = STEP,
                   seed: int = SEED) -> GBTClassificationModel:
    """Boosted trees on class-weighted rows, stopped when the validation loss stops improving.

    Training stays on the executors; nothing is collected. The rows are dealt evenly first: a sample of
    a large table sits thinly in as many partitions as the table had, and boosting visits every one
    of them many times. Boosting keeps rows as objects, several times their shuffled size, so the number of
    parts follows the rows and not the bytes of a shuffle.
    """
    cols = [*features, label, "weight"]
    weighted = class_weights(train, label).select(*cols).withColumn("_val", F.lit(False))
    held = val.withColumn("weight", F.lit(1.0)).select(*cols).withColumn("_val", F.lit(True))
    rows = impute_with(weighted.unionByName(held), means, list(features))
    # Boosting reads its input for training and validation apart, several times each.
    dealt = in_parts(rows).persist()
    data = assemble(dealt, features).select(
        "features", F.col(label).cast("double").alias("label"), "weight", "_val")
    try:
        return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                             validationIndicatorCol="_val", maxIter=rounds, maxDepth=depth,
                             stepSize=step, seed=seed).fit(data)
    finally:
        dealt.unpersist()


def raw_scores(df: DataFrame, model: GBTClassificationModel, features: Sequence[str],
               means: DataFrame, out: str = "raw_prob") -> DataFrame:
    """Uncalibrated event probability; the row's own columns are kept as they are."""
    filled = {c: f"_f_{c}" for c in features}
    rows = df.withColumns({new: F.col(old) for old, new in filled.items()})
    renamed_means = means.select(*[F.col(c).alias(filled[c]) for c in features])
    vectors = assemble(impute_with(rows, renamed_means), list(filled.values()), "_features")
    model = model.copy().setFeaturesCol("_features")
    scored = model.transform(vectors)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def importances(df: DataFrame, model: GBTClassificationModel,
                names: Sequence[str]) -> DataFrame:
    """``(name, gain)`` per feature; ``df`` only supplies the session."""
    gains = [float(g) for g in model.featureImportances.toArray()]
    return df.sparkSession.createDataFrame(list(zip(names, gains)), "name string, gain double")


@dataclass(frozen=True)
class Calibrator:
    """A monotone map of scores to event rates, as a table of knots ``(x, y)``."""

    knots: DataFrame


def fit_calibrator(df: DataFrame, score: str = "raw_prob", label: str = "label",
                   block_rows: int = BLOCK_ROWS) -> Calibrator:
    """Monotone map of scores to event rates, pooled in blocks of distinct scores on the executors."""
    return Calibrator(checkpointed(isotonic_knots(df, score, label, block_rows)))


def calibrate(df: DataFrame, model: Calibrator, score: str = "raw_prob", out: str = "prob") -> DataFrame:
    """Linear between knots, constant outside."""
    return apply_knots(df, model.knots, score, out)


def score(df: DataFrame, model: GBTClassificationModel, calibrator: Calibrator,
          features: Sequence[str], means: DataFrame, keys: Sequence[str],
          soft: float = PROB_SOFT) -> DataFrame:
    """Keys, calibrated probability and its soft threshold, for every row, on the executors."""
    raw = raw_scores(df, model, features, means)
    return calibrate(raw, calibrator).select(
        *keys, "prob", soft_threshold("prob", soft).alias("prob_above_thresh"))


def _glm(family: str, reg: float, max_iter: int = 25, **kwargs) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(family=family, featuresCol="features", labelCol="y",
                                       predictionCol="prediction", regParam=reg,
                                       maxIter=max_iter, **kwargs)


def fit_tweedie(df: DataFrame, features: Sequence[str], y: str, power: float = TWEEDIE_POWER,
                reg: float = 1e-3) -> GeneralizedLinearRegressionModel:
    """Log-link Tweedie regression; negative values count as 0, rows without a value are left out."""
    known = df.filter(F.col(y).isNotNull())
    data = assemble(known.withColumn("y", F.greatest(F.col(y).cast("double"), F.lit(0.0))), features)
    return _glm("tweedie", reg, variancePower=power, linkPower=0.0).fit(data.select("features", "y"))


def predict_counts(df: DataFrame, model, features: Sequence[str],
                   out: str = "pred_count") -> DataFrame:
    """Predicted counts, clamped; the row's other columns are kept."""
    scored = model.transform(assemble(df, features))
    return scored.select(*[c for c in df.columns if c != out], clamp("prediction").alias(out))


def penalty_grid(points: int = PENALTY_POINTS) -> list[float]:
    lo, hi = PENALTY_LOG10_RANGE
    if points == 1:
        return [math.pow(10.0, (lo + hi) / 2)]
    return [math.pow(10.0, lo + (hi - lo) * i / (points - 1)) for i in range(points)]
