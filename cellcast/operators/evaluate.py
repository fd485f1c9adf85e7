"""Evaluation measures; one row, or one row per group, each from partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.features import COLD_AT, WARM_AT
from cellcast.operators.windows import running_totals, score_counts
from cellcast.shared import value_of


def mae(df: DataFrame, pairs: Sequence[tuple[str, str]], mask: Column | None = None) -> DataFrame:
    """Mean absolute error per ``(actual, predicted)`` pair, as ``mae_<predicted>``."""
    rows = df if mask is None else df.filter(mask)
    return rows.agg(*[F.avg(F.abs(F.col(a) - F.col(p))).alias(f"mae_{p}") for a, p in pairs])


def mase(df: DataFrame, train: Column, test: Column, actual: str = "actual_count",
         pred: str = "pred_count") -> DataFrame:
    """Test error over the test error of always predicting the train mean; infinite if that is 0."""
    base = value_of(df.filter(train).agg(F.avg(actual).alias("m"))).getField("m")
    errors = df.filter(test).agg(
        F.avg(F.abs(F.col(actual) - F.col(pred))).alias("mae"),
        F.avg(F.abs(F.col(actual) - base)).alias("naive_mae"))
    ratio = F.when(F.col("naive_mae") > 0, F.col("mae") / F.col("naive_mae")).otherwise(
        F.lit(float("inf")))
    return errors.withColumn("mase", ratio)


def bias_by_phase(df: DataFrame, actual: str = "actual_count", pred: str = "pred_count",
                  driver: str = "driver") -> DataFrame:
    """Summed predicted minus actual, overall and in warm, cold and neutral months."""
    error = F.col(pred) - F.col(actual)
    warm = F.coalesce(F.col(driver) >= WARM_AT, F.lit(False))
    cold = F.coalesce(F.col(driver) <= COLD_AT, F.lit(False))

    def total(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, error)), F.lit(0.0))

    return df.agg(total(F.lit(True)).alias("bias"), total(warm).alias("bias_warm"),
                  total(cold).alias("bias_cold"), total(~warm & ~cold).alias("bias_neutral"))


def tweedie_deviance(df: DataFrame, actual: str = "actual_count", pred: str = "pred_count",
                     p: float = 1.5) -> DataFrame:
    """Mean Tweedie deviance for 1 < p < 2; null when a prediction is not positive."""
    y, mu = F.col(actual).cast("double"), F.col(pred).cast("double")
    unit = 2 * (F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p))
                - y * F.pow(mu, F.lit(1 - p)) / (1 - p) + F.pow(mu, F.lit(2 - p)) / (2 - p))
    return df.agg(F.when(F.min(mu) > 0, F.avg(F.when(mu > 0, unit))).alias("tweedie_deviance"))


def annual_mae(df: DataFrame, actual: str = "actual_count", pred: str = "pred_count",
               year: str = "year") -> DataFrame:
    """Mean absolute error of the yearly sums."""
    yearly = df.groupBy(year).agg(F.sum(actual).alias("a"), F.sum(pred).alias("p"))
    return yearly.agg(F.avg(F.abs(F.col("a") - F.col("p"))).alias("annual_mae"))


def calibration_shift(df: DataFrame, raw: str, calibrated: str) -> DataFrame:
    """Mean score before and after calibration."""
    return df.agg(F.avg(raw).alias("raw_mean"), F.avg(calibrated).alias("calibrated_mean"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob",
            keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with ties counted half; null when a class is absent."""
    below = running_totals(score_counts(df, label, score, keys), ["neg"], keys)
    won = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") * 0.5)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy(*keys).agg((F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "prob",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores; null without positives."""
    above = running_totals(score_counts(df, label, score, keys), ["pos", "neg"], keys,
                           descending=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return above.groupBy(*keys).agg(
        (F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0))).alias("auprc"))


def classifier_report(df: DataFrame, label: str = "label", score: str = "prob",
                      split: str = "split") -> DataFrame:
    """``(split, metric, value)`` rows: ROC-AUC and average precision per split.

    One pass of running totals over descending scores serves both: negatives ranked below a score
    are the split's negatives minus those at or above it.
    """
    above = running_totals(score_counts(df, label, score, [split]), ["pos", "neg"], [split],
                           descending=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    lost = F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") * 0.5))
    measures = above.groupBy(split).agg(
        (F.lit(1.0) - lost / F.nullif(pos * neg, F.lit(0.0))).alias("roc_auc"),
        (F.sum(F.col("pos") * precision) / F.nullif(pos, F.lit(0.0))).alias("auprc"))
    return measures.unpivot([split], ["roc_auc", "auprc"], "metric", "value")


def precision_recall(df: DataFrame, threshold: float, label: str = "label",
                     score: str = "prob") -> DataFrame:
    """Precision and recall of ``score >= threshold``."""
    hit = F.count(F.when((F.col(score) >= threshold) & (F.col(label) == 1), 1))
    called = F.count(F.when(F.col(score) >= threshold, 1))
    actual = F.count(F.when(F.col(label) == 1, 1))
    return df.agg((hit / F.nullif(called, F.lit(0))).alias("precision"),
                  (hit / F.nullif(actual, F.lit(0))).alias("recall"))
