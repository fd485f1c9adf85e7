"""Features to calibrated cell scores: sample, split, fit, calibrate, score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.features import SPLIT_YEARS
from cellcast.operators import models
from cellcast.operators.aggregates import feature_means
from cellcast.operators.evaluate import calibration_shift, classifier_report
from cellcast.operators.sampling import NEGATIVES_PER_POSITIVE, temporal_split, undersample
from cellcast.plans.features import ALL_FEATURES
from cellcast.shared import checkpointed
from cellcast.sources.sinks import load_artifacts, save_artifacts

CELL_DAY = ("lat", "lon", "date")


@dataclass
class EventModel:
    """What scoring needs, and how well it did."""

    classifier: GBTClassificationModel
    calibrator: models.Calibrator
    means: DataFrame
    report: DataFrame | None = None
    shift: DataFrame | None = None

    def save(self, path: str) -> None:
        save_artifacts(path, {"means": self.means, "knots": self.calibrator.knots}, classifier=self.classifier)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EventModel:
        held = load_artifacts(spark, path, ("means", "knots"), classifier=GBTClassificationModel)
        return cls(held["classifier"], models.Calibrator(held["knots"]), held["means"])


def fit_events(features: DataFrame, names: Sequence[str] = ALL_FEATURES,
               key: Sequence[str] = CELL_DAY, label: str = "is_event",
               bounds: tuple[int, int] = SPLIT_YEARS, ratio: float = NEGATIVES_PER_POSITIVE,
               rounds: int = models.ROUNDS, depth: int = models.MAX_DEPTH) -> EventModel:
    """Classifier on an undersampled base, calibrated on the validation years.

    Only the sample is trained on: it is a few percent of the feature table where events are rare,
    checkpointed once because every step reads it; ``fit_classifier`` deals its rows evenly.
    ``features`` should be materialised.
    """
    keep = list(dict.fromkeys([*key, "year", *names, label]))
    base = checkpointed(undersample(features, list(key), label, ratio).select(*keep))
    train, val, test = temporal_split(base, bounds)
    means = checkpointed(feature_means(train, names))
    classifier = models.fit_classifier(train, val, names, means, label, rounds, depth)
    val_scores = checkpointed(models.raw_scores(val, classifier, names, means))
    calibrator = models.fit_calibrator(val_scores, label=label)
    held = models.raw_scores(test, classifier, names, means).select(
        F.lit("Test").alias("split"), label, "raw_prob").unionByName(
        val_scores.select(F.lit("Val").alias("split"), label, "raw_prob"))
    return EventModel(classifier, calibrator, means,
                      classifier_report(held, label, "raw_prob"),
                      calibration_shift(models.calibrate(val_scores, calibrator), "raw_prob", "prob"))


def score_events(features: DataFrame, model: EventModel, names: Sequence[str] = ALL_FEATURES,
                 keys: Sequence[str] = ("year", "month", "lat", "lon")) -> DataFrame:
    """Calibrated probability of every cell and day: a narrow pass, no shuffle."""
    return models.score(features, model.classifier, model.calibrator, names, model.means, keys)
