import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellcast.operators import boosting, models


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x, z, month = rng.uniform(-2, 2, n), rng.uniform(-1, 1, n), rng.integers(1, 13, n)
    mean = np.exp(0.5 * np.sin(2.5 * x) + 0.8 * (z > 0.2) * (x > 0) + 0.7 * np.isin(month, (7, 8, 9, 10)))
    y = rng.poisson(mean * rng.gamma(2, 0.5, n)).astype(float)
    frame = pd.DataFrame({"x": x, "z": z, "month": month, "y": y, "part": np.arange(n) % 3})
    return spark.createDataFrame(frame).withColumn("x", F.when(F.col("x") < 1.95, F.col("x"))).repartition(4)


def test_held_out_deviance_is_below_that_of_the_linear_model(series):
    train, test = series.where("part < 2"), series.where("part = 2")
    model = boosting.fit_boosted(train, ["x", "z", "month"], "y", ["month"], rounds=12, step=0.25)
    scored = boosting.predict_boosted(test, model)
    assert scored.columns == [*test.columns, "pred"] and scored.where("pred IS NULL OR pred < 0").count() == 0
    filled = series.fillna(0.0, subset=["x"])
    glm = models.fit_tweedie(filled.where("part < 2"), ["x", "z", "month"], "y")
    linear = models.predict_counts(filled.where("part = 2"), glm, ["x", "z", "month"], "pred")
    boosted, plain = (boosting.deviance(d, "y", "pred").first().deviance for d in (scored, linear))
    assert boosted < plain - 0.1
    assert sum(model.importance().values()) > 0


def test_groups_are_models_of_their_own(series):
    rows = series.withColumn("part", F.when(F.col("part") < 2, F.col("part")))
    binning = boosting.Binning.of(rows, ["x", "z", "month"], ["month"])
    settings = {"categorical": ["month"], "rounds": 2, "feature_share": 1.0, "binning": binning}
    together = boosting.fit_boosted(rows, ["x", "z", "month"], "y", by=["part"], **settings)
    assert together.groups == ((None,), (0,), (1,))
    for k, part in enumerate((None, 0, 1)):
        alone = boosting.fit_boosted(rows.where(F.col("part").eqNullSafe(F.lit(part))), ["x", "z", "month"], "y",
                                     **settings)
        assert (alone.feature[0] == together.feature[k]).all() and (alone.mask[0] == together.mask[k]).all()
        assert np.allclose(alone.value[0], together.value[k])
    scored = boosting.predict_boosted(rows.unionByName(rows.limit(1).withColumn("part", F.lit(9))), together)
    assert scored.where("pred IS NULL").select("part").collect() == [(9,)]


def test_split_is_the_best_of_all(series):
    """Every cut of an ordered feature, and every subset of a categorical one."""
    rng = np.random.default_rng(3)
    n = rng.integers(0, 20, (5, 2, boosting.BINS)).astype(float)
    n[:, :, 7:] = 0
    n[:, 1] *= n[:, :1].sum(axis=2) / np.maximum(n[:, 1:].sum(axis=2), 1)
    g, h = rng.normal(size=n.shape) * n, rng.uniform(0.5, 2, n.shape) * n
    g[:, 1] *= (g[:, 0].sum(axis=1) / g[:, 1].sum(axis=1))[:, None]
    h[:, 1] *= (h[:, 0].sum(axis=1) / h[:, 1].sum(axis=1))[:, None]
    kinds = np.array([False, True])
    gain, feature, left = boosting.best_splits(g, h, n, kinds, np.array([True, True]), 5)

    def worth(k, f, bins):
        inside = np.isin(np.arange(boosting.BINS), bins)
        part = lambda a: (a[k, f, inside].sum(), a[k, f, ~inside].sum())
        (gl, gr), (hl, hr), (nl, nr) = part(g), part(h), part(n)
        if nl < 5 or nr < 5:
            return -np.inf
        return gl ** 2 / hl + gr ** 2 / hr - (gl + gr) ** 2 / (hl + hr)

    for k in range(5):
        cuts = [(0, tuple(range(c))) for c in range(1, 7)] + [
            (1, s) for size in range(1, 7) for s in itertools.combinations(range(7), size)]
        best = max(worth(k, f, s) for f, s in cuts)
        assert gain[k] == pytest.approx(best, rel=1e-5)
        chosen = [b for b in range(boosting.BINS) if left[k] >> b & 1]
        assert worth(k, feature[k], chosen) == pytest.approx(best, rel=1e-5)


def test_odd_values(spark):
    rows = [(None, None, 1.0), (float("nan"), 3, 2.0), (1.0, 3, -5.0), (2.0, None, None), (2.0, 4, float("nan"))]
    df = spark.createDataFrame(rows * 30, "x double, c int, y double")
    model = boosting.fit_boosted(df, ["x", "c"], "y", ["c"], rounds=2)
    assert boosting.predict_boosted(df, model).where("pred IS NULL").count() == 0
    with pytest.raises(ValueError):
        boosting.fit_boosted(df.where("y IS NULL"), ["x", "c"], "y", ["c"], rounds=2)
