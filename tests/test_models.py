import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellcast.operators import linear, models, monotone
from cellcast.operators.aggregates import feature_means
from cellcast.operators.batches import score_batches
from cellcast.operators.counts import fit_zero_inflated, log_gamma, predict_zero_inflated
from cellcast.operators.sampling import temporal_split
from cellcast.operators.seasonal import fit_seasonal_poisson, predict_seasonal


def brute_ridge(x, y, alpha):
    best = None
    xc, yc = x - x.mean(0), y - y.mean()
    for active in itertools.chain([()], [(0,), (1,), (0, 1)]):
        w = np.zeros(2)
        if active:
            a = xc[:, active]
            w[list(active)] = np.linalg.solve(a.T @ a + alpha * np.eye(len(active)), a.T @ yc)
        if (w >= 0).all():
            loss = ((yc - xc @ w) ** 2).sum() + alpha * (w ** 2).sum()
            if best is None or loss < best[0] - 1e-12:
                best = (loss, w)
    w = best[1]
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize("signs", [(1, 1), (1, -1), (-1, 1), (-1, -1)])
def test_nonneg_ridge_against_brute_force(spark, signs):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2)) * [2.0, 1.0]
    x[:, 1] += 0.5 * x[:, 0]
    y = signs[0] * x[:, 0] + 0.7 * signs[1] * x[:, 1] + rng.normal(size=60)
    df = spark.createDataFrame([tuple(map(float, (*a, b))) for a, b in zip(x, y)],
                               "x1 double, x2 double, y double")
    got = linear.fit_stack(df, "x1", "x2", "y").first()
    w, b = brute_ridge(x, y, 1.0)
    assert (got.w1, got.w2, got.intercept) == pytest.approx((w[0], w[1], b), abs=1e-9)


def test_knots_clip_and_interpolate(spark):
    knots = spark.createDataFrame([(0.8, 1.0), (0.2, 0.0), (0.5, 0.1)], "x double, y double")
    df = spark.createDataFrame([(0.0,), (0.2,), (0.35,), (0.5,), (0.65,), (0.9,), (None,)], "s double")
    for few in (monotone.FEW_KNOTS, 0):
        got = {r.s: r.calibrated for r in monotone.apply_knots(df, knots, "s", few_knots=few).collect()}
        assert [got[k] for k in (0.0, 0.2, 0.35, 0.5, 0.65, 0.9)] == pytest.approx([0.0, 0.0, 0.05, 0.1, 0.55, 1.0])
        assert got[None] is None
        one = monotone.apply_knots(df, knots.filter("x = 0.5"), "s", few_knots=few).collect()
        assert {r.calibrated for r in one} == {0.1, None}
    with pytest.raises(ValueError):
        monotone.apply_knots(df, knots.limit(0), "s")


def test_many_knots_map_like_interpolation(spark):
    """Far more knots than a plan would hold, in several blocks, and a score that a third of the rows have."""
    rng = np.random.default_rng(2)
    xs = np.unique(rng.normal(size=30_000))
    ys = np.cumsum(rng.random(len(xs)))
    asked = np.concatenate((rng.normal(size=2000) * 2, np.full(1000, 0.25), xs[:50]))
    knots = spark.createDataFrame(pd.DataFrame({"x": xs, "y": ys}))
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(asked)), "s": asked}))
    got = monotone.apply_knots(df, knots, "s", block_rows=5000).orderBy("k").toPandas()["calibrated"]
    assert np.allclose(got, np.interp(asked, xs, ys), atol=1e-9)


@pytest.mark.parametrize("block", [1 << 17, 64])
def test_pools_of_blocks_are_those_of_all_rows(spark, block):
    rng = np.random.default_rng(6)
    score = np.round(rng.random(3000), 3)
    label = (rng.random(3000) < np.where(score < 0.3, 0.5 - score, score)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": score, "label": label}))
    xs, at = np.unique(score, return_inverse=True)
    sums, counts = np.bincount(at, label).tolist(), np.bincount(at).tolist()
    pools = [[x, x, s, w] for x, s, w in zip(xs.tolist(), sums, counts)]
    k = 0
    while k < len(pools) - 1:
        if pools[k][2] * pools[k + 1][3] >= pools[k + 1][2] * pools[k][3]:
            a, b = pools[k], pools.pop(k + 1)
            pools[k] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
            k = max(0, k - 1)
        else:
            k += 1
    got = sorted(map(tuple, monotone.isotonic_pools(df, "s", "label", block).collect()))
    assert np.allclose(np.array(got), np.array(pools))


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    rows = linear.standardise(df, ["a", "b"]).collect()
    assert [(r.a_z, r.b_z) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_walk_forward_against_numpy(spark):
    rng = random.Random(6)
    rows = [(y, m, rng.uniform(0, 9), float(rng.randrange(9))) for y in range(2000, 2006) for m in range(4)]
    df = spark.createDataFrame(rows, "year int, month int, x double, y double")
    got = {(r.year, r.month): r.pred_x for r in
           linear.walk_forward_lines(df, ["x"], "y", 2001, 2004).collect()}
    assert {k[0] for k in got} == {2002, 2003, 2004}
    for (year, month), p in got.items():
        slope, base = np.polyfit([r[2] for r in rows if r[0] < year], [r[3] for r in rows if r[0] < year], 1)
        x = next(r[2] for r in rows if r[:2] == (year, month))
        assert p == pytest.approx(slope * x + base)


def test_targets_without_a_column_are_skipped(spark):
    df = spark.createDataFrame([(2000, 1, 2.0, 3.0)], "year int, actual_VN int, index_VN double, monthly_index double")
    rows = linear.targets_long(df, ["VN", "PH"], ["year"]).collect()
    assert [(r.target, r.y, r.own_index) for r in rows] == [("VN", 1.0, 2.0)]
    with pytest.raises(ValueError):
        linear.targets_long(df, ["PH"], ["year"])


def test_batch_scorer_loads_once_per_task(spark):
    def load():
        calls = [0]

        def scorer(batch):
            calls[0] += 1
            return batch.assign(n=calls[0])

        return scorer

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        out = score_batches(spark.range(0, 40, 1, 1), load, "id bigint, n bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.n for r in out) == 4


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        x, z = rng.random(), rng.random()
        rows.append((i, 2000 + i % 3, x, None if i % 50 == 0 else z, int(rng.random() < 0.6 * (x > 0.7))))
    df = spark.createDataFrame(rows, "id int, year int, x double, z double, label int").cache()
    train, val, _ = temporal_split(df, (2000, 2001))
    means = feature_means(train, ["x", "z"])
    model = models.fit_classifier(train, val, ["x", "z"], means, rounds=3, depth=2)
    return df, model, means, val


def test_classifier_ranks_and_names(spark, events):
    df, model, means, _ = events
    scored = models.raw_scores(df, model, ["x", "z"], means)
    assert scored.columns == [*df.columns, "raw_prob"]
    high = scored.agg(F.avg(F.when(F.col("x") > 0.7, F.col("raw_prob"))),
                      F.avg(F.when(F.col("x") <= 0.7, F.col("raw_prob")))).first()
    assert high[0] > high[1] + 0.2
    gains = {r.name: r.gain for r in models.importances(df, model, ["x", "z"]).collect()}
    assert gains["x"] > gains["z"] and sum(gains.values()) == pytest.approx(1.0)


def test_calibration_is_monotone_and_keeps_the_mean(spark, events):
    df, model, means, val = events
    raw = models.raw_scores(val, model, ["x", "z"], means)
    calibrator = models.fit_calibrator(raw)
    out = models.calibrate(raw, calibrator).select("raw_prob", "prob", "label").collect()
    ordered = [r.prob for r in sorted(out, key=lambda r: r.raw_prob)]
    assert all(a <= b + 1e-12 for a, b in zip(ordered, ordered[1:]))
    assert sum(ordered) / len(out) == pytest.approx(sum(r.label for r in out) / len(out), abs=1e-9)
    same = monotone.apply_knots(raw, calibrator.knots, "raw_prob", few_knots=0).select("id", "calibrated").join(
        models.calibrate(raw, calibrator).select("id", "prob"), "id")
    assert same.agg(F.max(F.abs(F.col("calibrated") - F.col("prob")))).first()[0] < 1e-9
    scored = models.score(df, model, calibrator, ["x", "z"], means, ["id"])
    assert scored.count() == df.count() and scored.columns == ["id", "prob", "prob_above_thresh"]


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    rows = models.class_weights(df).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert {r.label: r.w for r in rows} == {0: 3.0, 1: 3.0}


@pytest.fixture(scope="module")
def zero_inflated(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(600):
        x, g = rng.normal(), float(rng.integers(0, 2))
        zero = rng.random() < (0.7 if g else 0.1)
        rows.append((float(x), g, 0 if zero else int(rng.poisson(math.exp(1.0 + 0.5 * x)))))
    return spark.createDataFrame(rows, "x double, g double, y int").cache()


def test_zero_inflated_recovers_the_structure(zero_inflated):
    model = fit_zero_inflated(zero_inflated, ["x"], ["g"], "y", rounds=6)
    assert model.kind == "zero_inflated"
    ll = model.log_likelihoods
    assert len(ll) > 1 and all(b > a for a, b in zip(ll, ll[1:]))
    assert model.beta[1] / model.scale["x"] == pytest.approx(0.5, abs=0.12)
    assert model.gamma[1] > 0
    out = predict_zero_inflated(zero_inflated, model)
    low, high, mean, actual = out.agg(F.min("pred"), F.max("pred"), F.avg("pred"), F.avg("y")).first()
    assert 0 <= low and high <= 200 and mean == pytest.approx(actual, rel=0.15)


def test_zero_inflated_falls_back(spark, zero_inflated):
    never = fit_zero_inflated(zero_inflated.withColumn("y", F.lit(0)), ["x"], ["g"], "y")
    assert never.kind == "zeros"
    assert predict_zero_inflated(zero_inflated, never).agg(F.max("pred")).first()[0] == 0.0
    dirty = zero_inflated.withColumn("x", F.when(F.col("g") == 0, F.lit(float("inf"))).otherwise(F.col("x")))
    model = fit_zero_inflated(dirty, ["x"], ["g"], "y", rounds=1)
    bad = predict_zero_inflated(dirty, model).filter(F.col("pred").isNull() | F.isnan("pred"))
    assert bad.count() == 0


def test_log_gamma_series(spark):
    xs = [0.01, 0.5, 1.0, 3.7, 150.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(log_gamma("x")).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(x) for x in xs], abs=1e-9)


def test_tweedie_and_seasonal_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(2000 + i // 12, i % 12 + 1, float(i % 5), int(rng.poisson(math.exp(0.3 * (i % 5)))))
            for i in range(72)]
    df = spark.createDataFrame(rows, "year int, month int, x double, y int")
    pred = models.predict_counts(df, models.fit_tweedie(df, ["x"], "y"), ["x"], "pred")
    lows = pred.groupBy("x").agg(F.avg("pred").alias("p")).orderBy("x").collect()
    assert all(a.p < b.p for a, b in zip(lows, lows[1:]))
    fits = fit_seasonal_poisson(df.filter("month >= 5"), ["x"], "y")
    assert set(fits) == {"peak"} and abs(fits["peak"].coefficients[0] - 0.3) < 0.1
    out = predict_seasonal(df, fits, "pred").collect()
    assert len(out) == 72 and {r.pred for r in out if r.month < 5} == {0.0}
    assert min(r.pred for r in out) >= 0.0


def poisson_ridge(x, y, penalty):
    """Newton's steps for one fit, whole in memory."""
    z = np.column_stack((np.ones(len(y)), (x - x.mean(axis=0)) / x.std(axis=0)))
    pull = np.array([0.0] + [penalty] * x.shape[1])
    beta = np.append(np.log(y.mean()), np.zeros(x.shape[1]))
    for _ in range(200):
        mu = np.exp(z @ beta)
        curve = (z * mu[:, None]).T @ z / len(y) + np.diag(pull + 1e-12)
        step = np.linalg.solve(curve, z.T @ (mu - y) / len(y) + pull * beta)
        loss = lambda b: (np.exp(z @ b) - y * (z @ b)).mean() + 0.5 * (pull * b * b).sum()
        size = 1.0
        while size > 1e-8 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
    raw = beta[1:] / x.std(axis=0)
    return np.append(beta[0] - raw @ x.mean(axis=0), raw)


def test_seasonal_fits_equal_one_by_one(spark):
    """Daily rows; every penalty of every fold, against fits of whole arrays."""
    rng = np.random.default_rng(5)
    n, points = 900, 4
    x = rng.normal(size=(n, 2)) * [1, 10] + [0, 5]
    month = rng.integers(5, 11, n)
    y = rng.poisson(np.exp(0.5 + 0.4 * x[:, 0])).astype(float)
    day = np.arange(n)
    df = spark.createDataFrame(pd.DataFrame({"day": day, "month": month, "a": x[:, 0], "b": x[:, 1], "y": y}))
    fit = fit_seasonal_poisson(df, ["a", "b"], "y", points=points, order=["day"])["peak"]
    fold = day // (n // 3)
    errors = []
    for penalty in models.penalty_grid(points):
        miss = 0.0
        for k in range(3):
            beta = poisson_ridge(x[fold != k], y[fold != k], penalty)
            miss += np.abs(np.exp(beta[0] + x[fold == k] @ beta[1:]) - y[fold == k]).sum()
        errors.append(miss / n)
    best = int(np.argmin(errors))
    assert fit.penalty == models.penalty_grid(points)[best] and fit.error == pytest.approx(errors[best], rel=1e-5)
    whole = poisson_ridge(x, y, fit.penalty)
    assert (fit.intercept, *fit.coefficients) == pytest.approx(tuple(whole), abs=1e-5)


def test_penalty_grid():
    grid = models.penalty_grid()
    assert len(grid) == 30 and grid[0] == pytest.approx(1e-4) and grid[-1] == pytest.approx(1e4)


def test_training_parts_follow_the_rows(spark):
    """Rows that compress to nothing used to land in as few parts as their shuffled bytes filled."""
    rows = spark.range(40_000).select(F.lit(1.0).alias("x"), (F.col("id") % 7).alias("k"))
    parts = models.in_parts(rows, most=2_000)
    sizes = [r["n"] for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 1.1 * 2_000 and sum(sizes) == 40_000
    assert models.in_parts(rows.limit(0)).count() == 0 and models.in_parts(rows.limit(5)).count() == 5


def test_the_classifier_trains_on_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(models.in_parts, "__defaults__", (500, 100))
    seen = []

    class Held(models.GBTClassifier):
        def _fit(self, data):
            seen.extend(r["n"] for r in data.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
            return super()._fit(data)

    monkeypatch.setattr(models, "GBTClassifier", Held)
    rows = spark.range(0, 6_000, 1, 2).select(
        (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 6).cast("int").alias("label"))
    train, val = rows.where("x < 9"), rows.where("x >= 5")
    model = models.fit_classifier(train, val, ["x"], feature_means(train, ["x"]), rounds=2, depth=2)
    assert model.numFeatures == 1 and sum(seen) == 5_400 + 3_000 and max(seen) <= 600
