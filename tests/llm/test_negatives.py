import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, step, positives=5, count=10, low=30, high=90):
    sound = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])]
    asked = {}
    for r in sound:
        if r[0] % step == 0:
            asked[r[0]] = min(asked.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    out = []
    for a, label, v in asked.values():
        score = lambda w: sum(int(x) * int(y) for x, y in zip(v, w))
        others = [(-score(w), i, other) for i, other, w in sound if len(w) == len(v)]
        best = sorted((s, i) for s, i, other in others if other == label and i != a)[:positives]
        ranked = sorted((s, i) for s, i, other in others if other != label)
        for p, i in best:
            fits = [(s, j) for s, j in ranked if low * -p <= 100 * -s <= high * -p][:count]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


def got(frame):
    return sorted(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                          "negative_score").collect()))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 10)) * 60
    return [(k, int(rng.integers(0, 4)), [float(x) for x in np.floor(
        centres[k % 12] * rng.uniform(0.2, 2) + rng.normal(size=10) * 8)]) for k in range(900)] + [
        (2000 + k, k % 4, [100.0] * 10) for k in range(40)]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 150, "anchor_rows": 7}])
def test_against_all_pairs(spark, clustered, sizes):
    df = spark.createDataFrame(clustered, SCHEMA)
    want = brute(clustered, 20)
    assert len(want) > 500
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, **sizes)) == want


def test_bounds_spare_pairs_and_lose_none(clustered):
    points = np.array([v for _, _, v in clustered])
    shard = negatives.Shard.built(np.arange(len(points)), np.zeros(len(points), dtype=int), points)
    looked, whole = 0, 0
    for anchor in points[::50]:
        norm = np.linalg.norm(anchor)
        angle = negatives.angles_to(anchor[None], np.array([norm]), shard.directions)[0]
        score = shard.points @ anchor
        for low, high in ((0.5 * norm ** 2, np.inf), (0.3 * norm ** 2, 0.6 * norm ** 2), (-10.0, 10.0)):
            rows = shard.candidates(anchor, norm, angle, low, high)
            assert set(np.flatnonzero((score >= low) & (score <= high))) <= set(rows)
            looked, whole = looked + len(rows), whole + len(score)
    assert looked < 0.7 * whole


def test_odd_rows(spark, clashing):
    big = 2.0 ** 40
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 0, [1.0, 1.0]), (3, 2, [1.0, 1.0]),
            (4, None, [1.0, 1.0]), (5, 1, None), (6, 1, [None, 1.0]), (7, 1, [float("nan"), 1.0]),
            (8, 1, [float("inf"), 1.0]), (9, 1, []), (10, 0, []), (100, 1, []), (None, 1, [5.0, 5.0]),
            (200, 3, [0.0, 0.0]), (201, 3, [0.0, 1.0]), (300, 4, [-1.0, -1.0]), (301, 4, [1.0, 1.0]),
            (400, 5, [1.0, 1.0, 1.0]), (500, 6, [big, 1.0]), (501, 6, [big, 3.0]), (502, 7, [big / 2, 0.0]),
            (0, 2, [9.0, 9.0]), (100, 1, [])]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    found = got(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0))
    want = brute(rows, 100)
    # Scores of 500 are clipped to a long, so its negative is no longer below nine tenths of the positive.
    assert {r[0] for r in want} >= {500} and found == [r for r in want if r[0] != 500]
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
