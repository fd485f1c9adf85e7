import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.llm import neighbours


def brute(rows, query_ids, k):
    sound = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v)
             and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, vector in sound:
        if q in query_ids:
            near = sorted((float(np.sqrt(np.cumsum((w - vector) ** 2)[-1])), i) for i, w in sound
                          if i != q and len(w) == len(vector))
            out[q] = near[:k]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 8] + 0.3 * rng.normal(size=12)])
            for k in range(1500)]
    rows += [(2000 + k, rows[k % 3][1]) for k in range(40)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("block, at_once", [(8192, 16), (6, 1), (8, 4)])
def test_factor_one_is_exact(vectors, block, at_once):
    rows, df = vectors
    index = neighbours.build_index(df, shard_rows=300)
    got = found(neighbours.nearest(index, df.where("vec_id % 100 = 0"), relax=1.0, block=block,
                                   shards_at_once=at_once))
    assert got == brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)


def test_relaxed_recall(vectors):
    rows, df = vectors
    index = neighbours.build_index(df, shard_rows=600)
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 10)
    recall = {}
    for relax in (neighbours.RELAX, 50.0):
        got = found(neighbours.nearest(index, df.where("vec_id % 20 = 0"), relax=relax))
        recall[relax] = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall[neighbours.RELAX] >= 0.95 and recall[50.0] <= recall[neighbours.RELAX]


def test_blocks_build_one_index(vectors, tmp_path):
    _, df = vectors

    def noted(batches, folder=str(tmp_path)):
        for batch in batches:
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield batch

    index = neighbours.build_index(df.mapInPandas(noted, df.schema), shard_rows=300)
    read = len(list(tmp_path.iterdir()))
    jobs = neighbours.nearest(index, df.where("vec_id % 100 = 0"), block=6)
    assert jobs.count() == 160 and len(list(tmp_path.iterdir())) == read


def test_ties_at_the_bound(spark):
    # Equal distances in every shard, those of the pilot included: the smallest ids win.
    rows = [(k, [float(1 + k % 2), 0.0, 0.1]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(neighbours.build_index(df, shard_rows=40), df.where("vec_id % 100 = 0"),
                                   relax=1.0, block=2))
    assert got == brute(rows, {0, 100, 200, 300}, 10)


def test_odd_vectors(spark, clashing):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]),
            (10, [1.0, 2.0, 3.0]), (100, [1.0, 5.0]), (100, [1.0, 5.0]), (200, None), (300, [0.0, 0.0]),
            (400, [5.0, 5.0, 5.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = found(neighbours.nearest(neighbours.build_index(df), df.where("vec_id % 100 = 0")))
    want = brute(rows, {0, 100, 400}, 10)
    assert got == want and [i for _, i in got[0]][:3] == [7, 8, 9]
    none = df.limit(0)
    assert neighbours.nearest(neighbours.build_index(none), df).count() == 0
    assert neighbours.nearest(neighbours.build_index(df), none).count() == 0
    assert neighbours.nearest(neighbours.build_index(df), df.where(F.col("vec_id").isNull())).count() == 0
