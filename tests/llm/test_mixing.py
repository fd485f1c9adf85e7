import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), times=3):
    """Water-filling by repetition: share, cap, reshare the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + (
        [None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > times * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: times * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 20, None: 7},
    {"z": 10, "é": 10, "a": 0, "A": 3000, None: 1}, {"only": 5}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_pivot_keeps_mass_and_odds():
    size = np.array([5.0, 1, 8, 2, 2, 9, 1, 4])
    p = np.array([.3, .5, .2, .9, .4, .6, .7, .1])
    rounds = np.array([mixing._pivot(size, p, np.random.default_rng(k)) for k in range(4000)])
    assert np.allclose(rounds @ size, p @ size, atol=1e-6)
    assert (((rounds > 0) & (rounds < 1)).sum(axis=1) <= 1).all()
    assert np.abs(rounds.mean(axis=0) - p).max() < 0.04


def test_takes_are_near_targets_and_repeat(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").withColumn(
        "source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    first, again = (mixing.mix(d).toPandas() for d in (docs, docs.repartition(7)))
    cols = ["doc_id", "copies"]
    assert first[cols].sort_values(cols).values.tolist() == again[cols].sort_values(cols).values.tolist()
    assert first["copies"].between(0, 3).all()
    taken = (first["size"] * first["copies"]).groupby(first["source"]).sum()
    target = first.groupby("source")["target"].first()
    assert ((taken - target).abs() / target < 0.02).all()
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() == first["copies"].sum()


def test_blocks_and_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr(
        "repeat('w ', CAST(1 + id % 37 AS INT))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    rows = mixing.mix(docs).toPandas()
    taken = (rows["size"] * rows["copies"]).groupby(rows["source"]).sum()
    assert len(rows) == 2000
    assert (abs(taken - rows.groupby("source")["target"].first()) < 60).all()


def test_odd_documents(spark, odd_documents, clashing):
    docs = clashing(odd_documents)
    rows = mixing.mix(docs).toPandas()
    assert rows["n"].sum() == odd_documents.count() and (rows["copies"] <= 3 * rows["n"]).all()
    assert set(rows["source"].dropna()) == {"s", "t"} and rows["source"].isna().any()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == rows["copies"].sum()
    assert mixing.mix(odd_documents.limit(0)).count() == 0
    assert mixing.mixed_documents(odd_documents.limit(0)).count() == 0
