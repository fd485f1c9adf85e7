"""Sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.operators import sampling

COLS = ("l_orderkey", "l_linenumber", "prob", "label")
BUCKETS = 2_147_483_647


def key_hash():
    return F.pmod(F.col("l_orderkey") * 1_640_531_527 + F.col("l_linenumber") * 271_733_878, F.lit(BUCKETS))


@query("sample_negatives")
def _(t):
    return sampling.undersample(t.scores, ["l_orderkey", "l_linenumber"], ratio=5).select(*COLS)


@query("sample_negatives_key", views="scores", oracle="""
SELECT l_orderkey, l_linenumber, prob, label FROM scores, (SELECT
 LEAST(CAST(1.0 AS DOUBLE), CAST(5.0 AS DOUBLE) * SUM(label) / GREATEST(SUM(1 - label), 1)) AS f
 FROM scores) c
WHERE label = 1 OR (l_orderkey * 1640531527 + l_linenumber * 271733878) % 2147483647 < f * 2147483647""")
def _(t):
    return sampling.undersample(t.scores, key_hash(), ratio=5, buckets=BUCKETS).select(*COLS)


@query("split_temporal", views="scores", oracle="""
SELECT l_orderkey, l_linenumber, year, CASE WHEN year <= 1998 THEN 'train' WHEN year <= 1999 THEN 'val'
 ELSE 'test' END AS part FROM scores""")
def _(t):
    parts = sampling.temporal_split(t.scores.select("l_orderkey", "l_linenumber", "year"), (1998, 1999))
    tagged = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "val", "test"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
