"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.shared import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has an edge.

    Each round takes the smallest root among a node's neighbours, offers it to the node and to the
    node's own root, and then replaces each root by its root. Rounds grow with the logarithm of the
    longest chain. The minima are partial aggregates and the lookups are unique on their key, so a
    component that holds most nodes is combined map-side or split by the adaptive skew join. Nodes
    and roots stay on the executors; each round is cut by a checkpoint.

    An empty edge table gives an empty result; edges with a null end and loops are ignored.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = checkpointed(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
                        .distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(
        F.least(F.col("node"), F.min("v")).alias("root")))
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "v"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("seen")))
        offers = labels.join(near, "node").select(
            F.col("root").alias("was"), F.col("node"), F.least("root", "seen").alias("best"))
        offers = offers.select(F.explode(F.array(
            F.struct(F.col("node"), F.col("best"), F.col("was")),
            F.struct(F.col("was").alias("node"), F.col("best"),
                     F.lit(None).cast(labels.schema["root"].dataType).alias("was")))).alias("o"))
        hooked = offers.groupBy(F.col("o.node").alias("node")).agg(
            F.min("o.best").alias("root"), F.max("o.was").alias("was"))
        jumped = hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("next")),
                             "root").select("node", F.col("next").alias("root"), "was")
        jumped = checkpointed(jumped)
        changed = jumped.where("root <> was").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
