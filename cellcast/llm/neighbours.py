"""Nearest neighbours by vantage-point trees, one per shard, with relaxed pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField,
                               StructType)

from cellcast.shared import checkpointed

NEAREST = 10
# Vectors of one tree, on average, and of one leaf.
SHARD_ROWS = 8192
LEAF_ROWS = 64
# Pruning multiplies a lower bound by this: 1 is exact, more prunes more.
RELAX = 1.15
# Queries (on average, half of it) and shards that are searched in one group.
QUERY_BLOCK = 8192
SHARDS_AT_ONCE = 16
# Share of two distances that rounding may take off the bound their difference gives.
ROUNDING = 1e-12


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero, not empty."""
    def sound(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, sound)
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """Points in leaf order and nodes: vantage point, radius, children, and the leaf's range.

    A node's inner child holds the points within ``radius`` of its vantage point, the outer child the
    rest. A leaf has radius -1.
    """

    ids: np.ndarray
    points: np.ndarray
    vantage: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    span: np.ndarray

    @classmethod
    def built(cls, ids: np.ndarray, points: np.ndarray, seed: int) -> Tree:
        rng = np.random.default_rng(seed)
        order = np.arange(len(ids))
        vantage, radius, child, span = [], [], [], []

        def add(low: int, high: int) -> int:
            node = len(radius)
            vantage.append(np.zeros(points.shape[1]))
            radius.append(-1.0)
            child.append((-1, -1))
            span.append((low, high))
            if high - low <= LEAF_ROWS:
                return node
            own = points[order[low:high]]
            # Of a few candidates the one whose distances spread most tells most points apart.
            tried = own[rng.choice(len(own), size=min(5, len(own)), replace=False)]
            some = own[rng.choice(len(own), size=min(256, len(own)), replace=False)]
            spread = [np.linalg.norm(some - t, axis=1).std() for t in tried]
            at = tried[int(np.argmax(spread))]
            distance = np.linalg.norm(own - at, axis=1)
            cut = float(np.median(distance))
            inner = distance <= cut
            if inner.all():
                return node
            order[low:high] = order[low:high][np.argsort(~inner, kind="stable")]
            vantage[node], radius[node] = at, cut
            middle = low + int(inner.sum())
            child[node] = (add(low, middle), add(middle, high))
            return node

        add(0, len(ids))
        return cls(ids[order], points[order], np.array(vantage), np.array(radius), np.array(child),
                   np.array(span))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: np.ndarray, found: np.ndarray,
               cap: np.ndarray, relax: float) -> None:
        """Puts what is nearer into ``best`` and ``found``: distances and ids of the nearest of each query so
        far, ties to smaller ids, own id left out. ``cap`` is a distance no wanted row lies beyond."""
        home: dict[int, list[np.ndarray]] = {}
        near = self._home_leaves(queries)
        for leaf in np.unique(near):
            home[int(leaf)] = np.flatnonzero(near == leaf)
        for leaf, rows in home.items():
            self._scan(leaf, rows, query_ids, queries, best, found)
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, rows, bound = stack.pop()
            open_ = bound * relax <= np.minimum(best[rows, -1], cap[rows])
            rows, bound = rows[open_], bound[open_]
            if not len(rows):
                continue
            if self.radius[node] < 0:
                rest = rows[near[rows] != node]
                if len(rest):
                    self._scan(node, rest, query_ids, queries, best, found)
                continue
            distance = np.linalg.norm(queries[rows] - self.vantage[node], axis=1)
            gap = distance - self.radius[node]
            inner, outer = self.child[node]
            slack = ROUNDING * (distance + self.radius[node])
            stack.append((outer, rows, np.maximum(bound, -gap - slack)))
            stack.append((inner, rows, np.maximum(bound, gap - slack)))

    def _home_leaves(self, queries: np.ndarray) -> np.ndarray:
        at = np.zeros(len(queries), dtype=np.int64)
        while True:
            inside = np.flatnonzero(self.radius[at] >= 0)
            if not len(inside):
                return at
            node = at[inside]
            distance = np.linalg.norm(queries[inside] - self.vantage[node], axis=1)
            at[inside] = self.child[node, (distance > self.radius[node]).astype(int)]

    def _scan(self, leaf: int, rows: np.ndarray, query_ids, queries, best, found) -> None:
        low, high = self.span[leaf]
        k = best.shape[1]
        step = max(1, (1 << 22) // max(1, (high - low) * queries.shape[1]))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            apart = queries[part][:, None, :] - self.points[None, low:high]
            score = np.sqrt(np.cumsum(apart * apart, axis=2)[:, :, -1])
            ids = np.broadcast_to(self.ids[low:high], score.shape)
            score = np.where(ids == query_ids[part][:, None], np.inf, score)
            ids = np.where(np.isinf(score), np.iinfo(np.int64).max, ids)
            both, names = np.hstack((best[part], score)), np.hstack((found[part], ids))
            order = np.lexsort((names, both))[:, :k]
            best[part] = np.take_along_axis(both, order, axis=1)
            found[part] = np.take_along_axis(names, order, axis=1)


_PARTS = ("ids", "points", "vantage", "radius", "child", "span")
_DTYPES = (np.int64, np.float64, np.float64, np.float64, np.int64, np.int64)
_INDEX = StructType([StructField("dimension", IntegerType()), StructField("shard", LongType()),
                     StructField("rows", LongType()),
                     *[StructField(p, BinaryType()) for p in _PARTS]])


def build_index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                shard_rows: int = SHARD_ROWS, seed: int = 42) -> DataFrame:
    """One row per shard: a tree over its vectors as binary columns.

    Every usable vector with an id is indexed, nothing is sampled. Shards are drawn by a hash of id
    and vector, so none is hot; their number grows with the rows. Vectors of
    different lengths go to different shards. The trees are built once and kept by a checkpoint, for any number
    of searches.
    """
    usable_rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast(ArrayType(DoubleType())).alias("v"))
    count = usable_rows.count()
    shards = max(1, -(-count // shard_rows))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        tree = Tree.built(rows["id"].to_numpy()[order], np.stack(rows["v"].to_numpy())[order],
                          seed + key[1])
        return pd.DataFrame({"dimension": [key[0]], "shard": [key[1]], "rows": [len(rows)]} | {
            p: [np.ascontiguousarray(getattr(tree, p), dtype=t).tobytes()]
            for p, t in zip(_PARTS, _DTYPES)})

    return checkpointed(usable_rows.withColumns({
        "dimension": F.size("v"), "shard": F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(shards))
    }).groupBy("dimension", "shard").applyInPandas(build, _INDEX))


def _loaded(row, dimension: int) -> Tree:
    raw = {p: np.frombuffer(row[p], dtype=t) for p, t in zip(_PARTS, _DTYPES)}
    return Tree(raw["ids"], raw["points"].reshape(-1, dimension),
                raw["vantage"].reshape(-1, dimension), raw["radius"], raw["child"].reshape(-1, 2),
                raw["span"].reshape(-1, 2))


_FOUND = "query_id long, vec_id long, score double"
_BLOCKS = "dimension int, block long, ids binary, vectors binary, cap binary"


def _query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """``id``, ``v`` in one row per length of vector and block, as binary columns, without a bound yet."""
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"dimension": [key[0]], "block": [key[1]],
                             "ids": [rows["id"].to_numpy(dtype=np.int64).tobytes()],
                             "vectors": [np.stack(rows["v"].to_numpy()).astype(np.float64).tobytes()],
                             "cap": [np.full(len(rows), np.inf).tobytes()]})

    placed = queries.withColumns({"dimension": F.size("v"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks))})
    return placed.groupBy("dimension", "block").applyInPandas(pack, _BLOCKS)


def _searched(trees: pd.DataFrame, asked: pd.DataFrame, k: int, relax: float
              ) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each row of ``asked`` with its ids, caps, and the distances and ids found in all of ``trees``."""
    for _, row in asked.iterrows():
        ids, cap = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["cap"])
        vectors = np.frombuffer(row["vectors"]).reshape(len(ids), -1)
        best = np.full((len(ids), k), np.inf)
        found = np.full((len(ids), k), np.iinfo(np.int64).max)
        for tree in trees.sort_values("shard").to_dict("records"):
            _loaded(tree, vectors.shape[1]).search(ids, vectors, best, found, cap, relax)
        yield row, ids, cap, best, found


def nearest(index: DataFrame, queries: DataFrame, k: int = NEAREST, relax: float = RELAX,
            id_column: str = "vec_id", vector_column: str = "embedding",
            block: int = QUERY_BLOCK, shards_at_once: int = SHARDS_AT_ONCE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest of each query.

    Scores are Euclidean distances in double precision; ties go to the smaller id; rows with the
    query's own id are no candidates; a query with fewer candidates gets them all. ``relax`` at 1
    makes the pruning, and so the search, exact; more passes over subtrees whose lower bound times
    ``relax`` exceeds the distance of the ``k``-th found so far.

    Queries go in blocks by a hash of their id. First each block is searched in one shard, which gives every
    query a distance that its ``k``-th nearest cannot exceed; then blocks meet groups of shards in one
    shuffle, keyed by block and group, and only rows within that distance are returned. Within a group a query
    carries what it found from tree to tree. Queries that are not usable or have no id take no part; of several
    with one id the smallest vector counts. An empty index or query table gives an empty result.
    """
    asked = checkpointed(queries.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))).groupBy(
        F.col(id_column).cast("long").alias("id")).agg(
        F.min(F.col(vector_column).cast(ArrayType(DoubleType()))).alias("v")))
    blocks = max(1, -(-asked.count() // max(1, block // 2)))
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    cores = index.sparkSession.sparkContext.defaultParallelism
    # Groups of shards are smaller while there are too few to give every core one.
    groups = min(shards, max(-(-shards // shards_at_once), -(-cores // blocks)))
    tasks = max(min(4 * blocks * groups, 200), blocks * groups // 4)

    def bounded(trees: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**row, "cap": np.minimum(cap, best[:, -1]).tobytes()}
                             for row, _, cap, best, _ in _searched(trees, part, k, relax)],
                            columns=["dimension", "block", "ids", "vectors", "cap"])

    def search(trees: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        for _, ids, cap, best, found in _searched(trees, part, k, relax):
            hit = np.isfinite(best) & (best <= cap[:, None])
            out.append(pd.DataFrame({"query_id": np.repeat(ids, k)[hit.ravel()], "vec_id": found[hit],
                                     "score": best[hit]}))
        return pd.concat(out[1:] or out)

    pilots = index.where(F.col("shard") < blocks).withColumn("block", F.explode(
        F.sequence("shard", F.lit(blocks - 1).cast("long"), F.lit(shards).cast("long"))))
    first = ("dimension", "block")
    limited = pilots.repartition(blocks, *first).groupBy(*first).cogroup(
        _query_blocks(asked, blocks).repartition(blocks, *first).groupBy(*first)).applyInPandas(bounded, _BLOCKS)
    key = ("dimension", "block", "part")
    sent = limited.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    held = index.withColumns({
        "part": (F.col("shard") % groups).cast("int"),
        "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    found = held.repartition(tasks, *key).groupBy(*key).cogroup(
        sent.repartition(tasks, *key).groupBy(*key)).applyInPandas(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
