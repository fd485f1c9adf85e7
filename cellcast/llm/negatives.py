"""Hard negatives by integer inner products, bounded beforehand by angles to stored reference directions.

A shard keeps, of each of its vectors, the norm and the angles to a few of the shard's own directions. By the
triangle inequality on the sphere, an anchor's angles to the same directions give an interval for each
pair's angle, its cosine times both norms an interval for the score. Only pairs whose interval meets a wanted
window of scores are multiplied out. Blocks of vectors that lie next to each other are looked at first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.shared import checkpointed

POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
# Vectors of a shard, anchors of a block (on average), directions of a shard, vectors of a block within it.
SHARD_ROWS, ANCHOR_ROWS, DIRECTIONS, BLOCK_ROWS = 2048, 4096, 16, 32

# What rounding can shift an angle (arccos near 1) and, relatively, a score.
_ANGLE_SLACK, _SCORE_SLACK = 1e-6, 1e-9
# Sums of products below this are whole in double precision.
_EXACT = 2.0 ** 53
_PARTS = {"ids": np.int64, "labels": np.int64, "points": np.float64, "norms": np.float64,
          "directions": np.float64, "angles": np.float64}
_SHARD = "dimension int, shard long, " + ", ".join(f"{p} binary" for p in _PARTS)


def usable(label: Column, vector: Column) -> Column:
    """Rows that take part: label and vector not null, no component null or not finite."""
    return F.coalesce(label.isNotNull() & vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def angles_to(points: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each point to each direction (rows of unit length); a zero vector stands upright on all."""
    with np.errstate(all="ignore"):
        unit = np.where(norms[:, None] > 0, points / np.where(norms > 0, norms, 1)[:, None], 0.0)
        return np.arccos(np.clip(unit @ directions.T, -1, 1))


def spread_directions(points: np.ndarray, norms: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors of points, each the one farthest from those taken before."""
    usable_rows = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    unit = points[usable_rows] / norms[usable_rows, None]
    nearest, taken = np.full(len(unit), -2.0), []
    for _ in range(min(count, len(unit))):
        taken.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return unit[taken]


class Shard:
    """Vectors in the order of their angle to the first direction, and the bounds of each block of them."""

    def __init__(self, **parts: np.ndarray) -> None:
        for name, part in parts.items():
            setattr(self, name, part)
        self.most = np.abs(self.points).max(initial=0)
        begins = np.arange(0, len(self.ids), BLOCK_ROWS)
        self.block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(self.ids))))
        self.low = np.minimum.reduceat(self.angles, begins)
        self.high = np.maximum.reduceat(self.angles, begins)
        self.short = np.minimum.reduceat(self.norms, begins)
        self.long = np.maximum.reduceat(self.norms, begins)

    @classmethod
    def built(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> Shard:
        with np.errstate(over="ignore"):
            norms = np.sqrt((points * points).sum(axis=1))
        directions = spread_directions(points, norms)
        angles = angles_to(points, norms, directions)
        order = np.argsort(angles[:, 0], kind="stable") if len(directions) else np.arange(len(ids))
        return cls(ids=ids[order], labels=labels[order], points=points[order], norms=norms[order],
                   directions=directions, angles=angles[order])

    def candidates(self, anchor: np.ndarray, norm: float, angle: np.ndarray, low: float, high: float
                   ) -> np.ndarray:
        """Rows whose score with the anchor can lie between ``low`` and ``high``, ends included."""
        rows = np.arange(len(self.ids))
        if not len(self.directions) or not np.isfinite(norm) or not np.isfinite(self.norms).all():
            return rows
        for first in (True, False):
            if first:
                least, most, short, long = self.low, self.high, self.short, self.long
            else:
                least = most = self.angles[rows]
                short = long = self.norms[rows]
            near = np.maximum(np.maximum(least - angle, angle - most), 0).max(axis=1) - _ANGLE_SLACK
            far = np.minimum(most + angle, 2 * np.pi - (least + angle)).min(axis=1) + _ANGLE_SLACK
            top, bottom = np.cos(np.clip(near, 0, np.pi)), np.cos(np.clip(far, 0, np.pi))
            slack = norm * long * _SCORE_SLACK + 1
            upper = norm * np.where(top >= 0, long, short) * top + slack
            lower = norm * np.where(bottom >= 0, short, long) * bottom - slack
            meets = (upper >= low) & (lower <= high)
            rows = rows[meets[self.block]] if first else rows[meets]
        return rows

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer inner products, exact; clipped to the ends of a long."""
        most = np.abs(anchor).max(initial=0)
        if most * self.most * max(1, len(anchor)) < _EXACT:
            return (self.points[rows] @ anchor).astype(np.int64)
        whole = [int(x) for x in anchor]
        ends = np.iinfo(np.int64)
        return np.array([min(max(sum(int(x) * y for x, y in zip(row, whole)), ends.min), ends.max)
                         for row in self.points[rows]], dtype=np.int64)


def _loaded(row: pd.Series) -> Shard:
    raw = {p: np.frombuffer(row[p], dtype=t) for p, t in _PARTS.items()}
    dimension, count = int(row["dimension"]), len(raw["ids"])
    held = len(raw["directions"]) // max(1, dimension)
    return Shard(**raw | {"points": raw["points"].reshape(count, dimension),
                          "directions": raw["directions"].reshape(held, dimension),
                          "angles": raw["angles"].reshape(count, held)})


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id", kind="stable")
    shard = Shard.built(rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64),
                        np.stack(rows["v"].to_numpy()).reshape(len(rows), key[0]))
    return pd.DataFrame({"dimension": [key[0]], "shard": [key[1]]} | {
        p: [np.ascontiguousarray(getattr(shard, p), dtype=t).tobytes()] for p, t in _PARTS.items()})


def _best(shard: Shard, anchor, norm: float, angle: np.ndarray, number: int, label: int, count: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` best rows of the anchor's label, scores descending, ties by id."""
    own = (shard.labels == label) & (shard.ids != number)
    floor, rows = -np.inf, np.flatnonzero(own)
    if len(rows) > 4 * count and len(shard.directions):
        # A first few, near the anchor in the order of angles, give a score that others must reach.
        at = np.searchsorted(shard.angles[rows, 0], angle[0])
        some = rows[max(0, at - count):at + count]
        floor = np.sort(shard.scores(anchor, some))[-min(count, len(some))] if len(some) >= count else floor
        rows = shard.candidates(anchor, norm, angle, floor, np.inf)
        rows = rows[own[rows]]
    score = shard.scores(anchor, rows)
    order = np.lexsort((shard.ids[rows], -score))[:count]
    return shard.ids[rows][order], score[order]


def _within(shard: Shard, anchor, norm: float, angle: np.ndarray, label: int, positives: np.ndarray,
            count: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """Of each positive's window, the ``count`` best rows of another label: (positive's place, id, score)."""
    most = positives[positives >= 0]
    if not len(most):
        return []
    rows = shard.candidates(anchor, norm, angle, low * float(most.min()) / 100 - 1, high * float(most.max()) / 100 + 1)
    rows = rows[shard.labels[rows] != label]
    score = shard.scores(anchor, rows)
    order = np.lexsort((shard.ids[rows], -score))
    rows, score = rows[order], score[order]
    found = []
    for place, positive in enumerate(positives):
        # Whole-number ends of the window; it is empty for a negative positive's score.
        top, bottom = high * int(positive) // 100, -(-low * int(positive) // 100)
        begin = np.searchsorted(-score, -top)
        end = min(begin + count, np.searchsorted(-score, -bottom, side="right"))
        found += [(place, int(shard.ids[rows[k]]), int(score[k])) for k in range(begin, end)]
    return found


def _searched(count: int, low: int | None = None, high: int | None = None):
    def search(key: tuple, shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        for _, row in shards.iterrows() if len(asked) else ():
            shard = _loaded(row)
            points = np.stack(asked["v"].to_numpy()).reshape(len(asked), key[0])
            with np.errstate(over="ignore"):
                norms = np.sqrt((points * points).sum(axis=1))
            angles = angles_to(points, norms, shard.directions)
            for k, (number, label) in enumerate(zip(asked["id"].tolist(), asked["label"].tolist())):
                if low is None:
                    ids, scores = _best(shard, points[k], norms[k], angles[k], number, label, count)
                    out += [(number, 0, *pair) for pair in zip(ids.tolist(), scores.tolist())]
                else:
                    out += [(number, *hit) for hit in _within(
                        shard, points[k], norms[k], angles[k], label, np.asarray(asked["scores"].iloc[k]),
                        count, low, high)]
        return pd.DataFrame(out, columns=["anchor", "place", "id", "score"])
    return search


_FOUND = "anchor long, place int, id long, score long"


def _first(found: DataFrame, count: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, id_column: str = "vec_id", label_column: str = "label",
                   vector_column: str = "embedding", shard_rows: int = SHARD_ROWS,
                   anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` hold integral vectors (as doubles); a score is the integer inner product with the anchor, higher
    first, ties by smaller id. ``anchors`` tells anchors. An anchor's positives are its first rows of its own
    label, rows of its own id left out; the negatives of a positive are the first rows of other labels whose
    score is between ``low`` and ``high`` hundredths of the positive's (none for a negative score).

    Every row is indexed: shards of about ``shard_rows`` by a hash, so no label or vector makes a hot one.
    Blocks of about ``anchor_rows`` anchors meet every shard once for the positives and once for the negatives,
    each meeting a task of its own; a meeting returns a few rows an anchor.
    Rows that are not usable or have no id take no part; an anchor's id given several times stands for its
    smallest label and vector; repeated rows count one by one as positives and negatives. Vectors meet those of
    their own length. Scores that a long cannot hold are clipped to its ends. No usable row: an empty result.
    """
    kept = rows.where(F.col(id_column).isNotNull() & usable(F.col(label_column), F.col(vector_column)))
    plain = checkpointed(kept.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"), F.size(vector_column).alias("dimension"),
        F.coalesce(anchors, F.lit(False)).alias("asks")))
    asked = plain.where("asks").groupBy("id").agg(F.min(F.struct("label", "v", "dimension")).alias("row")).select(
        "id", "row.label", "row.v", "row.dimension")
    sizes = checkpointed(plain.groupBy("dimension").agg(
        F.ceil(F.count("*") / F.lit(shard_rows)).cast("long").alias("shards"),
        F.ceil(F.greatest(F.count_if("asks"), F.lit(1)) / F.lit(anchor_rows)).cast("long").alias("blocks")))
    placed = plain.join(sizes, "dimension").withColumn(
        "shard", F.pmod(F.xxhash64("id", "label", "v", F.monotonically_increasing_id()), F.col("shards")))
    index = checkpointed(placed.select("dimension", "shard", "id", "label", "v").groupBy(
        "dimension", "shard").applyInPandas(_build, _SHARD))
    keys = ["dimension", "shard", "block"]
    shards = index.join(sizes.select("dimension", "blocks"), "dimension").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    asked = checkpointed(asked.join(sizes, "dimension").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks"))))

    def met(asking: DataFrame, search) -> DataFrame:
        spread = asking.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        return shards.groupBy(*keys).cogroup(spread.drop("shards", "blocks").groupBy(*keys)).applyInPandas(
            search, _FOUND)

    best = checkpointed(_first(met(asked, _searched(positives)), positives, "anchor"))
    wanted = best.groupBy(F.col("anchor").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    asking = asked.join(wanted, "id").withColumn("scores", F.col("scores.score"))
    found = _first(met(asking, _searched(negatives, low, high)), negatives, "anchor", "place")
    pairs = best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
