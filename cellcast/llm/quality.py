"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cellcast.llm.samples import LabelledSample
from cellcast.llm.text import GROUP_CHARS, RUNS, groups, hashed_words, pieces

THRESHOLD = 0.5
BUCKET_BITS = 13
DIMENSIONS = 24
NONZERO = 4
WINDOW = 2
HIDDEN = 32
EPOCHS = 300
# Words more frequent than this share of all words weigh less.
COMMON = 1e-3


def index_vectors(seed: int = 42) -> np.ndarray:
    """A sparse ternary vector for every bucket."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    place = np.argsort(rng.random((size, DIMENSIONS)), axis=1)[:, :NONZERO]
    out = np.zeros((size, DIMENSIONS), dtype=np.int16)
    np.put_along_axis(out, place, np.where(np.arange(NONZERO) % 2, -1, 1)[None, :], axis=1)
    return out


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and runs of signs (case kept), and where each text begins."""
    words, offsets = hashed_words(texts, RUNS, lower=False)
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16), offsets


def context_sums(bucket: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present and the sum of their neighbours' index vectors, within texts."""
    near = np.zeros((len(bucket), DIMENSIONS), dtype=np.int16)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = index[bucket]
    for shift in range(1, WINDOW + 1):
        same = (text[shift:] == text[:-shift])[:, None]
        near[:-shift] += own[shift:] * same
        near[shift:] += own[:-shift] * same
    order = np.argsort(bucket, kind="stable")
    present, first = np.unique(bucket[order], return_index=True)
    return present, np.add.reduceat(near[order], first, axis=0, dtype=np.int64)


_SUMS = "bucket int, n long, " + ", ".join(f"v{k} long" for k in range(DIMENSIONS))


@dataclass(frozen=True)
class WordVectors:
    """One unit vector per bucket, weighted down for common words."""

    matrix: np.ndarray

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """Mean and spread of a text's word vectors, the length of the mean, and the log of the word
        count; all zero for a text without words."""
        rows = []
        for group in groups(texts):
            parts = [group] if len(group) > 1 or len(group[0]) <= GROUP_CHARS else [
                [p] for p in pieces(group[0])]
            total = np.zeros((len(group), 2 * DIMENSIONS))
            count = np.zeros(len(group))
            for part in parts:
                bucket, offsets = _buckets(part)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                if len(full):
                    own = self.matrix[bucket]
                    both = np.concatenate((own, own * own), axis=1)
                    total[full] += np.add.reduceat(both, offsets[full], axis=0, dtype=np.float64)
                    count += n if len(part) == len(group) else n.sum()
            mean = total / np.maximum(count, 1)[:, None]
            middle = mean[:, :DIMENSIONS]
            spread = np.sqrt(np.maximum(0.0, mean[:, DIMENSIONS:] - middle * middle))
            rows.append(np.column_stack((middle, spread, np.linalg.norm(middle, axis=1),
                                         np.log1p(count))))
        return np.concatenate(rows) if rows else np.zeros((0, 2 * DIMENSIONS + 2))


def fit_vectors(docs: DataFrame, text_column: str = "text", seed: int = 42) -> WordVectors:
    """Random indexing over every text of ``docs``: a word's vector is the sum of its neighbours' index
    vectors. Words are hashed to ``2**13`` buckets; a task adds up its own texts first and sends at
    most one row per bucket, the sums are whole numbers (any order gives the same), and what comes to
    the driver is one row per bucket, whatever the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(index_vectors(seed))
    size = 1 << BUCKET_BITS

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((size, DIMENSIONS), dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            for group in groups(batch["text"]):
                for part in ([group] if len(group) > 1 else [[p] for p in pieces(group[0])]):
                    bucket, offsets = _buckets(part)
                    if len(bucket):
                        present, sums = context_sums(bucket, offsets, held.value)
                        total[present] += sums
                        count += np.bincount(bucket, minlength=size)
        seen = np.flatnonzero(count)
        out = pd.DataFrame(total[seen], columns=[f"v{k}" for k in range(DIMENSIONS)])
        out.insert(0, "n", count[seen])
        out.insert(0, "bucket", seen.astype(np.int32))
        yield out

    sums = docs.select(F.col(text_column).alias("text")).dropna().mapInPandas(add_up, _SUMS)
    table = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).toPandas()
    matrix = np.zeros((size, DIMENSIONS), dtype=np.float32)
    if len(table):
        vectors = table.iloc[:, 2:].to_numpy(dtype=np.float64)
        share = table["n"].to_numpy() / table["n"].sum()
        norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
        matrix[table["bucket"]] = vectors / norm[:, None] * (COMMON / (COMMON + share))[:, None]
    return WordVectors(matrix)


@dataclass(frozen=True)
class QualityModel:
    """Vectors, the scaling of the pooled features, the network, and its temperature."""

    vectors: WordVectors
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _probability(self.logits(self.vectors.pooled(texts)) / self.temperature)

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2


def _probability(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Adam on the weighted log loss with a small decay."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for rows in np.array_split(order, max(1, len(x) // 2048)):
            a = np.tanh(x[rows] @ parts[0] + parts[1])
            d = w[rows] * (_probability(a @ parts[2] + parts[3]) - y[rows]) / w[rows].sum()
            back = np.outer(d, parts[2]) * (1 - a * a)
            slopes = [x[rows].T @ back + 1e-4 * parts[0], back.sum(axis=0),
                      a.T @ d + 1e-4 * parts[2], np.array([d.sum()])]
            step += 1
            for p, g, m, v in zip(parts, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return parts[0], parts[1], parts[2], float(parts[3][0])


def _temperature(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows the network has not seen."""
    if len(np.unique(y)) < 2:
        return 1.0
    tried = np.exp(np.linspace(np.log(0.25), np.log(8.0), 141))
    losses = [(w * np.logaddexp(0.0, np.where(y == 1, -z, z) / t)).sum() for t in tried]
    return float(tried[int(np.argmin(losses))])


def fit_quality(sample: LabelledSample, vectors: WordVectors, seed: int = 42) -> QualityModel:
    """Network and temperature from a bounded labelled sample; a fifth of it is kept for the latter.

    Classes weigh as among all labelled documents. Without a label of each class every score is the
    share of label 1 (0.5 if there are none)."""
    held = sample.rows.sparkSession.sparkContext.broadcast(vectors)
    rows = sample.rows.select("doc_id", "label", _pool_udf(held)(F.col("text")).alias("x")).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    y = rows["label"].to_numpy(dtype=np.float64)
    width = 2 * DIMENSIONS + 2
    share = sample.totals[1] / sum(sample.totals) if sum(sample.totals) else 0.5
    if len(np.unique(y)) < 2:
        even = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return QualityModel(vectors, np.zeros(width), np.ones(width), (
            np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(even)), 1.0)
    x = np.array(rows["x"].tolist())
    w = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    kept = np.random.default_rng(seed).random(len(y)) < 0.2
    model = QualityModel(vectors, mean, scale,
                         _train(((x - mean) / scale)[~kept], y[~kept], w[~kept], seed), 1.0)
    return QualityModel(vectors, mean, scale, model.layers,
                        _temperature(model.logits(x[kept]), y[kept], w[kept]))


def _pool_udf(held):
    @F.pandas_udf(ArrayType(DoubleType()))
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(held.value.pooled(list(texts))), dtype="object")
    return pool


def score_quality(docs: DataFrame, model: QualityModel, text_column: str = "text",
                  score_name: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of good quality of each whole text (0 to 1). Null and
    empty texts are scored as texts without words. An existing column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(list(texts)), dtype="float64")

    return docs.withColumn(score_name, score(F.col(text_column)))
