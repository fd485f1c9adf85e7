"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cellcast.llm.text import groups, hashed_words
from cellcast.shared import checkpointed

# Labelled documents taken of each class, at most.
PER_CLASS = 8000
_SHINGLE = 5


@dataclass(frozen=True)
class LabelledSample:
    """``rows`` (doc_id, label, text), and how many labelled documents there are of class 0 and 1."""

    rows: DataFrame
    totals: tuple[int, int]


@F.pandas_udf(LongType())
def _signature(texts: pd.Series) -> pd.Series:
    """Smallest hash of a text's five-word shingles: equal for two texts with the odds of their overlap."""
    out = []
    for group in groups(texts):
        words, offsets = hashed_words(group)
        for a, b in zip(offsets, offsets[1:]):
            own = words[a:b]
            if len(own) >= _SHINGLE:
                n = len(own) - _SHINGLE + 1
                own = sum(own[k:k + n] * np.uint64(2 * k + 3) for k in range(_SHINGLE))
            out.append(int(own.min().view(np.int64)) if len(own) else 0)
    return pd.Series(out, dtype="int64")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, teaches: Column,
                    per_class: int = PER_CLASS, seed: int = 42) -> LabelledSample:
    """Up to ``per_class`` labelled documents of each class, those with the smallest seeded hash of id.

    Only rows of ``labels`` for which ``teaches`` holds, with an id and a label of 0 or 1, are looked
    at; several labels of one id count as 1 if any is. The chosen ids (a bounded number) are broadcast
    to one scan of ``docs``. Of near copies mostly one stays, so that a group of copies does not
    teach its own words. Documents without a label, or labels without a document, take no part.
    """
    known = labels.where(teaches & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(
        "doc_id").agg(F.max(label).cast("int").alias("label"))
    known = checkpointed(known)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class)
              for k in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    one = rows.groupBy(_signature(F.col("text")).alias("signature"), "label").agg(
        F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", "text")).alias("row"))
    return LabelledSample(checkpointed(one.select("row.doc_id", "label", "row.text")),
                          (totals.get(0, 0), totals.get(1, 0)))
