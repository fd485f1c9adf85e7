"""User scorers over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  schema: StructType | str) -> DataFrame:
    """Rows scored by user code over Arrow batches, with a declared output schema.

    ``load`` runs once per task and returns the function applied to each batch, so a model is read
    once and not per batch. Spark ML models do not need this; use ``models.score``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)
