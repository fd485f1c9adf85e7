"""Cell-day features and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cellcast.functions.features import anomaly, flag_at_least, presence
from cellcast.operators.windows import TRAILING, trailing_means

# Classifier features in model order.
SPATIAL = ("lat", "lon")
TEMPORAL = ("month",)
RAW = ("sst_avg", "slp_avg", "u_wind_avg", "v_wind_avg", "wind_speed_env_avg", "oni_value", "phase")
ROLLING = tuple(out for n in TRAILING for out in TRAILING[n].values())
DERIVED = ("sst_above_threshold", "sst_anomaly", "slp_tendency")
ALL_FEATURES = (*SPATIAL, *TEMPORAL, *RAW, *ROLLING, *DERIVED)


def build_features(master: DataFrame, event: str = "SID", order: Sequence[str] = ("date",),
                   frame: str = "rows", chunk_rows: int | None = None) -> DataFrame:
    """Trailing means, derived features and the event label: one shuffle on the cell.

    ``master`` with one row per cell and day needs no ``chunk_rows`` (a history is as long as the
    calendar); a fanned-out master needs a total ``order`` and ``chunk_rows``.
    """
    trailing = trailing_means(master, ["lat", "lon"], list(order), TRAILING, frame, chunk_rows)
    return trailing.withColumns({
        "sst_above_threshold": flag_at_least("sst_avg"),
        "sst_anomaly": anomaly("sst_avg", "sst_180d_avg"),
        "slp_tendency": anomaly("slp_avg", "slp_7d_avg"),
        "is_event": presence(event),
    })
