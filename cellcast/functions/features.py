"""Labels, flags, derived features and feature lists."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phase codes and the driver bounds that separate them.
NEUTRAL, WARM, COLD = 0, 1, 2
WARM_AT, COLD_AT = 0.5, -0.5

# Thresholds on surface temperature and on event probability.
WARM_SURFACE = 26.5
PROB_SOFT = 0.10
PROB_HIGH = 0.30

# Intensity class bounds in km/h.
INTENSITY_BOUNDS = (63.0, 118.0)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_phase(c: Column | str, hi: float = WARM_AT, lo: float = COLD_AT) -> Column:
    """1 at or above ``hi``, 2 at or below ``lo``, else 0; null counts as 0."""
    c = _col(c)
    return F.when(c >= hi, F.lit(WARM)).when(c <= lo, F.lit(COLD)).otherwise(F.lit(NEUTRAL))


def presence(c: Column | str) -> Column:
    """1 where ``c`` is present, else 0."""
    return F.when(_col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))


def flag_at_least(c: Column | str, bound: float = WARM_SURFACE) -> Column:
    """1 where ``c >= bound``, else 0; null counts as 0."""
    return F.when(_col(c) >= bound, F.lit(1)).otherwise(F.lit(0))


def anomaly(c: Column | str, base: Column | str) -> Column:
    """Departure of ``c`` from its trailing mean ``base``."""
    return _col(c) - _col(base)


def soft_threshold(c: Column | str, bound: float = PROB_SOFT) -> Column:
    """``c`` where it is strictly above ``bound``, else 0."""
    c = _col(c)
    return F.when(c > bound, c).otherwise(F.lit(0.0))


def log_index(c: Column | str) -> Column:
    """log(1 + c) with negative c taken as 0."""
    return F.log1p(F.greatest(_col(c).cast("double"), F.lit(0.0)))


def intensity_class(c: Column | str, bounds: tuple[float, float] = INTENSITY_BOUNDS) -> Column:
    """TD below the first bound, TS up to and including the second, TY above."""
    c = _col(c)
    return F.when(c < bounds[0], F.lit("TD")).when(c <= bounds[1], F.lit("TS")).when(
        c.isNotNull(), F.lit("TY"))


def phase_interactions(df: DataFrame, index: str = "monthly_index",
                       driver: str = "driver") -> DataFrame:
    """Phase flags and the index gated by the driver and by each flag."""
    x, d = F.col(index).cast("double"), F.col(driver).cast("double")
    warm = (F.coalesce(d >= WARM_AT, F.lit(False))).cast("double")
    cold = (F.coalesce(d <= COLD_AT, F.lit(False))).cast("double")
    return df.withColumns({
        "is_warm": warm, "is_cold": cold,
        "index_x_driver": x * d, "index_x_warm": x * warm, "index_x_cold": x * cold,
        "driver_abs": F.abs(d),
    })


def cyclical(df: DataFrame, col: str = "month", index: str | None = "monthly_index",
             period: int = 12) -> DataFrame:
    """Sine and cosine of ``col`` over ``period``, and the index times each."""
    angle = F.col(col) * F.lit(2.0 * math.pi) / F.lit(float(period))
    out = {f"{col}_sin": F.sin(angle), f"{col}_cos": F.cos(angle)}
    if index is not None:
        out |= {f"index_x_{name}": F.col(index) * expr for name, expr in list(out.items())}
    return df.withColumns(out)


def one_hot(df: DataFrame, col: str = "month", values: Sequence[int] = tuple(range(1, 13)),
            index: str | None = "monthly_index") -> DataFrame:
    """One 0/1 double per value, and the index times each."""
    flags = {f"{col}_{v}": (F.col(col) == v).cast("double") for v in values}
    if index is not None:
        flags |= {f"index_x_{n}": F.col(index) * e for n, e in list(flags.items())}
    return df.withColumns(flags)


# Last train year and last validation year of the event classifier.
SPLIT_YEARS = (2015, 2019)


def split_label(year: Column | str, bounds: tuple[int, int] = SPLIT_YEARS) -> Column:
    """Train up to the first bound, Val up to the second, Test beyond (and where year is null)."""
    y = _col(year)
    return F.when(y <= bounds[0], F.lit("Train")).when(
        y.between(bounds[0] + 1, bounds[1]), F.lit("Val")).otherwise(F.lit("Test"))


def select_features(df: DataFrame, keys: Sequence[str], *groups: Sequence[str]) -> DataFrame:
    """``keys`` and the feature groups in order, each column once."""
    names = list(dict.fromkeys([*keys, *[c for g in groups for c in g]]))
    return df.select(*names)


def route_features(base: Mapping[str, Sequence[str]], target: str,
                   total: str = "count") -> list[str]:
    """Feature names for one target: ``{index}`` in a name becomes the target's own index.

    ``base`` has the keys ``total`` and ``target``; the total uses the first list.
    """
    names = base["total"] if target == total else base["target"]
    return list(dict.fromkeys(n.format(index=f"index_{target}") for n in names))


def residual(pred: Column | str, actual: Column | str) -> Column:
    """Predicted minus actual."""
    return _col(pred) - _col(actual)


def annual_error(actual: Column | str, pred: Column | str) -> Column:
    """Actual minus predicted: the yearly report uses the opposite sign of ``residual``."""
    return _col(actual) - _col(pred)
