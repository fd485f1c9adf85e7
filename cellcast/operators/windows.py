"""Trailing windows, running totals and in-year changes.

Two rules keep a window's group bounded. Cell histories hold one row per cell and day after
``daily_mean``, so a group is at most as long as the calendar. Where rows fan out, ``chunk_rows``
splits a long history into overlapping pieces with the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cellcast.shared import checkpointed

FIRST, HERE = Window.unboundedPreceding, Window.currentRow
# A frame is put together from at most so many shorter ones; frames made for that have at least so many rows.
_MAX_PARTS, _LEAST_PART = 4, 5

# Trailing window lengths in days, the measures averaged over each, output names.
TRAILING = {
    7: {"sst_avg": "sst_7d_avg", "slp_avg": "slp_7d_avg", "wind_speed_env_avg": "wind_env_7d_avg"},
    14: {"sst_avg": "sst_14d_avg", "slp_avg": "slp_14d_avg"},
    30: {"sst_avg": "sst_30d_avg", "slp_avg": "slp_30d_avg"},
    90: {"sst_avg": "sst_90d_avg", "slp_avg": "slp_90d_avg"},
    180: {"sst_avg": "sst_180d_avg", "slp_avg": "slp_180d_avg"},
}


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | str,
             out: str = "row_no") -> DataFrame:
    """Row number within ``keys`` by ``order``, without sorting a key in one task.

    ``block`` must not decrease along ``order`` (e.g. its leading column). Rows are numbered within
    their block and shifted by the size of the key's earlier blocks, which come from a counting
    aggregate. Keys and block are compared as structs, so null is a key like any other.
    """
    blocked = df.withColumns({
        "_key": F.struct(*keys), "_block": F.struct(F.col(block) if isinstance(block, str) else block)})
    sizes = blocked.groupBy("_key", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(FIRST, -1)
    offsets = sizes.select("_key", "_block",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_key", "_block").orderBy(*order)
    rows = blocked.withColumn("_within", F.row_number().over(within))
    return rows.join(offsets, on=["_key", "_block"], how="inner").select(
        *df.columns, (F.col("_within") + F.col("_offset")).alias(out))


def trailing_means(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   spec: Mapping[int, Mapping[str, str]] = TRAILING, frame: str = "rows",
                   chunk_rows: int | None = None) -> DataFrame:
    """Trailing means of several lengths, all over one shuffle and one sort.

    ``rows`` counts rows including the current one; ``days`` counts calendar days of the first
    ``order`` column, so gaps shorten the window. Short prefixes average what exists and nulls are
    skipped. ``order`` must be total for ``rows`` to be repeatable. ``chunk_rows`` cuts each key
    into pieces of that many rows (with ``days``: of that many days), each carrying the rows before it that its
    windows reach back to.
    """
    keys, order = list(keys), list(order)
    if frame == "days":
        return _pieces_of_days(df, keys, F.unix_date(order[0]), spec, chunk_rows)
    if frame != "rows":
        raise ValueError(f"unknown frame {frame!r}")
    if chunk_rows is None:
        return _row_means(df, spec, Window.partitionBy(*keys).orderBy(*order))
    reach = max(spec) - 1
    if chunk_rows < reach:
        raise ValueError(f"chunk_rows must be at least {reach}")
    position = F.col("_row") - 1
    chunk = F.floor(position / chunk_rows)
    carried = position % chunk_rows >= chunk_rows - reach
    pieces = numbered(df, keys, order, order[0], "_row").withColumn(
        "_chunk", F.explode(F.when(carried, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    piece = Window.partitionBy(*keys, "_chunk").orderBy("_row")
    means = _row_means(pieces, spec, piece)
    outs = [out for measures in spec.values() for out in measures.values()]
    return means.filter(F.col("_chunk") == chunk).select(*df.columns, *outs)


def _pieces_of_days(df: DataFrame, keys: list[str], day: Column, spec: Mapping[int, Mapping[str, str]],
                    chunk_days: int | None) -> DataFrame:
    """A row goes to the piece of its day and to the later ones whose windows reach back to it, by arithmetic on
    its own day: no numbering, and a hot key is spread over its calendar."""
    if chunk_days is None:
        return df.select("*", *_day_means(spec, Window.partitionBy(*keys).orderBy(day)))
    own = F.floor(day / chunk_days)
    reached = F.sequence(own, F.floor((day + (max(spec) - 1)) / chunk_days))
    # A row without a day has a window of its own kind, the other rows without one.
    pieces = df.withColumns({"_day": day, "_piece": F.explode(F.coalesce(reached, F.array(own)))})
    means = pieces.select("*", *_day_means(spec, Window.partitionBy(*keys, "_piece").orderBy("_day")))
    outs = [out for measures in spec.values() for out in measures.values()]
    return means.filter(F.col("_piece").eqNullSafe(F.floor(F.col("_day") / chunk_days))).select(*df.columns, *outs)


def _day_means(spec: Mapping[int, Mapping[str, str]], window: WindowSpec) -> list[Column]:
    return [F.avg(src).over(window.rangeBetween(-(n - 1), HERE)).alias(out)
            for n, measures in spec.items() for src, out in measures.items()]


def _row_means(df: DataFrame, spec: Mapping[int, Mapping[str, str]],
               window: WindowSpec) -> DataFrame:
    """``df`` with the trailing means of ``spec`` over a row window.

    A frame of n rows costs n steps per row, so long frames are put together from the sums of
    shorter ones where the lengths divide (180 = 90 + 90, 90 = 30 + 30 + 30); where no shorter one is
    asked for, one is made (30 = 10 + 10 + 10). Sums are only ever added, never subtracted, so nothing
    is lost to cancellation.
    """
    parts: dict[tuple[int, str], int] = {}
    for n in sorted(spec):
        for src in spec[n]:
            shorter = [m for m, s in parts if s == src and n % m == 0 and n // m <= _MAX_PARTS]
            parts[n, src] = max(shorter, default=n)
    for n, src in [key for key, m in parts.items() if key[0] == m]:
        made = [n // k for k in range(2, _MAX_PARTS + 1) if n % k == 0 and n // k >= _LEAST_PART]
        if made:
            parts[n, src] = min(made)
            parts[min(made), src] = min(made)
    direct = [(n, src) for (n, src), m in parts.items() if m == n]
    columns = df.columns
    df = df.withColumns({
        f"_{kind}{n}_{src}": fold(src).over(window.rowsBetween(-(n - 1), HERE))
        for n, src in direct for kind, fold in (("sum", F.sum), ("count", F.count))})
    df = df.withColumns({f"_sum{n}_{src}": F.coalesce(f"_sum{n}_{src}", F.lit(0.0))
                         for n, src in direct})
    for n in sorted({n for (n, _), m in parts.items() if m != n}):
        df = df.withColumns({
            f"_{kind}{n}_{src}": sum(
                (F.lag(f"_{kind}{m}_{src}", k * m, zero).over(window) for k in range(1, n // m)),
                F.col(f"_{kind}{m}_{src}"))
            for (length, src), m in parts.items() if length == n and m != n
            for kind, zero in (("sum", 0.0), ("count", 0))})
    return df.select(*columns, *[
        (F.col(f"_sum{n}_{src}") / F.nullif(F.col(f"_count{n}_{src}"), F.lit(0))).alias(out)
        for n, measures in spec.items() for src, out in measures.items()])


def trailing_in_group(df: DataFrame, cols: Sequence[str], n: int = 3,
                      group: Sequence[str] = ("year",), order: Sequence[str] = ("month",),
                      suffix: str = "_3m_avg") -> DataFrame:
    """Trailing mean over ``n`` rows that restarts in every group (a year has at most 12 rows)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(n - 1), HERE)
    return df.withColumns({f"{c}{suffix}": F.coalesce(F.avg(c).over(w), F.lit(0.0)) for c in cols})


def ytd_before(df: DataFrame, col: str = "actual_count", out: str = "cumulative_ytd",
               group: Sequence[str] = ("year",), order: Sequence[str] = ("month",)) -> DataFrame:
    """Sum over the group's earlier rows, without the current one; 0 in the first."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(FIRST, -1)
    return df.withColumn(out, F.coalesce(F.sum(col).over(w).cast("double"), F.lit(0.0)))


def diff_in_group(df: DataFrame, col: str = "driver", out: str = "driver_momentum",
                  group: Sequence[str] = ("year",), order: Sequence[str] = ("month",)) -> DataFrame:
    """Change from the group's previous row; 0 in the first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.coalesce(F.col(col) - F.lag(col).over(w), F.lit(0.0)))


def momentum(df: DataFrame, col: str = "monthly_index", lag: str | None = None,
             out: str = "index_momentum") -> DataFrame:
    """Change from the previous calendar month, whose value ``calendar_lag`` supplied."""
    return df.withColumn(out, F.col(col) - F.col(lag or f"{col}_lag1"))


def score_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (and key)."""
    return df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("neg"))


def running_totals(scores: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                   order: str = "score", descending: bool = False,
                   blocks: int = 256) -> DataFrame:
    """Inclusive running sums of ``cols`` along ``order`` as ``cum_<col>``, split over tasks.

    Approximate quantiles of ``order`` (a mergeable sketch; ``blocks - 1`` numbers reach the driver)
    cut the rows into about equal blocks. The sums run within a block and are shifted by the totals
    of the blocks before it: exact, whatever the cuts. ``scores`` is read three times, so it is
    checkpointed first.
    """
    scores = checkpointed(scores)
    blocks = max(2, blocks)
    cut = QuantileDiscretizer(numBuckets=blocks, inputCol=order, outputCol="_block",
                              relativeError=1.0 / (4 * blocks), handleInvalid="keep").fit(scores)
    blocked = cut.transform(scores).withColumn("_key", F.struct(F.lit(0), *keys))
    if descending:
        blocked = blocked.withColumn("_block", -F.col("_block"))
    along = F.col(order).desc() if descending else F.col(order).asc()
    within = Window.partitionBy("_key", "_block").orderBy(along).rowsBetween(FIRST, HERE)
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(FIRST, -1)
    totals = blocked.groupBy("_key", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    offsets = totals.select("_key", "_block", *[
        F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in cols])
    rows = blocked.select("*", *[F.sum(c).over(within).alias(f"_in_{c}") for c in cols])
    return rows.join(offsets, on=["_key", "_block"], how="inner").select(
        *scores.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in cols])
