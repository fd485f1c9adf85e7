"""Aggregations; every one is a partial-aggregating ``groupBy`` so a hot key is combined map-side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellcast.functions.dates import season
from cellcast.functions.features import PROB_HIGH, PROB_SOFT, classify_phase, soft_threshold
from cellcast.functions.grid import Box, in_snapped_box, snap
from cellcast.operators.windows import running_totals
from cellcast.shared import checkpointed, small, value_of

MONTH = ("year", "month")
# Outcome codes, in report order and in matrix order.
OUTCOMES = ("VN", "PH", "CN", "JP", "TW", "None")
MATRIX_OUTCOMES = ("CN", "JP", "None", "PH", "TW", "VN")


def _count(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def daily_mean(df: DataFrame, keys: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """Mean of each measure (``{input: output}``) per key; nulls are skipped, NaN counts as null."""
    return df.groupBy(*keys).agg(*[
        F.avg(F.nanvl(F.col(src).cast("double"), F.lit(None))).alias(out)
        for src, out in measures.items()])


def snap_then_mean(df: DataFrame, measures: dict[str, str], lat: Box = (0.0, 30.0),
                   lon: Box | None = (100.0, 180.0), date: str = "date",
                   per_unit: float = 4.0) -> DataFrame:
    """Second source aligned to the grid: snap, keep the box, then mean per cell and day.

    The box is decided on the raw coordinates, so it can be pushed into the scan and the snap is
    computed once per kept row.
    """
    snapped = in_snapped_box(df, lat, lon, per_unit).withColumns(
        {"lat": snap("lat", per_unit), "lon": snap("lon", per_unit)})
    return daily_mean(snapped, ["lat", "lon", date], measures)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: positives, negatives and the whole-number ratio between them."""
    counts = df.agg(_count(F.col(label) == 1).alias("pos"), _count(F.col(label) == 0).alias("neg"))
    return counts.select("pos", "neg",
                         F.floor(F.col("neg") / F.greatest("pos", F.lit(1))).alias("ratio"))


def split_balance(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Class counts, total and ratio per split."""
    counts = df.groupBy(split).agg(
        _count(F.col(label) == 1).alias("pos"), _count(F.col(label) == 0).alias("neg"),
        F.count(F.lit(1)).alias("total"))
    return counts.withColumn("ratio", F.floor(F.col("neg") / F.greatest("pos", F.lit(1))))


def weighted_sums(p: str, weights: Sequence[str], prefix: str = "prob_") -> list[Column]:
    """Sum of p times each outcome weight, named ``index_<outcome>``."""
    return [F.sum(F.col(p) * F.col(w)).alias(f"index_{w.removeprefix(prefix)}") for w in weights]


def monthly_index(df: DataFrame, p: str = "prob", weights: Sequence[str] = (),
                  driver: str | None = None, keys: Sequence[str] = MONTH,
                  soft: float = PROB_SOFT, high: float = PROB_HIGH) -> DataFrame:
    """Monthly roll-up of event probabilities, per outcome where weights are given, in one pass."""
    aggs = [
        F.sum(p).alias("monthly_index"),
        F.sum(soft_threshold(p, soft)).alias("monthly_index_thresh"),
        _count(F.col(p) > high).alias("monthly_index_count"),
        F.avg(p).alias("monthly_index_density"),
        F.count(F.lit(1)).alias("cell_count"),
        *weighted_sums(p, weights),
    ]
    if driver is not None:
        aggs.append(F.avg(driver).alias("driver"))
    return df.groupBy(*keys).agg(*aggs).withColumn(
        "monthly_index_log", F.log1p(F.col("monthly_index")))


def monthly_distinct(df: DataFrame, id_col: str = "SID", keys: Sequence[str] = MONTH,
                     out: str = "actual_count") -> DataFrame:
    """Distinct ids per month: ids are reduced per (month, id) before the months are counted."""
    return df.groupBy(*keys).agg(F.countDistinct(id_col).alias(out))


def monthly_distinct_by(df: DataFrame, id_col: str = "SID", target: str = "outcome",
                        values: Sequence[str] = OUTCOMES, keys: Sequence[str] = MONTH,
                        prefix: str = "actual_") -> DataFrame:
    """Distinct ids per month, in total and per target value.

    One row per (month, id) with a flag per target first; then plain sums. Spark's own plan for
    several conditional distinct counts would multiply the rows by the number of targets.
    """
    flags = {v: F.max(F.when(F.col(target) == v, 1).otherwise(0)).alias(f"_{v}") for v in values}
    ids = df.filter(F.col(id_col).isNotNull()).groupBy(*keys, id_col).agg(*flags.values())
    counted = ids.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}count"),
        *[F.sum(f"_{v}").alias(f"{prefix}{v}") for v in values])
    return counted


def entity_months(df: DataFrame, id_col: str = "SID", keys: Sequence[str] = MONTH) -> DataFrame:
    """Unique (id, year, month): an event that spans two months gives two rows."""
    return df.select(id_col, *keys).dropDuplicates()


def summary(df: DataFrame, id_col: str = "SID", year: str = "year") -> DataFrame:
    """Rows, distinct ids, first and last year."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.countDistinct(id_col).alias("distinct_ids"),
                  F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def null_profile(df: DataFrame, cols: Sequence[str], event: str = "SID") -> DataFrame:
    """Rows, rows with and without an event, and nulls per column, all in one scan."""
    total = F.count(F.lit(1))
    aggs = [total.alias("total_rows"), F.count(event).alias("event_rows"),
            (total - F.count(event)).alias("other_rows"),
            (F.count(event) / total * 100).alias("event_pct")]
    for c in cols:
        nulls = total - F.count(c)
        aggs += [nulls.alias(f"{c}_nulls"), (nulls / total * 100).alias(f"{c}_null_pct")]
    return df.agg(*aggs)


def phase_distribution(df: DataFrame, phase: str = "phase") -> DataFrame:
    """Rows per phase, in phase order."""
    return df.groupBy(phase).agg(F.count(F.lit(1)).alias("row_count")).orderBy(phase)


def cell_visits(df: DataFrame, id_col: str = "SID", cell: Sequence[str] = ("lat_grid", "lon_grid"),
                outcome: str = "outcome") -> DataFrame:
    """Unique (id, cell, outcome): a slow event does not weigh more than a fast one."""
    return df.select(id_col, *cell, outcome).dropDuplicates()


def outcome_crosstab(visits: DataFrame, values: Sequence[str] = MATRIX_OUTCOMES,
                     cell: Sequence[str] = ("lat_grid", "lon_grid"), outcome: str = "outcome",
                     where: Column | None = None) -> DataFrame:
    """Visits per cell and outcome, one column per value, 0 where none.

    ``where`` restricts the visits, e.g. to the train years, so test outcomes do not leak into the
    matrix.
    """
    if where is not None:
        visits = visits.filter(where)
    return visits.groupBy(*cell).agg(*[_count(F.col(outcome) == v).alias(v) for v in values])


def outcome_prior(visits: DataFrame, values: Sequence[str] = MATRIX_OUTCOMES,
                  outcome: str = "outcome") -> DataFrame:
    """One row: the share of each outcome among all visits that have one, 0 where none."""
    known = F.count(outcome)
    return visits.agg(*[
        F.coalesce(_count(F.col(outcome) == v) / F.nullif(known, F.lit(0)), F.lit(0.0)).alias(v)
        for v in values])


# Fixed value: pseudo-visits with which a cell is drawn towards the prior.
PSEUDO_VISITS = 5.0


def smooth_transition(counts: DataFrame, prior: DataFrame,
                      values: Sequence[str] = MATRIX_OUTCOMES, alpha: float = PSEUDO_VISITS,
                      cell: Sequence[str] = ("lat_grid", "lon_grid")) -> DataFrame:
    """Outcome probabilities per cell, smoothed towards the prior: columns ``prob_<outcome>``."""
    share = value_of(prior)
    visits = sum((F.col(v) for v in values), F.lit(0))
    return counts.select(*cell, *[
        ((F.col(v) + alpha * share.getField(v)) / (visits + alpha)).alias(f"prob_{v}")
        for v in values])


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Events per outcome."""
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("events"))


def feature_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of column means, nulls and NaN skipped; give it the train split only."""
    return df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in cols])


def months_per_year(df: DataFrame, min_months: int = 6, year: str = "year") -> DataFrame:
    """Months per year and whether the year has too few."""
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("months")).withColumn(
        "incomplete", F.col("months") < min_months)


def annual_rollup(df: DataFrame, targets: Sequence[str] = ("count",),
                  year: str = "year") -> DataFrame:
    """Yearly sums of actual and predicted per target, and actual minus predicted."""
    sums = df.groupBy(year).agg(*[
        F.sum(f"{kind}_{t}").alias(f"annual_{kind}_{t}")
        for t in targets for kind in ("actual", "pred")])
    return sums.withColumns({
        f"error_{t}": F.col(f"annual_actual_{t}") - F.col(f"annual_pred_{t}") for t in targets})


def climatology(df: DataFrame, cols: Sequence[str], test: Column,
                month: str = "month") -> DataFrame:
    """Mean by calendar month over all years and over the test years."""
    return df.groupBy(month).agg(
        *[F.avg(c).alias(f"{c}_all") for c in cols],
        *[F.avg(F.when(test, F.col(c))).alias(f"{c}_test") for c in cols])


def residual_histogram(df: DataFrame, col: str = "residual", width: float = 0.5) -> DataFrame:
    """Occupied bins of ``width`` from min - ``width``: left edge and count."""
    low = value_of(df.agg((F.min(col) - width).alias("low"))).getField("low")
    bins = df.filter(F.col(col).isNotNull()).select(
        F.floor((F.col(col) - low) / width).alias("bin"), low.alias("low"))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("row_count"),
                                   F.first("low").alias("low")).select(
        "bin", (F.col("low") + F.col("bin") * width).alias("left_edge"), "row_count")


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation over rows where both are present."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("r"))


def peak_month(df: DataFrame, count: str = "actual_count", year: str = "year",
               month: str = "month") -> DataFrame:
    """Month with the largest count per year, the earliest on ties, -1 when all are zero."""
    best = F.min_by(month, F.struct(-F.col(count), F.col(month)))
    return df.groupBy(year).agg(
        F.when(F.max(count) > 0, best).otherwise(F.lit(-1)).alias("peak_month"))


def year_metrics(df: DataFrame, actual: str = "actual_count", pred: str = "pred_count",
                 year: str = "year") -> DataFrame:
    """Yearly totals (prediction to one digit) and mean absolute error over predicted months."""
    return df.groupBy(year).agg(
        F.sum(actual).alias("actual_total"), F.round(F.sum(pred), 1).alias("pred_total"),
        F.round(F.avg(F.abs(F.col(actual) - F.col(pred))), 2).alias("mae"))


def year_phase(df: DataFrame, driver: str = "driver", year: str = "year") -> DataFrame:
    """Yearly mean of the monthly driver and its phase."""
    return df.groupBy(year).agg(F.avg(driver).alias("mean_driver")).withColumn(
        "phase", classify_phase("mean_driver"))


def season_totals(df: DataFrame, actual: str = "actual_count", month: str = "month") -> DataFrame:
    """Months and events per season."""
    return df.groupBy(season(month).alias("season")).agg(
        F.count(F.lit(1)).alias("months"), F.sum(actual).alias("events"))


def phase_frequency(df: DataFrame, id_col: str = "SID",
                    keys: Sequence[str] = ("year", "phase")) -> DataFrame:
    """Distinct events per year and phase."""
    return monthly_distinct(df, id_col, keys, "events")


def neighbourhood_mean(cells: DataFrame, col: str, radius: float = 1.0, step: float = 0.25,
                       keys: Sequence[str] = ("date",), lat: str = "lat",
                       lon: str = "lon") -> DataFrame:
    """Mean of ``col`` over the cells within ``radius`` degrees of each cell, itself included.

    A cell sends one copy to each row of cells its disc touches; there the copies of each row distance are summed
    over a range of columns as wide as the disc is at that distance. Only cells present in the input receive.
    """
    reach = int(radius / step)
    half = [int(math.sqrt(max(0.0, (radius / step) ** 2 - i * i)) + 1e-9) for i in range(reach + 1)]
    own = cells.groupBy(*keys, F.round(F.col(lat) / step).cast("bigint").alias("_r"),
                        F.round(F.col(lon) / step).cast("bigint").alias("_c")).agg(
        F.sum(col).alias("_v"), F.count(col).alias("_n"))
    copies = own.select(*keys, "_r", "_c", "_v", "_n", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_i"))
    copies = copies.withColumn("_r", F.col("_r") + F.col("_i"))
    row = Window.partitionBy(*keys, "_r").orderBy("_c")
    summed = {f"_{name}{i}": F.coalesce(F.sum(F.when(F.abs("_i") == i, F.col(name))).over(
        row.rangeBetween(-half[i], half[i])), F.lit(0)) for i in range(reach + 1) for name in ("_v", "_n")}
    total = {name: sum(F.col(f"_{name}{i}") for i in range(reach + 1)) for name in ("_v", "_n")}
    return copies.withColumns(summed).filter("_i = 0").select(
        *keys, (F.col("_r") * step).alias(lat), (F.col("_c") * step).alias(lon),
        (total["_v"] / F.nullif(total["_n"], F.lit(0))).alias(f"{col}_near"))


def mass_centre(df: DataFrame, score: str = "prob", at: str = "lon", share: float = 0.05,
                keys: Sequence[str] = MONTH) -> DataFrame:
    """Score-weighted mean of ``at`` over the rows of each key at or above the (1 - share) quantile.

    The cut is exact: the smallest score up to which that share of the key's rows lies, read off the running counts
    of its distinct scores, which are summed block by block; no key is sorted whole.
    """
    keys = list(keys)
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_rows"))
    running = checkpointed(running_totals(counts, ["_rows"], keys, order=score))
    wanted = running.groupBy(*keys).agg(F.ceil((1.0 - share) * F.sum("_rows") - 1e-9).alias("_wanted"))
    cuts = running.join(small(wanted), on=keys).filter("cum__rows >= _wanted").groupBy(*keys).agg(
        F.min(score).alias("_cut"))
    top = df.join(small(checkpointed(cuts)), on=keys).filter(F.col(score) >= F.col("_cut"))
    return top.groupBy(*keys).agg(
        (F.sum(F.col(score) * F.col(at)) / F.nullif(F.sum(score), F.lit(0.0))).alias("mass_centre"))


def latest_year(df: DataFrame, year: str = "year", month: str = "month",
                sums: Sequence[str] = ("actual_count", "pred_count")) -> DataFrame:
    """Months of the last year and their total (month null)."""
    last = value_of(df.agg(F.max(year).alias("y"))).getField("y")
    return (df.filter(F.col(year) == last).rollup(month)
            .agg(F.max(year).alias(year), *[F.sum(c).alias(c) for c in sums]))


def climate_analogs(df: DataFrame, value: str = "driver", months: Sequence[int] = (1, 2, 3, 4, 5),
                    k: int = 3, year: str = "year", month: str = "month") -> DataFrame:
    """The ``k`` nearest other years of each year by Euclidean distance of their early months.

    Only years with every month take part. Years are joined on the calendar month, and the squared
    differences are summed: at most (years squared x months) small rows whatever the input size.
    """
    monthly = df.filter(F.col(month).isin(*months) & F.col(value).isNotNull()).groupBy(
        year, month).agg(F.avg(value).alias("_v"))
    full = monthly.groupBy(year).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") == len(months)).select(year)
    vectors = monthly.join(full, on=year, how="left_semi")
    other = vectors.select(F.col(year).alias("analog_year"), month, F.col("_v").alias("_w"))
    pairs = (vectors.join(other, on=month).filter(F.col(year) != F.col("analog_year"))
             .groupBy(year, "analog_year")
             .agg(F.sqrt(F.sum((F.col("_v") - F.col("_w")) ** 2)).alias("distance")))
    nearest = Window.partitionBy(year).orderBy(F.round("distance", 9), "analog_year")
    return pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
