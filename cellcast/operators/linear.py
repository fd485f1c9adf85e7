"""Exact small regressions from sufficient statistics.

A fit is one partial-aggregating pass to a few sums per group and a closed form on them, so the
cost is a scan whatever the number of folds or targets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.shared import small, value_of


def standardise(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                suffix: str = "_z") -> DataFrame:
    """Zero mean and unit population variance, fitted on ``fit_on``; constant columns become 0."""
    row = value_of((fit_on if fit_on is not None else df).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))

    def scaled(c: str) -> Column:
        spread = row.getField(f"s_{c}")
        return (F.col(c) - row.getField(f"m_{c}")) / F.when(spread > 0, spread).otherwise(1.0)

    return df.withColumns({f"{c}{suffix}": scaled(c) for c in cols})


# Fixed value: penalty on the squared stack weights.
STACK_PENALTY = 1.0


def fit_stack(df: DataFrame, x1: str, x2: str, y: str, alpha: float = STACK_PENALTY,
              by: Sequence[str] = ()) -> DataFrame:
    """Ridge on two base predictions with weights >= 0 and a free intercept: ``w1, w2, intercept``.

    The problem is convex with two unknowns, so the optimum is the free solution if it is
    admissible, else the better of the two one-feature solutions, else zero.
    """
    n = F.count(F.lit(1))
    rows = df.filter(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull())
    s = rows.groupBy(*by).agg(
        n.alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
        (F.var_pop(x1) * n + alpha).alias("a"), (F.var_pop(x2) * n + alpha).alias("d"),
        (F.covar_pop(x1, x2) * n).alias("b"),
        (F.covar_pop(x1, y) * n).alias("p"), (F.covar_pop(x2, y) * n).alias("q"))
    a, b, d, p, q = (F.col(c) for c in "abdpq")
    det = F.nullif(a * d - b * b, F.lit(0.0))
    free1, free2 = (d * p - b * q) / det, (a * q - b * p) / det
    only1 = F.greatest(p / F.nullif(a, F.lit(0.0)), F.lit(0.0))
    only2 = F.greatest(q / F.nullif(d, F.lit(0.0)), F.lit(0.0))
    admissible = F.coalesce((free1 >= 0) & (free2 >= 0), F.lit(False))
    first = F.coalesce(only1 * p, F.lit(0.0)) >= F.coalesce(only2 * q, F.lit(0.0))
    zero = F.lit(0.0)
    w1 = F.when(admissible, free1).when(first, F.coalesce(only1, zero)).otherwise(zero)
    w2 = F.when(admissible, free2).when(first, zero).otherwise(F.coalesce(only2, zero))
    weights = s.select(*by, "n", "m1", "m2", "my", w1.alias("w1"), w2.alias("w2"))
    return weights.select(*by, F.col("n").alias("rows"), "w1", "w2", (
        F.col("my") - F.col("w1") * F.col("m1") - F.col("w2") * F.col("m2")).alias("intercept"))


def apply_stack(df: DataFrame, coef: DataFrame, x1: str, x2: str, out: str = "pred",
                by: Sequence[str] = ()) -> DataFrame:
    """Stacked prediction, never below 0."""
    if by:
        joined = df.join(small(coef.select(*by, "w1", "w2", "intercept")), on=list(by), how="left")
        w1, w2, b = F.col("w1"), F.col("w2"), F.col("intercept")
        pred = F.greatest(w1 * F.col(x1) + w2 * F.col(x2) + b, F.lit(0.0))
        return joined.withColumn(out, pred).drop("w1", "w2", "intercept")
    c = value_of(coef)
    return df.withColumn(out, F.greatest(
        c.getField("w1") * F.col(x1) + c.getField("w2") * F.col(x2) + c.getField("intercept"),
        F.lit(0.0)))


def _yearly_sums(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str],
                 year: str) -> DataFrame:
    aggs = [F.sum(F.lit(1.0)).alias("n"), F.sum(F.col(y).cast("double")).alias("sy")]
    for i, x in enumerate(xs):
        v = F.col(x).cast("double")
        aggs += [F.sum(v).alias(f"sx{i}"), F.sum(v * v).alias(f"sxx{i}"),
                 F.sum(v * F.col(y)).alias(f"sxy{i}")]
    return df.groupBy(*by, year).agg(*aggs)


def _lines(sums: DataFrame, xs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Least-squares line of y on each x from its sums; a constant x predicts the mean."""
    cols = []
    for i in range(len(xs)):
        n, sx, sxx, sxy = (F.col(c) for c in ("n", f"sx{i}", f"sxx{i}", f"sxy{i}"))
        sy = F.col("sy")
        slope = F.coalesce((n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0)),
                           F.lit(0.0))
        cols += [slope.alias(f"slope{i}"), ((sy - slope * sx) / n).alias(f"base{i}")]
    return sums.select(*keep, *cols)


def _predict(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    return df.withColumns({
        f"pred_{x}": F.col(f"slope{i}") * F.col(x) + F.col(f"base{i}") for i, x in enumerate(xs)})


def walk_forward_lines(df: DataFrame, xs: Sequence[str], y: str, start: int, end: int,
                       by: Sequence[str] = (), year: str = "year") -> DataFrame:
    """Out-of-fold predictions ``pred_<x>`` of one-feature lines over expanding years.

    Rows of year f in (start, end] are predicted by lines fitted on all earlier years. Each year is
    reduced to its sums once; fold sums are running totals over at most one row per year.
    """
    by = list(by)
    earlier = Window.partitionBy(*by).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    sums = _yearly_sums(df, xs, y, by, year)
    stats = [c for c in sums.columns if c not in [*by, year]]
    before = sums.select(*by, year, *[F.sum(c).over(earlier).alias(c) for c in stats])
    lines = _lines(before.filter(F.col("n") > 0), xs, [*by, year])
    tested = df.filter((F.col(year) > start) & (F.col(year) <= end))
    joined = tested.join(small(lines), on=[*by, year], how="inner")
    return _predict(joined, xs).select(*df.columns, *[f"pred_{x}" for x in xs])


def fit_lines(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Lines over all rows given: ``slope<i>``, ``base<i>`` per feature (and group)."""
    constant = df.withColumn("_all", F.lit(0))
    return _lines(_yearly_sums(constant, xs, y, by, "_all"), xs, list(by))


def stacked_forecast(df: DataFrame, xs: tuple[str, str], y: str, start: int, end: int,
                     by: Sequence[str] = (), alpha: float = STACK_PENALTY,
                     year: str = "year") -> DataFrame:
    """Walk-forward stack of two lines, refitted on all years <= ``end``: ``pred`` on every row."""
    oof = walk_forward_lines(df, xs, y, start, end, by, year)
    stack = fit_stack(oof, f"pred_{xs[0]}", f"pred_{xs[1]}", y, alpha, by)
    lines = fit_lines(df.filter(F.col(year) <= end), xs, y, by)
    if by:
        based = df.join(small(lines), on=list(by), how="left")
    else:
        row = value_of(lines)
        based = df.withColumns({c: row.getField(c) for c in lines.columns})
    out = apply_stack(_predict(based, xs), stack, f"pred_{xs[0]}", f"pred_{xs[1]}", "pred", by)
    return out.drop(*[c for c in lines.columns if c not in by])


def targets_long(df: DataFrame, targets: Sequence[str], keep: Sequence[str],
                 prefix: str = "actual_", index: str = "index_",
                 total_index: str = "monthly_index", total: str = "count") -> DataFrame:
    """``(keep..., target, y, own_index)`` per target that has a column; the others are skipped.

    ``own_index`` is the target's own index where there is one, else the total index.
    """
    present = [t for t in targets if f"{prefix}{t}" in df.columns]
    if not present:
        raise ValueError("none of the targets has a column")

    def own(t: str) -> str:
        return f"{index}{t}" if t != total and f"{index}{t}" in df.columns else total_index

    rows = F.array(*[F.struct(F.lit(t).alias("target"),
                              F.col(f"{prefix}{t}").cast("double").alias("y"),
                              F.col(own(t)).cast("double").alias("own_index")) for t in present])
    return df.select(*keep, F.inline(rows))


def score_logistic(df: DataFrame, coef: dict[str, float], intercept: float,
                   out: str = "prob") -> DataFrame:
    """Logistic score with fixed coefficients, as one expression."""
    eta = reduce(lambda acc, c: acc + F.col(c) * F.lit(float(coef[c])), coef, F.lit(float(intercept)))
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))
