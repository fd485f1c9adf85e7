import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cellcast.operators import aggregates as agg
from cellcast.operators import evaluate, joins, ordering, sampling, windows
from cellcast.functions.grid import in_snapped_box, snap
from tests.plans_helper import count, full_plan, plan_of

DAY = dt.date(2000, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def cells(spark, rows):
    return spark.createDataFrame(rows, "lat double, lon double, date date, v double")


# joins -----------------------------------------------------------------------------------------

def two_cells(spark):
    return cells(spark, [(1.0, 1.0, DAY, 5.0), (1.0, 2.0, DAY, 6.0)])


def two_points(spark):
    return spark.createDataFrame([(1.0, 1.0, DAY, "A", 2), (1.0, 1.0, DAY, "B", 1), (9.0, 9.0, DAY, "C", 1)],
                                 "lat double, lon double, date date, SID string, n int")


@pytest.mark.parametrize("max_rows", [100, 0])
def test_events_fan_out_or_dedup_on_both_paths(spark, max_rows):
    fan = joins.attach_events(two_cells(spark), two_points(spark), max_rows=max_rows)
    assert sorted((r.lon, r.SID) for r in fan.collect() if r.SID) == [(1.0, "A"), (1.0, "B")]
    assert fan.count() == 3 and fan.filter("SID IS NULL").count() == 1
    one = joins.attach_events(two_cells(spark), two_points(spark), dedup=True, order=["n"],
                              max_rows=max_rows)
    assert sorted((r.lon, r.SID or "") for r in one.collect()) == [(1.0, "B"), (2.0, "")]


def test_crowded_cell_days_are_dealt_over_salts(spark):
    points = spark.createDataFrame([(1.0, 1.0, DAY, f"A{k}") for k in range(40)] + [(1.0, 1.0, DAY, "A0"), (9.0, 9.0, DAY, "X")],
                                   "lat double, lon double, date date, SID string")
    rows = two_cells(spark)
    want = joins.attach_events(rows, points)
    for crowd in (1, 7, 30):
        got = joins.attach_events(rows, points, max_rows=0, crowd=crowd)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 42


def test_lookup_is_broadcast_only_below_the_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        near = joins.attach_events(two_cells(spark), two_points(spark), max_rows=10)
        far = joins.attach_events(two_cells(spark), two_points(spark), max_rows=2)
        assert "BroadcastHashJoin" in plan_of(near)
        assert "BroadcastHashJoin" not in plan_of(far)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_transition_fills_every_outcome(spark):
    grid = spark.createDataFrame([(1.0, 1.0, 0.25, 0.75)], "lat float, lon float, prob_VN double, prob_PH double")
    rows = {r.lon: (r.prob_VN, r.prob_PH) for r in joins.attach_transition(two_cells(spark), grid).collect()}
    assert rows == {1.0: (0.25, 0.75), 2.0: (0.0, 0.0)}


def test_calendar_lag_never_bridges_a_gap(spark):
    df = spark.createDataFrame([(1999, 12, 5), (2000, 1, 7), (2000, 3, 9)], "year int, month int, n int")
    rows = {(r.year, r.month): r.n_lag1 for r in joins.calendar_lag(df, ["n"]).collect()}
    assert rows == {(1999, 12): 0.0, (2000, 1): 5.0, (2000, 3): 0.0}


def test_folds_without_a_side_are_skipped(spark):
    df = spark.createDataFrame([(1990,), (1991,), (1993,)], "year int")
    rows = sorted((r.fold, r.role, r.year) for r in joins.expanding_folds(df, 1989, 1995).collect())
    assert rows == [(1991, "test", 1991), (1991, "train", 1990), (1993, "test", 1993),
                    (1993, "train", 1990), (1993, "train", 1991)]
    assert joins.expanding_folds(df, 1995, 2000).count() == 0


def test_actuals_and_outcomes(spark):
    index = spark.createDataFrame([(2000, 1, 1.0), (2000, 2, 2.0)], "year int, month int, monthly_index double")
    actuals = spark.createDataFrame([(2000, 1, 3)], "year int, month int, actual_count int")
    driver = spark.createDataFrame([(2000, 2, 0.7)], "year int, month int, driver double")
    rows = sorted(tuple(r) for r in joins.join_actuals(index, actuals, driver).collect())
    assert rows == [(2000, 1, 1.0, 3, 0.0), (2000, 2, 2.0, 0, 0.7)]


# aggregates ------------------------------------------------------------------------------------

def test_daily_mean_skips_null_and_nan(spark):
    df = cells(spark, [(1.0, 1.0, DAY, 2.0), (1.0, 1.0, DAY, float("nan")), (1.0, 1.0, DAY, None),
                       (1.0, 1.0, DAY, 4.0)])
    assert agg.daily_mean(df, ["lat", "lon", "date"], {"v": "m"}).first().m == 3.0


def test_snapped_mean_keeps_border_cells(spark):
    df = cells(spark, [(30.125, 100.0, DAY, 1.0), (30.1, 100.0, DAY, 3.0), (-0.1, 100.0, DAY, 5.0)])
    rows = sorted((r.lat, r.m) for r in agg.snap_then_mean(df, {"v": "m"}).collect())
    assert rows == [(0.0, 5.0), (30.0, 3.0)]


def test_raw_box_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "sea")
    cells(spark, [(1.0, 101.0, DAY, 1.0)]).write.parquet(path)
    text = full_plan(agg.snap_then_mean(spark.read.parquet(path), {"v": "m"}))
    for pushed in ("GreaterThan(lat,-0.125)", "LessThan(lat,30.125)", "GreaterThanOrEqual(lon,99.875)"):
        assert pushed in text


def test_raw_box_equals_snapped_box(spark):
    values = [x / 16 for x in range(-80, 81)]
    df = spark.createDataFrame([(v, 0.0) for v in values], "lat double, lon double")
    for box in ((0.0, 2.0), (-2.0, 0.0), (0.1, 1.9), (-3.0, -0.6), (1.0, 1.0), (0.3, 0.4)):
        got = {r.lat for r in in_snapped_box(df, box, None).collect()}
        snapped = df.withColumn("s", snap("lat")).filter(F.col("s").between(*box))
        assert got == {r.lat for r in snapped.collect()}, box


def test_distinct_by_target_equals_conditional_distincts(spark):
    df = spark.createDataFrame(
        [("A", 1, 1, "VN"), ("A", 1, 1, "VN"), ("A", 1, 1, "PH"), ("B", 1, 1, None), ("C", 1, 2, "VN")],
        "SID string, year int, month int, outcome string")
    rows = {r.month: r for r in agg.monthly_distinct_by(df, values=["VN", "PH"]).collect()}
    assert (rows[1].actual_count, rows[1].actual_VN, rows[1].actual_PH) == (2, 1, 1)
    assert (rows[2].actual_count, rows[2].actual_VN, rows[2].actual_PH) == (1, 1, 0)
    assert count(agg.monthly_distinct_by(df), "Expand") == 0


def test_prior_and_smoothing(spark):
    visits = spark.createDataFrame(
        [("A", 1.0, 1.0, "VN"), ("B", 1.0, 1.0, "PH"), ("C", 2.0, 1.0, "VN"), ("D", 2.0, 1.0, "VN")],
        "SID string, lat_grid double, lon_grid double, outcome string")
    prior = agg.outcome_prior(visits).first()
    assert (prior.VN, prior.PH, prior.JP) == (0.75, 0.25, 0.0)
    grid = agg.smooth_transition(agg.outcome_crosstab(visits), agg.outcome_prior(visits))
    rows = {r.lat_grid: r for r in grid.collect()}
    assert rows[1.0].prob_VN == pytest.approx((1 + 5 * 0.75) / 7)
    assert sum(rows[2.0][f"prob_{o}"] for o in agg.MATRIX_OUTCOMES) == pytest.approx(1.0)
    cut = agg.outcome_crosstab(visits, where=F.col("SID") < "C")
    assert cut.count() == 1


def test_peak_month_ties_and_zero(spark):
    df = spark.createDataFrame([(1, 5, 3), (1, 4, 3), (1, 6, 1), (2, 1, 0)],
                               "year int, month int, actual_count int")
    assert {r.year: r.peak_month for r in agg.peak_month(df).collect()} == {1: 4, 2: -1}


def test_histogram_bins(spark):
    df = spark.createDataFrame([(-1.0,), (-0.9,), (0.0,), (None,)], "residual double")
    rows = {r.bin: (r.left_edge, r.row_count) for r in agg.residual_histogram(df).collect()}
    assert rows == {1: (-1.0, 2), 3: (0.0, 1)}


def test_mass_centre_cuts_exactly(spark):
    """More distinct scores than a sketch tells apart."""
    rng = random.Random(9)
    rows = [(2000, k % 2, rng.random(), rng.uniform(0, 50)) for k in range(60_000)]
    df = spark.createDataFrame(rows, "year int, month int, prob double, lon double")
    got = {r.month: r.mass_centre for r in agg.mass_centre(df).collect()}
    for month in (0, 1):
        own = sorted((p, x) for _, m, p, x in rows if m == month)
        top = own[math.ceil(0.95 * len(own) - 1e-9) - 1:]
        assert got[month] == pytest.approx(sum(p * x for p, x in top) / sum(p for p, _ in top), rel=1e-12)


def test_neighbourhood_sends_a_copy_per_row_of_cells(spark):
    plan = plan_of(agg.neighbourhood_mean(cells(spark, [(0.0, 100.0, DAY, 1.0)]), "v"))
    assert "Expand" not in plan and plan.count("Generate") >= 1


def test_neighbourhood_against_brute_force(spark):
    rng = random.Random(5)
    spots = rng.sample([(i, j) for i in range(12) for j in range(12)], 70)
    rows = [(i * 0.25, 100 + j * 0.25, DAY, float(i * 12 + j)) for i, j in spots]
    got = {(r.lat, r.lon): r.v_near for r in agg.neighbourhood_mean(cells(spark, rows), "v").collect()}
    for la, lo, _, _ in rows:
        near = [v for a, b, _, v in rows if (a - la) ** 2 + (b - lo) ** 2 <= 1]
        assert got[la, lo] == pytest.approx(sum(near) / len(near))
    assert len(got) == len(rows)


def test_pieces_of_days_equal_whole_histories(spark):
    rng = random.Random(11)
    rows = [(1.0, float(k % 2), dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(400)),
             None if k % 9 == 0 else rng.random()) for k in range(600)] + [(1.0, 1.0, None, 2.0), (1.0, 1.0, None, 4.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, date date, v double")
    spec = {7: {"v": "v7"}, 90: {"v": "v90"}}
    whole = windows.trailing_means(df, ["lat", "lon"], ["date"], spec, "days")
    for days in (10, 64, 1000):
        cut = windows.trailing_means(df, ["lat", "lon"], ["date"], spec, "days", chunk_rows=days)
        a, b = (sorted((str(r.lon), str(r.date), str(r.v), round(r.v7 or -1, 9), round(r.v90 or -1, 9))
                       for r in d.collect()) for d in (whole, cut))
        assert a == b
    assert "_piece" in full_plan(cut)


# windows ---------------------------------------------------------------------------------------

# A worked example of one cell, five days.
WORKED_SST = (28.82, 28.67, 27.75, 27.61, 27.26)
WORKED_ANOMALY = (0.000, -0.075, -0.663, -0.603, -0.762)


def test_worked_anomaly_example(spark):
    df = cells(spark, [(0.25, 123.5, day(i), v) for i, v in enumerate(WORKED_SST)])
    out = windows.trailing_means(df, ["lat", "lon"], ["date"], {180: {"v": "m"}}).orderBy("date")
    assert [r.v - r.m for r in out.collect()] == pytest.approx(WORKED_ANOMALY, abs=1e-3)


def test_trailing_plan_has_one_shuffle_and_one_sort(spark):
    df = spark.range(10).select(F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.col("id").alias("date"),
                                *[F.col("id").cast("double").alias(c) for c in
                                  ("sst_avg", "slp_avg", "wind_speed_env_avg")])
    out = windows.trailing_means(df.repartition(2), ["lat", "lon"], ["date"])
    tree = plan_of(out)
    assert tree.count("hashpartitioning") <= 1 and count(out, "Sort") == 1


def test_long_frames_are_put_together_of_short_ones(spark):
    """A frame of 30 rows, which no asked length divides, used to take 30 steps a row."""
    rng = random.Random(6)
    rows = [(1, d, 0, rng.choice([None, round(rng.uniform(-5, 5), 2)])) for d in range(300)]
    df = spark.createDataFrame(rows, "k int, d int, s int, v double")
    out = windows.trailing_means(df, ["k"], ["d"], {n: {"v": f"m{n}"} for n in windows.TRAILING})
    assert max(int(n) for n in re.findall(r"RowFrame, -(\d+), currentrow", full_plan(out))) < 10
    got = out.collect()
    for n in windows.TRAILING:
        want = brute_rows(rows, n)
        assert all(r[f"m{n}"] == (None if want[1, r.d, 0] is None else pytest.approx(want[1, r.d, 0])) for r in got)


def brute_rows(rows, n):
    out = {}
    for k in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == k)
        for i, r in enumerate(mine):
            vals = [x[3] for x in mine[max(0, i - n + 1):i + 1] if x[3] is not None]
            out[r[:3]] = sum(vals) / len(vals) if vals else None
    return out


@pytest.mark.parametrize("chunk_rows", [None, 12, 13])
def test_trailing_rows_against_brute_force(spark, chunk_rows):
    rng = random.Random(3)
    rows = [(k, d, s, rng.choice([None, round(rng.uniform(-5, 5), 2)]))
            for k in range(3) for d in range(40) for s in range(rng.choice([0, 1, 1, 3]))]
    df = spark.createDataFrame(rows, "k int, d int, s int, v double")
    spec = {2: {"v": "m2"}, 3: {"v": "m3"}, 6: {"v": "m6"}, 12: {"v": "m12"}, 7: {"v": "m7"}}
    out = windows.trailing_means(df, ["k"], ["d", "s"], spec, chunk_rows=chunk_rows).collect()
    assert len(out) == len(rows)
    for n in (2, 3, 6, 12, 7):
        want = brute_rows(rows, n)
        for r in out:
            assert r[f"m{n}"] == (None if want[r.k, r.d, r.s] is None else pytest.approx(want[r.k, r.d, r.s]))


def test_days_differ_from_rows_over_a_gap(spark):
    df = cells(spark, [(1.0, 1.0, day(0), 1.0), (1.0, 1.0, day(5), 3.0)])
    rows = windows.trailing_means(df, ["lat", "lon"], ["date"], {3: {"v": "m"}}).orderBy("date").collect()
    days = windows.trailing_means(df, ["lat", "lon"], ["date"], {3: {"v": "m"}}, "days").orderBy("date").collect()
    assert [r.m for r in rows] == [1.0, 2.0] and [r.m for r in days] == [1.0, 3.0]


def test_chunk_must_cover_the_longest_frame(spark):
    with pytest.raises(ValueError):
        windows.trailing_means(spark.range(1), ["id"], ["id"], {30: {"id": "m"}}, chunk_rows=5)


def test_numbering_matches_row_number(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), rng.randrange(30), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, d int, i int")
    got = {(r.k, r.i): r.row_no for r in windows.numbered(df, ["k"], ["d", "i"], "d").collect()}
    for k in (0, 1):
        for n, (_, _, i) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            assert got[k, i] == n


def test_numbering_keeps_null_keys_and_hot_keys(spark):
    rows = [(None, None, i) for i in range(4)] + [("hot", d, i) for d in range(30) for i in range(10)]
    rows += [("cold", 1, 0), (None, 2, 9)]
    df = spark.createDataFrame(rows, "k string, d int, i int")
    got = windows.numbered(df, ["k"], ["d", "i"], "d").collect()
    assert len(got) == len(rows)
    assert sorted(r.row_no for r in got if r.k is None) == [1, 2, 3, 4, 5]
    assert sorted(r.row_no for r in got if r.k == "hot") == list(range(1, 301))


def test_running_totals_with_null_key_and_nan(spark):
    df = spark.createDataFrame([(None, 0.1, 1), (None, 0.2, 2), ("a", 0.1, 4), ("a", float("nan"), 8)],
                               "split string, score double, n int")
    got = {(r.split, str(r.score)): r.cum_n for r in
           windows.running_totals(df, ["n"], ["split"], blocks=4).collect()}
    assert got == {(None, "0.1"): 1, (None, "0.2"): 3, ("a", "0.1"): 4, ("a", "nan"): 12}


def test_in_year_windows_restart(spark):
    df = spark.createDataFrame([(1, 11, 2.0, 1), (1, 12, 4.0, 2), (2, 1, 10.0, 3), (2, 2, None, 4)],
                               "year int, month int, driver double, actual_count int")
    out = windows.ytd_before(windows.diff_in_group(windows.trailing_in_group(df, ["driver"])))
    rows = {(r.year, r.month): (r.driver_3m_avg, r.driver_momentum, r.cumulative_ytd) for r in out.collect()}
    assert rows == {(1, 11): (2.0, 0.0, 0.0), (1, 12): (3.0, 2.0, 1.0), (2, 1): (10.0, 0.0, 0.0),
                    (2, 2): (10.0, 0.0, 3.0)}


# ordering, sampling ------------------------------------------------------------------------------

def test_top_k_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "name string, gain double")
    assert [r.name for r in ordering.top_k(df, "gain", 2).collect()] == ["c", "a"]


def labelled(spark, pos, neg):
    return spark.range(pos + neg).select("id", (F.col("id") < pos).cast("int").alias("label"),
                                         (F.col("id") % 7).alias("g"))


def test_undersample_ratio_and_repeatability(spark):
    df = labelled(spark, 200, 20_000)
    one = sampling.undersample(df, ["id"], ratio=20)
    kept = one.groupBy("label").count().collect()
    counts = {r.label: r["count"] for r in kept}
    assert counts[1] == 200 and abs(counts[0] - 4000) < 300
    other = sampling.undersample(df.repartition(13, "g"), ["id"], ratio=20)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0
    assert sampling.undersample(df, ["id"], seed=7).exceptAll(one).count() > 0


def test_undersample_extremes(spark):
    assert sampling.undersample(labelled(spark, 10, 50), ["id"]).count() == 60
    assert sampling.undersample(labelled(spark, 0, 50), ["id"]).count() == 0
    assert sampling.undersample(labelled(spark, 10, 0), ["id"]).count() == 10


def test_undersample_shuffles_no_row(spark):
    assert "Exchange" not in plan_of(sampling.undersample(labelled(spark, 1, 9), ["id"])).split("Subqueries")[0]


def test_temporal_split_is_disjoint_and_drops_null_years(spark):
    df = spark.createDataFrame([(2015,), (2016,), (2019,), (2020,), (None,)], "year int")
    assert [[r.year for r in p.collect()] for p in sampling.temporal_split(df)] == [[2015], [2016, 2019], [2020]]


# evaluation --------------------------------------------------------------------------------------

def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    pos = sum(y for _, y in pairs)
    if not pos:
        return None
    total, tp, n = 0.0, 0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        here = [y for t, y in pairs if t == s]
        tp, n = tp + sum(here), n + len(here)
        total += sum(here) * tp / n
    return total / pos


def test_auc_and_ap_with_ties_and_hot_score(spark):
    rng = random.Random(1)
    pairs = [(0.5 if rng.random() < 0.4 else round(rng.random(), 2), int(rng.random() < 0.2))
             for _ in range(700)]
    df = spark.createDataFrame(pairs, "prob double, label int")
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(brute_auc(pairs))
    assert evaluate.average_precision(df).first()[0] == pytest.approx(brute_ap(pairs))
    groups = df.withColumn("split", F.when(F.col("prob") < 0.5, "a").otherwise("b"))
    got = {(r.split, r.metric): r.value for r in evaluate.classifier_report(groups).collect()}
    for name, part in (("a", [p for p in pairs if p[0] < 0.5]), ("b", [p for p in pairs if p[0] >= 0.5])):
        assert got[name, "roc_auc"] == pytest.approx(brute_auc(part))
        assert got[name, "auprc"] == pytest.approx(brute_ap(part))


def test_auc_of_one_class_is_undefined(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "prob double, label int")
    assert evaluate.roc_auc(df).first()[0] is None
    assert evaluate.average_precision(df).first()[0] == pytest.approx(1.0)
    none = df.withColumn("label", F.lit(0))
    assert evaluate.average_precision(none).first()[0] is None


def test_count_measures(spark):
    df = spark.createDataFrame([(1, 1, 2, 3.0, 0.6), (1, 2, 4, 3.0, -0.7), (2, 1, 0, 1.0, 0.0)],
                               "year int, month int, actual_count int, pred_count double, driver double")
    bias = evaluate.bias_by_phase(df).first()
    assert (bias.bias, bias.bias_warm, bias.bias_cold, bias.bias_neutral) == (1.0, 1.0, -1.0, 1.0)
    assert evaluate.annual_mae(df).first()[0] == 0.5
    flat = df.withColumn("actual_count", F.lit(2))
    assert evaluate.mase(flat, F.col("year") == 1, F.col("year") == 2).first().mase == math.inf
    assert evaluate.tweedie_deviance(df.withColumn("pred_count", F.lit(0.0))).first()[0] is None
    same = df.filter("actual_count > 0").withColumn("pred_count", F.col("actual_count").cast("double"))
    assert evaluate.tweedie_deviance(same).first()[0] == pytest.approx(0.0)
