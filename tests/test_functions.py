import datetime as dt
import math

from pyspark.sql import functions as F

from cellcast.functions import cleaning, dates, features, grid


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_snap_ties_and_signs(spark):
    got = values(spark, [(12.125,), (-12.125,), (12.375,), (0.1,), (-0.1,), (0.12499999999999999,)],
                 "x double", grid.snap("x"), grid.snap("x", mode="even"))
    assert got[0] == (12.25, 12.0)
    assert got[1] == (-12.25, -12.0)
    assert got[2] == (12.5, 12.5)
    assert got[3] == (0.0, 0.0) and got[4] == (0.0, 0.0)
    assert math.copysign(1, got[4][0]) == 1.0
    assert got[5] == (0.0, 0.0)


def test_box_drops_null_coordinates(spark):
    df = spark.createDataFrame([(0.0, 100.0), (30.0, 130.0), (31.0, 110.0), (None, 110.0),
                                (10.0, None)], "lat double, lon double")
    assert grid.in_box(df, (0, 30), (100, 130)).count() == 2
    assert grid.in_box(df, (0, 30)).count() == 2


def test_wrap_lon(spark):
    got = values(spark, [(190.0,), (-190.0,), (180.0,), (540.0,)], "x double", grid.wrap_lon("x"))
    assert [g[0] for g in got] == [-170.0, 170.0, -180.0, -180.0]


def test_sentinels(spark):
    got = values(spark, [("-999",), ("-9999",), ("",), (" ",), ("3.5",), ("x",), (None,)],
                 "s string", cleaning.clean_numeric("s"))
    assert [g[0] for g in got] == [None, None, None, None, 3.5, None, None]
    got = values(spark, [(-999.0,), (-999.1,), (5.0,), (None,)], "x double", cleaning.null_below("x"))
    assert [g[0] for g in got] == [-999.0, None, 5.0, None]


def test_sanitise_clamp_and_count(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf,), (-inf,), (float("nan"),), (None,), (250.0,), (-3.0,)], "x double")
    assert cleaning.count_unclean(df, ["x"]).first().asDict() == {"inf_count": 2, "missing_count": 2}
    assert [r.x for r in cleaning.sanitise(df, ["x"]).collect()] == [0, 0, 0, 0, 250, -3]
    assert [r.c for r in df.select(cleaning.clamp("x").alias("c")).collect()] == [0, 0, 0, 0, 200, 0]


def test_impute_does_not_truncate_integers(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0)], "a int, b double")
    means = df.agg(F.lit(1.9).alias("a"), F.avg("b").alias("b"))
    assert [tuple(r) for r in cleaning.impute_with(df, means).collect()] == [(1.0, 2.0), (1.9, 2.0)]
    assert cleaning.impute_with(df, {"a": 1.9}).collect()[1].a == 1.9


def test_coerce_and_ensure(spark):
    df = spark.createDataFrame([("1.5", 2), ("x", 3), (None, 4)], "s string, n int")
    assert [r.s for r in cleaning.coerce_numeric(df, ["s", "n"]).collect()] == [1.5, 0.0, 0.0]
    assert dict(cleaning.ensure_column(df, "z").dtypes)["z"] == "double"
    assert cleaning.ensure_column(df, "n").columns == df.columns


def test_phase_flags_and_labels(spark):
    got = values(spark, [(0.5,), (-0.5,), (0.49,), (None,)], "x double", features.classify_phase("x"))
    assert [g[0] for g in got] == [1, 2, 0, 0]
    got = values(spark, [(26.5,), (26.4,), (None,)], "x double", features.flag_at_least("x"))
    assert [g[0] for g in got] == [1, 0, 0]
    got = values(spark, [(0.1,), (0.11,)], "x double", features.soft_threshold("x"))
    assert [g[0] for g in got] == [0.0, 0.11]
    got = values(spark, [(2015,), (2016,), (2019,), (2020,), (None,)], "y int", features.split_label("y"))
    assert [g[0] for g in got] == ["Train", "Val", "Val", "Test", "Test"]
    got = values(spark, [(62.9,), (63.0,), (118.0,), (118.1,), (None,)], "x double",
                 features.intensity_class("x"))
    assert [g[0] for g in got] == ["TD", "TS", "TS", "TY", None]


def test_days_do_not_follow_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    nanos = 1_704_063_600_000_000_000  # 2023-12-31 23:00 UTC
    df = spark.createDataFrame([(nanos,), (-1,), (None,)], "t bigint")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
        got = [r.date for r in dates.to_day(df, "t").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [dt.date(2023, 12, 31), dt.date(1969, 12, 31), None]


def test_month_helpers(spark):
    got = values(spark, [(1,), (12,), (13,), (0,), (None,)], "m int", dates.month_name("m"),
                 dates.season("m"))
    assert [g[0] for g in got] == ["Jan", "Dec", None, None, None]
    assert got[0][1] == "offpeak" and got[1][1] == "peak"
    (seconds,), = values(spark, [(dt.date(1970, 1, 2),)], "d date", dates.epoch_seconds("d"))
    assert seconds == 86_400


def test_feature_routing():
    base = {"total": ["monthly_index", "driver"], "target": ["{index}", "driver", "driver"]}
    assert features.route_features(base, "count") == ["monthly_index", "driver"]
    assert features.route_features(base, "VN") == ["index_VN", "driver"]


def test_interactions_with_null_driver(spark):
    df = spark.createDataFrame([(2.0, None), (2.0, 0.5), (2.0, -0.6)],
                               "monthly_index double, driver double")
    rows = features.phase_interactions(df).collect()
    assert (rows[0].is_warm, rows[0].is_cold, rows[0].index_x_driver) == (0.0, 0.0, None)
    assert (rows[1].is_warm, rows[2].is_cold) == (1.0, 1.0)
