import json

import pytest
from pyspark.ml.regression import GeneralizedLinearRegressionModel
from pyspark.sql import functions as F

from cellcast.operators.models import fit_tweedie
from cellcast.shared import scratch, shared_dir, small
from cellcast.sources import grids, polygons, sinks, tables


def test_explode_grid_order_and_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [10.0, 20.0], [1.0, 2.0, 3.0], [1.0, 2.0, nan, 4.0, None, 6.0])],
                               "t int, lat array<double>, lon array<double>, v array<double>")
    out = grids.explode_grid(df, {"lat": F.col("lat"), "lon": F.col("lon")}, {"v": "v"}, ["t"])
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 10.0, 1.0, 1.0), (1, 10.0, 2.0, 2.0), (1, 20.0, 1.0, 4.0), (1, 20.0, 3.0, 6.0)]


def test_explode_grid_refuses_measures_of_different_length(spark):
    df = spark.sql("SELECT array(0D, 1D) lat, array(5D) lon, array(1D, 2D) a, array(3D) b")
    out = grids.explode_grid(df, {"lat": F.col("lat"), "lon": F.col("lon")}, {"a": "a", "b": "b"})
    with pytest.raises(Exception, match="different length"):
        out.collect()


def test_explode_grid_several_measures(spark):
    df = spark.createDataFrame([([0.0], [5.0, 6.0], [1.0, 2.0], [3.0, float("nan")])],
                               "lat array<double>, lon array<double>, a array<double>, b array<double>")
    out = grids.explode_grid(df, {"lat": F.col("lat"), "lon": F.col("lon")}, {"a": "a", "b": "b"})
    assert [tuple(r) for r in out.collect()] == [(0.0, 5.0, 1.0, 3.0)]


def test_harmonise_takes_first_alias(spark):
    df = spark.createDataFrame([(1, 2, 3)], "valid_time int, latitude int, expver int")
    assert grids.harmonise(df).columns == ["time", "lat"]


def test_file_year(spark):
    root = scratch(spark, "years")
    for name, n in (("era.2001.parquet", 2), ("sst.day.mean.1999.parquet", 1)):
        spark.range(n).write.parquet(f"{root}/{name}")
    rows = grids.with_file_year(spark.read.parquet(f"{root}/*")).groupBy("file_year").count().collect()
    assert {r.file_year: r["count"] for r in rows} == {2001: 2, 1999: 1}


def test_first_slice_without_groups(spark):
    df = spark.createDataFrame([(2, 1.0), (1, 5.0), (1, None)], "t int, v double")
    assert [tuple(r) for r in grids.first_slice(df, "t", ["v"]).collect()] == [(1, 5.0)]
    grouped = spark.createDataFrame([(None, 2, 1.0), (None, 3, 1.0), (7, 1, 5.0)], "g int, t int, v double")
    rows = grids.first_slice(grouped, "t", ["v"], by=["g"]).collect()
    assert sorted((r.g or 0, r.t) for r in rows) == [(0, 2), (7, 1)]


def test_units_row_and_null_ids_go(spark):
    path = scratch(spark, "csv")
    spark.createDataFrame([("SID,WIND",), (" ,knots",), ("A,10",), (",3",)], "value string").coalesce(
        1).write.text(path)
    assert [tuple(r) for r in tables.read_csv_with_units(spark, path, "SID").collect()] == [("A", "10")]


def test_index_csv_keeps_the_bound(spark):
    path = scratch(spark, "idx")
    spark.createDataFrame([(" Date , Value ",), ("2000-01-01, -999 ",), (" 2000-02-01,-9999",),
                           ("2000-03-01,0.7",), ("bad,0.1",)], "value string").coalesce(1).write.text(path)
    rows = sorted((tuple(r) for r in tables.read_index_csv(spark, path).collect()), key=str)
    assert (2000, 1, -999.0, 2) in rows and (2000, 2, None, 0) in rows and (2000, 3, 0.7, 1) in rows
    assert [tuple(r) for r in tables.read_index_csv(spark, path, drop_missing=True).collect()] == [
        (2000, 3, 0.7, 1)]


def test_profile_reports_unreadable(spark):
    path = scratch(spark, "p")
    spark.range(30).write.parquet(path)
    rows = {r.dataset: r for r in tables.profile_datasets(spark, {"a": path, "b": path + "x"}).collect()}
    assert rows["a"].row_count == 30 and len(rows["a"].sample_rows) == 20 and rows["a"].error is None
    assert rows["b"].row_count is None and rows["b"].error


def test_polygons_first_match_per_code(spark):
    def feature(name, x, key="name", multi=False):
        ring = [[x, 0], [x + 1, 0], [x + 1, 1], [x, 0]]
        return {"type": "Feature", "properties": {key: name}, "geometry": {
            "type": "MultiPolygon" if multi else "Polygon",
            "coordinates": [[ring], [ring]] if multi else [ring]}}

    path = scratch(spark, "geo")
    doc = json.dumps({"type": "FeatureCollection", "features": [
        feature("Nowhere", 0), feature("JAPAN", 10, "ADMIN", True), feature("East China", 20),
        feature("China", 30)]})
    spark.createDataFrame([(doc,)], "value string").write.text(path)
    rows = polygons.read_polygons(spark, path).collect()
    assert {(r.code, r.x1 >= 20) for r in rows} == {("JP", False), ("CN", True)}
    assert min(r.x1 for r in rows if r.code == "CN") == 20.0
    assert len([r for r in rows if r.code == "JP"]) == 6
    orders = {r.code: r.poly_order for r in rows}
    assert orders["JP"] < orders["CN"]


def test_dynamic_overwrite_keeps_other_partitions(spark):
    path = scratch(spark, "dyn")
    df = spark.createDataFrame([(1, 2000), (2, 2001)], "v int, year int")
    sinks.write_grid(df, path, partition_by=["year"])
    sinks.write_grid(df.filter("year = 2001").withColumn("v", F.lit(9)), path, partition_by=["year"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 2000), (9, 2001)]
    assert grids.read_grid(spark, path, [2001]).count() == 1


def test_materialise_builds_once(spark):
    path, calls = scratch(spark, "feat"), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert sinks.materialise(spark, build, path).count() == 1
    assert sinks.materialise(spark, build, path).count() == 1
    assert sinks.materialise(spark, build, path, rebuild=True).count() == 2
    assert len(calls) == 2


def test_predictions_csv(spark):
    path = scratch(spark, "pred")
    spark.createDataFrame([(2000, 1, 3, 2.5, 9)], "year int, month int, actual_count int, "
                          "pred_count double, other int").write.mode("overwrite")
    df = spark.createDataFrame([(2000, 1, 3, 2.5, 9)],
                               "year int, month int, actual_count int, pred_count double, other int")
    sinks.write_predictions(df, path)
    assert spark.read.csv(path, header=True).columns == ["year", "month", "actual_count", "pred_count"]


def test_artifacts_round_trip_and_missing(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(20)], "x double, y double")
    model = fit_tweedie(df, ["x"], "y")
    path = scratch(spark, "art")
    sinks.save_artifacts(path, {"means": df.agg(F.avg("x").alias("x"))}, tweedie=model)
    loaded = sinks.load_artifacts(spark, path, tweedie=GeneralizedLinearRegressionModel)
    assert loaded["tweedie"].intercept == pytest.approx(model.intercept)
    assert loaded["means"].first().x == pytest.approx(9.5)
    with pytest.raises(FileNotFoundError, match="other"):
        sinks.load_artifacts(spark, path, other=GeneralizedLinearRegressionModel)


def test_small_checks_the_size(spark):
    df = spark.range(10)
    assert "hint" in small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in small(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) and (named is None or shared_dir(spark) == named)
