"""Scans, sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cellcast.catalog.registry import query
from cellcast.catalog.views import POLYGONS
from cellcast.functions.cleaning import clean_numeric
from cellcast.functions.dates import NANOS_PER_DAY, to_day
from cellcast.operators.geo import polygon_hits
from cellcast.shared import scratch
from cellcast.sources.grids import (explode_grid, first_slice, harmonise, read_grid,
                                    with_file_year)
from cellcast.sources.polygons import read_polygons
from cellcast.sources.sinks import write_grid
from cellcast.sources.tables import (count_rows_by_category, profile_datasets,
                                     read_csv_with_units, read_index_csv)


@query("src_grid_explode", views="grid_blocks", oracle="""
SELECT t, CAST(i // 8 AS DOUBLE) * 0.25 AS lat, 100 + CAST(i % 8 AS DOUBLE) * 0.25 AS lon,
 CAST(vals[i + 1] AS DOUBLE) AS value
FROM grid_blocks, UNNEST(RANGE(64)) AS u(i)
WHERE vals[i + 1] IS NOT NULL AND NOT ISNAN(vals[i + 1])""")
def _(t):
    lat = F.array(*[F.lit(i * 0.25) for i in range(8)])
    lon = F.array(*[F.lit(100 + i * 0.25) for i in range(8)])
    return explode_grid(t.grid_blocks, {"lat": lat, "lon": lon}, {"value": "vals"}, keep=["t"])


@query("src_csv_header_units", views="dirty", oracle="""
SELECT event_id, CASE WHEN raw_value IN ('-999', '-9999', '', ' ') THEN NULL
 ELSE ROUND(CAST(raw_value AS DOUBLE), 6) END AS value
FROM dirty""")
def _(t):
    path = scratch(t.spark, "track_csv")
    text = t.dirty.select(F.col("event_id").cast("string").alias("SID"), "raw_value")
    units = t.spark.sql("SELECT ' ' AS SID, 'knots' AS raw_value")
    units.unionByName(text).write.csv(path, header=True, ignoreLeadingWhiteSpace=False,
                                      ignoreTrailingWhiteSpace=False)
    rows = read_csv_with_units(t.spark, path, "SID")
    return rows.select(F.col("SID").cast("bigint").alias("event_id"),
                       F.round(clean_numeric("raw_value"), 6).alias("value"))


@query("src_index_csv", views="month_index", oracle="""
SELECT CAST(oni_year AS INTEGER) AS index_year, CAST(oni_month AS INTEGER) AS index_month,
 oni_value AS driver, CAST(CASE WHEN oni_value >= 0.5 THEN 1 WHEN oni_value <= -0.5 THEN 2
 ELSE 0 END AS INTEGER) AS phase
FROM month_index""")
def _(t):
    path = scratch(t.spark, "index_csv")
    t.month_index.select(
        F.format_string(" %04d-%02d-01 ", "oni_year", "oni_month").alias(" Date "),
        F.format_string("  %s", F.coalesce(F.col("oni_value"), F.lit(-9999.0)).cast("string"))
        .alias(" Value ")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False,
                                     ignoreTrailingWhiteSpace=False)
    return read_index_csv(t.spark, path)


@query("src_parquet_partitioned", views="obs_raw", oracle="""
SELECT scope, CAST(year AS INTEGER) AS year, COUNT(*) AS row_count,
 CAST(SUM(CAST(slp AS DECIMAL(18, 2))) AS DOUBLE) AS slp_sum
FROM (SELECT 'all' AS scope, YEAR(date) AS year, slp FROM obs_raw
 UNION ALL SELECT 'pruned', YEAR(date), slp FROM obs_raw WHERE YEAR(date) IN (1996, 1997)) u
GROUP BY 1, 2""")
def _(t):
    path = scratch(t.spark, "obs")
    obs = t.obs_raw.withColumns({"year": F.year("date"), "month": F.month("date")})
    write_grid(obs, path, partition_by=["year", "month"])
    both = read_grid(t.spark, path).select(F.lit("all").alias("scope"), "year", "slp").unionByName(
        read_grid(t.spark, path, [1996, 1997]).select(F.lit("pruned").alias("scope"), "year", "slp"))
    return both.groupBy("scope", "year").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("slp").cast("decimal(18,2)")).cast("double").alias("slp_sum"))


@query("src_harmonise_columns", views="obs_raw", oracle="""
SELECT l_orderkey, l_linenumber, date AS time, lat, lon, ROUND(u_wind, 6) AS u_wind,
 ROUND(v_wind, 6) AS v_wind, slp FROM obs_raw""")
def _(t):
    raw = t.obs_raw.select(
        "l_orderkey", "l_linenumber", F.col("date").alias("valid_time"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.round("u_wind", 6).alias("u10"), F.round("v_wind", 6).alias("v10"),
        F.col("slp").alias("msl"), F.lit(0).alias("number"))
    return harmonise(raw)


@query("src_nanos_to_date", oracle="""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day_from_nanos,
 CAST(l_shipdate AS DATE) AS day_from_ts
FROM lineitem""")
def _(t):
    nanos = (F.unix_date(F.to_date("l_shipdate")).cast("bigint") * NANOS_PER_DAY
             + F.col("l_linenumber") * 3_600_000_000_000)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", nanos.alias("nanos"))
    days = to_day(to_day(rows, "nanos", "day_from_nanos"), "l_shipdate", "day_from_ts")
    return days.drop("nanos", "l_shipdate")


@query("src_year_from_filename", oracle="""
SELECT CAST(YEAR(l_shipdate) AS INTEGER) AS file_year, COUNT(*) AS row_count,
 CAST(SUM(l_quantity) AS BIGINT) AS quantity
FROM lineitem GROUP BY 1""")
def _(t):
    path = scratch(t.spark, "yearly")
    name = F.concat(F.lit("obs.day.mean."), F.year("l_shipdate").cast("string"), F.lit(".parquet"))
    write_grid(t.lineitem.select("l_quantity", name.alias("file")), path, partition_by=["file"])
    return with_file_year(t.spark.read.parquet(path)).groupBy("file_year").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("l_quantity").cast("bigint").alias("quantity"))


def geojson() -> str:
    """The fixed polygons as a feature collection, with decoys the reader must pass over."""
    names = {"VN": "VIETNAM", "PH": "Philippines", "CN": "People's Republic of China",
             "TW": "Taiwan", "JP": "Japan"}
    features = []
    for i, (code, rings) in enumerate(POLYGONS):
        multi = i % 2 == 1
        key = "ADMIN" if i == 4 else "name"
        features.append({"type": "Feature", "properties": {key: names[code]}, "geometry": {
            "type": "MultiPolygon" if multi else "Polygon",
            "coordinates": [rings] if multi else rings}})
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    for name in ("Elsewhere", "South China Islands"):
        features.append({"type": "Feature", "properties": {"name": name}, "geometry": {
            "type": "Polygon", "coordinates": square}})
    return json.dumps({"type": "FeatureCollection", "features": features})


@query("src_polygons_geojson", views="geo_tracks edges", oracle="""
WITH inside AS (
 SELECT g.event_id, e.code FROM geo_tracks g, edges e
 GROUP BY g.event_id, e.code
 HAVING SUM(CASE WHEN (y1 > lat) <> (y2 > lat)
  AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)
SELECT e.code, e.edges, e.rings, e.west, e.south, e.east, e.north, i.points_inside
FROM (SELECT code, COUNT(*) AS edges, COUNT(DISTINCT ring) AS rings, MIN(x1) AS west,
 MIN(y1) AS south, MAX(x1) AS east, MAX(y1) AS north FROM edges GROUP BY code) e
LEFT JOIN (SELECT code, COUNT(*) AS points_inside FROM inside GROUP BY code) i ON i.code = e.code
""")
def _(t):
    path = scratch(t.spark, "countries")
    t.spark.range(1).select(F.lit(geojson()).alias("value")).write.text(path)
    edges = read_polygons(t.spark, path)
    shapes = edges.groupBy("code").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("ring").alias("rings"),
        F.min("x1").alias("west"), F.min("y1").alias("south"),
        F.max("x1").alias("east"), F.max("y1").alias("north"))
    points = t.geo_tracks
    inside = points.join(polygon_hits(points, edges), on=["lon", "lat"]).groupBy("code").agg(
        F.count(F.lit(1)).alias("points_inside"))
    return shapes.join(inside, on="code", how="left")


@query("src_time_slice", views="obs_raw", oracle="""
SELECT CAST(YEAR(date) AS INTEGER) AS year, date, lat, lon, sst, l_orderkey, l_linenumber
FROM obs_raw WHERE date IN (SELECT MIN(date) FROM obs_raw GROUP BY YEAR(date))
 AND sst IS NOT NULL""")
def _(t):
    path = scratch(t.spark, "slices")
    write_grid(t.obs_raw.withColumn("year", F.year("date")), path, partition_by=["year"])
    cells = first_slice(read_grid(t.spark, path), "date", ["lat", "lon", "sst"], by=["year"])
    return cells.select("year", "date", "lat", "lon", "sst", "l_orderkey", "l_linenumber")


DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("src_dataset_profile", oracle=" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, (SELECT COUNT(*) FROM {n}) AS row_count, "
    f"(SELECT CAST(COUNT(*) AS INTEGER) FROM (DESCRIBE {n})) AS column_count, "
    f"CAST(LEAST(20, (SELECT COUNT(*) FROM {n})) AS INTEGER) AS sampled, FALSE AS failed" for n in DRIVER_TABLES)
    + " UNION ALL SELECT 'absent', NULL, NULL, NULL, TRUE")
def _(t):
    found = profile_datasets(t.spark, {n: t.path(n) for n in DRIVER_TABLES} | {"absent": t.path("absent")})
    sampled = F.when(F.col("sample_rows").isNotNull(), F.size("sample_rows"))
    return found.select("dataset", "row_count", "column_count", sampled.alias("sampled"),
                        F.col("error").isNotNull().alias("failed"))


@query("src_row_counts_by_category", oracle="""
WITH u AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS category, COUNT(*) AS row_count FROM {n}" for n in DRIVER_TABLES) + """)
SELECT category, row_count FROM u UNION ALL SELECT 'TOTAL', CAST(SUM(row_count) AS BIGINT) FROM u""")
def _(t):
    return count_rows_by_category(t.spark, [t.path(n) for n in DRIVER_TABLES],
                                  r"/([a-z_]+)\.parquet(?:/[^/]*)?$")


@query("snk_parquet_overwrite_append", oracle="""
SELECT o_orderstatus, COUNT(*) AS row_count,
 CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders GROUP BY o_orderstatus""")
def _(t):
    path = scratch(t.spark, "orders")
    finished = F.col("o_orderstatus") == "F"
    write_grid(t.orders, path)
    write_grid(t.orders.filter(finished), path)
    write_grid(t.orders.filter(~finished), path, mode="append")
    return read_grid(t.spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("snk_partitioned", views="obs_raw", oracle="""
SELECT CAST(YEAR(date) AS INTEGER) AS year, CAST(MONTH(date) AS INTEGER) AS month,
 COUNT(*) AS row_count, CAST(SUM(CAST(CASE WHEN YEAR(date) = 1997 THEN slp * 2 ELSE slp END
  AS DECIMAL(18, 2))) AS DOUBLE) AS slp_sum
FROM obs_raw GROUP BY 1, 2""")
def _(t):
    path = scratch(t.spark, "grid")
    obs = t.obs_raw.select("slp", F.year("date").alias("year"), F.month("date").alias("month"))
    write_grid(obs, path, partition_by=["year", "month"])
    redone = obs.filter("year = 1997").withColumn("slp", F.col("slp") * 2)
    write_grid(redone, path, partition_by=["year", "month"])
    return read_grid(t.spark, path).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("slp").cast("decimal(18,2)")).cast("double").alias("slp_sum"))
