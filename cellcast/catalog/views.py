"""Input views over the driver tables, shared by the Spark queries and their oracles.

The text is valid in Spark SQL and DuckDB. A view may read the tables and the views listed in
``NEEDS``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "obs_raw": """
SELECT l_orderkey, l_linenumber, l_suppkey AS cell_id,
 CAST(l_suppkey % 121 AS DOUBLE) / 4 AS lat,
 100 + CAST(FLOOR(CAST(l_suppkey AS DOUBLE) / 121) AS DOUBLE) / 4 AS lon,
 CAST(l_shipdate AS DATE) AS date,
 CAST(l_discount * 100 - 5 AS DOUBLE) AS u_wind, CAST(l_tax * 100 - 4 AS DOUBLE) AS v_wind,
 l_extendedprice AS slp,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS sst
FROM lineitem""",
    "tracks": """
SELECT CONCAT('S', CAST(l_orderkey % 500 AS STRING)) AS SID,
 l_shipdate + INTERVAL '1' HOUR * l_linenumber AS ts,
 CAST((l_suppkey % 121) * 0.25 + (l_partkey % 9 - 4) * 0.01 AS DOUBLE) AS lat,
 CAST(100 + FLOOR(l_suppkey / 121.0) * 0.25 + (l_orderkey % 9 - 4) * 0.01 AS DOUBLE) AS lon,
 CAST(l_quantity * 2 AS DOUBLE) AS wind_kts, CAST(1000 - l_quantity AS DOUBLE) AS pressure,
 l_orderkey, l_linenumber
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45""",
    "month_index": """
SELECT y AS oni_year, m AS oni_month,
 CASE WHEN (y * 12 + m) % 17 = 0 THEN NULL
  ELSE CAST(((y * 12 + m) * 7 % 41 - 20) / 10.0 AS DOUBLE) END AS oni_value
FROM (SELECT DISTINCT CAST(YEAR(l_shipdate) AS INT) AS y, CAST(MONTH(l_shipdate) AS INT) AS m
 FROM lineitem) t""",
    "scores": """
SELECT l_orderkey, l_linenumber,
 CAST(YEAR(l_shipdate) AS INT) AS year, CAST(MONTH(l_shipdate) AS INT) AS month,
 CAST(l_suppkey % 121 AS DOUBLE) / 4 AS lat,
 100 + CAST(FLOOR(CAST(l_suppkey AS DOUBLE) / 121) AS DOUBLE) / 4 AS lon,
 CAST((l_orderkey * 31 + l_linenumber * 17) % 1000 AS DOUBLE) / 1000 AS prob,
 CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 1 ELSE 0 END AS label
FROM lineitem""",
    "geo_tracks": """
SELECT CONCAT('E', CAST(CAST(FLOOR(event_id / 8.0) AS BIGINT) AS STRING)) AS SID, ts, event_id,
 CAST((event_id * 37 % 3000) / 100.0 AS DOUBLE) AS lat,
 CAST(100 + (event_id * 53 % 8000) / 100.0 AS DOUBLE) AS lon
FROM events""",
    "monthly": """
SELECT year, month, actual_count,
 CAST(actual_count + ((year * 12 + month) * 13 % 7 - 3) * 0.5 AS DOUBLE) AS pred_count
FROM (SELECT CAST(YEAR(o_orderdate) AS INT) AS year,
 CAST(CASE MONTH(o_orderdate) WHEN 3 THEN 2 ELSE MONTH(o_orderdate) END AS INT) AS month,
 COUNT(*) % 13 AS actual_count
FROM orders GROUP BY 1, 2) t""",
    "dirty": """
SELECT event_id, ts, CASE event_id % 11 WHEN 0 THEN '-999' WHEN 1 THEN '' WHEN 2 THEN ' '
 WHEN 3 THEN '-9999' ELSE CAST(value AS STRING) END AS raw_value
FROM events""",
    "grid_blocks": """
SELECT vec_id AS t, embedding AS vals FROM embeddings""",
    # monthly with a driver, an index that tracks the actual count, and counts per outcome
    "monthly_x": """
SELECT year, month, actual_count, pred_count,
 CAST(((year * 12 + month) * 7 % 41 - 20) / 10.0 AS DOUBLE) AS driver,
 CAST(actual_count * 3 + (year * 12 + month) * 11 % 13 AS DOUBLE) AS monthly_index,
 CAST(actual_count + (year * 12 + month) * 5 % 9 AS DOUBLE) AS index_VN,
 CAST((year * 12 + month) * 17 % 19 - 3 AS DOUBLE) AS index_PH,
 CAST((actual_count + month) % 4 AS BIGINT) AS actual_VN,
 CAST((actual_count * 2 + month) % 5 AS BIGINT) AS actual_PH,
 CAST((actual_count + month) % 4 + (year + month) % 3 * 0.5 AS DOUBLE) AS pred_VN,
 CAST((actual_count * 2 + month) % 5 - (year + month) % 2 * 0.25 AS DOUBLE) AS pred_PH
FROM monthly""",
    # measures and the rare label of each row
    "labelled": """
SELECT l_orderkey, l_linenumber, CAST(YEAR(l_shipdate) AS INT) AS year,
 CAST(MONTH(l_shipdate) AS INT) AS month, CAST(l_suppkey % 121 AS DOUBLE) / 4 AS lat,
 l_discount * 100 - 5 AS u_wind, l_extendedprice AS slp,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS sst,
 CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 1 ELSE 0 END AS label
FROM lineitem""",
    # one row per cell and day
    "cell_day": """
SELECT lat, lon, date, AVG(u_wind) AS u_wind_avg, AVG(v_wind) AS v_wind_avg, AVG(slp) AS slp_avg,
 AVG(SQRT(u_wind * u_wind + v_wind * v_wind)) AS wind_speed_env_avg, AVG(sst) AS sst_avg
FROM obs_raw GROUP BY lat, lon, date""",
    # scores with a fixed split
    "split_scores": """
SELECT s.*, CASE WHEN year <= 1998 THEN 'Train' WHEN year = 1999 THEN 'Val' ELSE 'Test' END AS split
FROM scores s""",
}
NEEDS = {"monthly_x": ("monthly",), "cell_day": ("obs_raw",), "split_scores": ("scores",)}
TABLES = ("lineitem", "orders", "events", "embeddings")

# Polygons used with geo_tracks, as (code, rings); x is longitude, y latitude.
POLYGONS = (
    ("VN", [[(104, 9), (109, 9), (109, 21), (104, 21), (104, 9)]]),
    ("PH", [[(118, 6), (126, 6), (126, 18), (118, 18), (118, 6)]]),
    ("CN", [[(108, 20), (121, 20), (121, 29), (114, 24), (108, 29), (108, 20)]]),
    ("TW", [[(124, 20), (128, 20), (128, 24), (124, 24), (124, 20)]]),
    ("JP", [[(129, 27), (141, 27), (141, 29.9), (129, 29.9), (129, 27)],
            [(133, 28), (136, 28), (136, 29.4), (133, 29.4), (133, 28)]]),
)


def edge_rows() -> list[tuple]:
    """``(code, poly_order, part, ring, edge, x1, y1, x2, y2)`` of the fixed polygons."""
    return [(code, order, 0, r, e, float(ring[e][0]), float(ring[e][1]),
             float(ring[e + 1][0]), float(ring[e + 1][1]))
            for order, (code, rings) in enumerate(POLYGONS, start=1)
            for r, ring in enumerate(rings) for e in range(len(ring) - 1)]


EDGE_SCHEMA = ("code string, poly_order int, part int, ring int, edge int, "
               "x1 double, y1 double, x2 double, y2 double")
VIEWS["edges"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r[0]}', {r[1]}, {r[2]}, {r[3]}, {r[4]}, "
    + ", ".join(f"CAST({v} AS DOUBLE)" for v in r[5:]) + ")" for r in edge_rows()
) + ") AS t(code, poly_order, part, ring, edge, x1, y1, x2, y2)"


def with_views(body: str, names: list[str]) -> str:
    """``body`` with the named views, and those they need, as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    head, tail = ("WITH ", body) if not body.lstrip().upper().startswith("WITH ") else (
        "WITH ", "," + body.lstrip()[4:])
    return f"{head}{ctes}{'' if tail.startswith(',') else chr(10)}{tail}"


class Tables:
    """Driver tables and views as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def edges(self) -> DataFrame:
        return self.spark.createDataFrame(edge_rows(), EDGE_SCHEMA)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            if name.startswith("_"):
                raise AttributeError(name)
            return self.table(name)
        text, inputs = VIEWS[name], {}
        for source in (*TABLES, *NEEDS.get(name, ())):
            marked = text.replace(f"FROM {source}", "FROM {" + source + "}")
            if marked != text:
                text, inputs[source] = marked, getattr(self, source)
        return self.spark.sql(text, **inputs)
