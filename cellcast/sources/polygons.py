"""GeoJSON polygons as edge rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURES = ("features array<struct<properties:struct<name:string,ADMIN:string>,"
             "geometry:struct<type:string,coordinates:string>>>")

# Country name fragments and the outcome code each maps to.
OUTCOME_NAMES = {
    "Vietnam": "VN",
    "Philippines": "PH",
    "China": "CN",
    "Taiwan": "TW",
    "Japan": "JP",
}


def rings_to_edges(df: DataFrame, parts: str = "parts") -> DataFrame:
    """``parts`` (polygon parts, rings, points) to one row per edge, other columns kept."""
    keep = [c for c in df.columns if c != parts]
    rings = (df.select(*keep, F.posexplode(parts).alias("part", "rings"))
             .select(*keep, "part", F.posexplode("rings").alias("ring", "points")))
    edges = F.transform(
        F.sequence(F.lit(0), F.size("points") - 2),
        lambda i: F.struct(
            i.alias("edge"),
            F.get(F.get("points", i), F.lit(0)).alias("x1"),
            F.get(F.get("points", i), F.lit(1)).alias("y1"),
            F.get(F.get("points", i + 1), F.lit(0)).alias("x2"),
            F.get(F.get("points", i + 1), F.lit(1)).alias("y2")))
    return (rings.filter(F.size("points") >= 2)
            .select(*keep, "part", "ring", F.inline(edges)))


def read_polygons(spark: SparkSession, path: str,
                  wanted: Mapping[str, str] = OUTCOME_NAMES) -> DataFrame:
    """Edge rows ``(code, poly_order, part, ring, edge, x1, y1, x2, y2)`` of the wanted features.

    A feature matches when its name contains a wanted name, ignoring case; the first match of each
    code in file order is taken, and ``poly_order`` is that order.
    """
    features = (spark.read.schema(_FEATURES).option("multiLine", True).json(path)
                .select(F.posexplode("features").alias("position", "f"))
                .select("position", F.coalesce("f.properties.name", "f.properties.ADMIN",
                                               F.lit("")).alias("name"),
                        F.col("f.geometry.type").alias("kind"),
                        F.col("f.geometry.coordinates").alias("coordinates")))
    names = list(wanted)
    hits = F.filter(
        F.array(*[F.struct(F.lit(n.lower()).alias("name"), F.lit(wanted[n]).alias("code"),
                           F.lit(i).alias("rank")) for i, n in enumerate(names)]),
        lambda w: F.contains(F.lower("name"), w.getField("name")))
    single = F.from_json("coordinates", "array<array<array<double>>>")
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("kind") == "Polygon", F.array(single)).when(
        F.col("kind") == "MultiPolygon", multi)
    matched = (features.select("position", parts.alias("parts"), F.explode(hits).alias("w"))
               .select(F.col("w.code").alias("code"),
                       (F.col("position") * len(names) + F.col("w.rank")).alias("poly_order"),
                       "parts"))
    first = matched.groupBy("code").agg(
        F.min("poly_order").alias("poly_order"),
        F.min_by("parts", "poly_order").alias("parts"))
    return rings_to_edges(first)
