"""Queries of geometry: clipping, hulls, corridors, footprints and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.functions.geo import haversine_km
from emberfold.operators import clusters, geometry
from emberfold.plans import tables as T

BOOK = T.Book()
r6 = lambda c, name: F.round(c, 6).alias(name)


@BOOK.add("G1_clip_lines")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = geometry.clip_segments(T.segments(spark, sf_dir), T.REGION)
    return got.select("sid", "piece", "clipped", r6(haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), "km"))


def _square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed ring around each place; every fifth one crosses itself, and every seventh is open."""
    p = lambda dx, dy: F.array(F.col("lon") + dx, F.col("lat") + dy)
    first = p(0.0, 0.0)
    fair, odd = F.array(first, p(0.02, 0.0), p(0.02, 0.01), p(0.0, 0.01), first), F.array(first, p(0.02, 0.01), p(0.02, 0.0), p(0.0, 0.01), first)
    ring = F.when(F.col("sub") % 5 == 0, odd).otherwise(fair)
    return T.substations(spark, sf_dir).withColumn("ring", F.when(F.col("sub") % 7 == 0, F.slice(ring, 1, 4)).otherwise(ring))


@BOOK.add("P12_valid_geometry", f"WITH {T.B} SELECT sub, sub % 7 > 0 AND sub % 5 > 0 AS valid FROM sub_")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _square(spark, sf_dir).select("sub", geometry.valid(F.lit("Polygon"), F.col("ring")).alias("valid"))


@BOOK.add("G2_interior_points", f"WITH {T.B} SELECT sub, round(lon + 0.01e0, 6) AS lon, round(lat + 0.01e0 * 0.5000123e0, 6) AS lat FROM sub_ WHERE sub % 7 > 0 AND sub % 5 > 0")
def interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _square(spark, sf_dir).where("sub % 7 > 0 and sub % 5 > 0")
    x, y = geometry.interior_point(F.col("ring"))
    return rows.select("sub", r6(x, "lon"), r6(y, "lat"))


@BOOK.add("M10_event_hulls")
def hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = clusters.cluster(T.recent(spark, sf_dir))
    points = members.groupBy("cluster").agg(F.collect_list(F.array("lon", "lat")).alias("points"))
    return points.select("cluster", F.size("points").alias("n"), F.size(geometry.hull(F.col("points"))).alias("corners"))


_to = lambda i: f"degrees(asin(sin(radians(lat)) * cos(20e0 / 6371) + cos(radians(lat)) * sin(20e0 / 6371) * cos(radians(det % 360 - 22 + 4.4e0 * {i}))))"


@BOOK.add("M23_corridors", f"WITH {T.R} SELECT det, 13 AS points, round({_to(0)}, 6) AS first_lat, round({_to(10)}, 6) AS last_lat FROM recent")
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = geometry.corridor_polygon(F.col("lat"), F.col("lon"), (F.col("det") % 360).cast("double"), F.lit(20.0))
    rows = T.recent(spark, sf_dir).withColumn("ring", ring)
    at = lambda i: F.get(F.get("ring", F.lit(i)), F.lit(1))
    return rows.select("det", F.size("ring").alias("points"), r6(at(1), "first_lat"), r6(at(11), "last_lat"))


@BOOK.add("M21_footprints", f"WITH {T.R} SELECT det, round(lon - greatest(0.0005e0, (det % 5) * 0.2e0 / 2 / (111.32e0 * cos(radians(lat)))), 6) AS west, round(lat + greatest(0.0005e0, (det % 3) * 0.3e0 / 2 / 110.574e0), 6) AS north FROM recent")
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.footprint(F.col("lat"), F.col("lon"), (F.col("det") % 5) * 0.2, (F.col("det") % 3) * 0.3)
    return T.recent(spark, sf_dir).select("det", r6(box["west"], "west"), r6(box["north"], "north"))
