"""Joins of rows that an explode has multiplied: the optimizer takes such tables for small ones, and must not broadcast them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberfold.operators import association, boundary, clusters, graph, spatial
from emberfold.streaming import clusters as stream_clusters


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Slim tables in files, whose size the optimizer knows."""
    rng = random.Random(3)
    rows = [(i, 38 + rng.random() * 0.2, 29 + rng.random() * 0.2, float(rng.randrange(0, 40_000_000)), ("viirs-modis", "slstr", "mtg")[i % 3], f"s{i % 3}") for i in range(300)]
    at = str(tmp_path_factory.mktemp("stored") / "dets")
    spark.createDataFrame(rows, "det long, lat double, lon double, ms double, family string, source_id string").write.parquet(at)
    return spark.read.parquet(at)


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_pairs(stored):
    assert broadcasts(clusters.close_pairs(stored)) == 0
    assert broadcasts(stream_clusters.touching(stored.withColumn("cluster", F.col("det")), stored.withColumn("cluster", F.col("det")), 5.0, 6.0)) == 0


def test_association_edges(stored):
    """The table of rules is all that is broadcast."""
    assert broadcasts(association.edges(stored.withColumn("idx", F.col("det")))) == 1


def test_many_assets(stored, monkeypatch):
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 10)
    places = stored.select(F.col("det").alias("sub"), "lat", "lon")
    assert broadcasts(spatial.point_hits(stored, places, 2.0)) <= 2  # hot cells, which are counted


def area(spark, n):
    ring = [(0, i, 5 * c, 5 * s) for i in range(n) for c, s in [(math.cos(6.283185307179586 * i / n), math.sin(6.283185307179586 * i / n))]]
    return boundary.area(boundary.edges_of(spark.createDataFrame(ring, "ring int, seq long, lon double, lat double")))


def test_crossings(spark, stored, monkeypatch):
    of = area(spark, 40)
    monkeypatch.setattr("emberfold.runtime.BROADCAST_BYTES", 0)
    segs = stored.select("det", F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("lon") + 1).alias("x2"), (F.col("lat") + 1).alias("y2"))
    assert broadcasts(boundary.crossings(segs, of, "det")) == 0


def test_polygons_around_islands(spark):
    """A polygon looks for the boundary's rings in four cells, however many of the boundary's cells it covers."""
    ring = [(k, i, 20 * k + 0.01 * x, 0.01 * y) for k in range(3) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    of = boundary.area(boundary.edges_of(spark.createDataFrame(ring, "ring int, seq long, lon double, lat double")))
    of.size = 1e-6  # as if of very many edges: 4e14 cells of this size lie between the islands
    of.x0, of.y0 = -1.0, -1.0
    box = lambda x, y, z: [[x - z, y - z], [x + z, y - z], [x + z, y + z], [x - z, y + z], [x - z, y - z]]
    shapes = [(1, box(20, 0, 19.0)), (2, box(10, 0, 9.0)), (3, box(20, 0, 30.0)), (4, box(40, 0.5, 0.7)), (5, box(40, 5, 0.7))]
    rows = spark.createDataFrame([(i, "Polygon", p) for i, p in shapes], "id long, shape string, points array<array<double>>")
    got = boundary.around_marks(rows, of, "id")
    assert {r["id"] for r in got.collect()} == {1, 3, 4}


def test_cells_are_joined_before_members_are_compared(spark, monkeypatch):
    """Sixty cells in a row are one cluster by their first members, so that no pair of other members is looked at."""
    seen = []
    plain = clusters._few_links
    monkeypatch.setattr(clusters, "_few_links", lambda placed, pairs, *rest: seen.append(pairs.count()) or plain(placed, pairs, *rest))
    rows = spark.range(6_000).select(F.col("id").alias("det"), F.lit(38.0).alias("lat"), (20 + F.col("id") % 60 * 0.04).alias("lon"), (F.col("id") % 7 * 1e5).alias("ms"))
    assert clusters.cluster(rows).select("cluster").distinct().count() == 1 and seen == [0]


def test_components_of_blocks(spark, monkeypatch):
    monkeypatch.setattr("emberfold.operators.graph.HELD", 50)
    rng = random.Random(8)
    links = [(rng.randrange(3_000), rng.randrange(3_000), rng.randrange(7)) for _ in range(2_000)] + [(i, i + 1, i // 10) for i in range(5_000, 5_400)]
    df = spark.createDataFrame(links, "u long, v long, block long")
    key = lambda r: (r["node"], r["component"])
    assert sorted(map(key, graph.components_nearby(df, "block").collect())) == sorted(set(map(key, graph.components(df).collect())))
