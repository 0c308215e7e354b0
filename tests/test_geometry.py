"""Clipping, interior points, rings and hulls against sampling and known shapes."""

import random

import pytest
from pyspark.sql import functions as F

from emberfold.operators import geometry
from emberfold.plans.tables import REGION
from emberfold.sources import grid


def odd(x, y, rings):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def test_clip(spark):
    rng = random.Random(1)
    rows = [(i, *[rng.uniform(28.2, 30.8) if k % 2 == 0 else rng.uniform(36.6, 39.1) for k in range(4)]) for i in range(200)]
    got = geometry.clip_segments(spark.createDataFrame(rows, "sid long, a_lon double, a_lat double, b_lon double, b_lat double"), REGION).collect()
    share = dict.fromkeys(range(200), 0.0)
    for r in got:
        s = rows[r["sid"]]
        whole = ((s[3] - s[1]) ** 2 + (s[4] - s[2]) ** 2) ** 0.5
        share[r["sid"]] += ((r["b_lon"] - r["a_lon"]) ** 2 + (r["b_lat"] - r["a_lat"]) ** 2) ** 0.5 / whole
        assert odd((r["a_lon"] + r["b_lon"]) / 2, (r["a_lat"] + r["b_lat"]) / 2, REGION)
    for i, x1, y1, x2, y2 in rows:
        seen = sum(odd(x1 + (x2 - x1) * t / 1000, y1 + (y2 - y1) * t / 1000, REGION) for t in range(1000)) / 1000
        assert share[i] == pytest.approx(seen, abs=0.005)


def test_interior_point(spark):
    u = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [6.0, 9.0], [6.0, 1.0], [2.0, 1.0], [2.0, 9.0], [0.0, 9.0], [0.0, 0.0]]
    x, y = geometry.interior_point(F.col("ring"))
    r = spark.createDataFrame([(u,)], "ring array<array<double>>").select(x.alias("x"), y.alias("y")).first()
    assert odd(r["x"], r["y"], [u[:-1]]) and r["x"] == pytest.approx(7.5)


def test_rings_hulls_and_validity(spark):
    ways = [[[0.0, 0.0], [1.0, 0.0]], [[1.0, 1.0], [1.0, 0.0]], [[1.0, 1.0], [0.0, 0.0]], [[5.0, 5.0], [6.0, 6.0]]]
    got = spark.createDataFrame([(ways,)], "w array<array<array<double>>>").select(geometry.assemble(F.col("w")).alias("r")).first()["r"]
    assert got == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    pts = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [1.0, 1.0], [1.0, 0.0]]
    hull = spark.createDataFrame([(pts,)], "p array<array<double>>").select(geometry.hull(F.col("p")).alias("h")).first()["h"]
    assert hull == [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    fair, bow = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]], [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]
    rows = [("Polygon", fair, True), ("Polygon", bow, False), ("Polygon", fair[:3], False), ("LineString", fair[:2], True), ("LineString", [fair[0], fair[0]], False), ("Point", [[1.0, float("nan")]], False), ("Point", [[1.0, 2.0]], True), ("Polygon", None, False), ("Odd", fair, False)]
    df = spark.createDataFrame(rows, "shape string, points array<array<double>>, want boolean").withColumn("got", geometry.valid(F.col("shape"), F.col("points")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_boundaries(spark, tmp_path):
    ring = lambda x, y: [[x, y], [x + 1, y], [x + 1, y + 1], [x, y]]
    parts = spark.createDataFrame([("EL", 0, ring(20.0, 38.0)), ("PT", 0, ring(-9.0, 38.0)), ("PT", 1, ring(-28.0, 38.0)), ("PT", 2, ring(-9.0, 32.0))], "code string, part int, ring array<array<double>>")
    assert sorted((r["country"], r["part"]) for r in grid.boundaries(parts).collect()) == [("GR", 0), ("PT", 0)]
    spark.createDataFrame([("TR", "400", 1), ("TR", "154", 2), ("ES", "400", 3)], "country string, layer string, n int").write.partitionBy("country", "layer").parquet(str(tmp_path / "g"))
    assert {r["layer"]: r["n"] for r in grid.layer_stats(grid.read_layer(spark, str(tmp_path / "g"), "TR")).collect()} == {"400": 1, "154": 1}
    (tmp_path / "f/ES").mkdir(parents=True)
    (tmp_path / "f/ES/a.json").write_bytes(b"x" * 10)
    (tmp_path / "f/ES/b.json").write_bytes(b"y" * 5)
    sizes = grid.file_sizes(spark, str(tmp_path / "f"))
    assert [(r["country"], r["files"], r["bytes"]) for r in sizes.collect()] == [("ES", 2, 15)]
    assert "| bytes | 15 |" in grid.markdown(sizes)
