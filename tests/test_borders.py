"""Areas of many edges and rings of relations against plain versions."""

import math
import random

import pytest

from emberfold.operators import boundary, relations
from emberfold.plans import borders


def wiggly(rng, cx, cy, r, n):
    return [(cx + r * (1 + rng.uniform(-0.2, 0.2)) * math.cos(2 * math.pi * i / n), cy + r * (1 + rng.uniform(-0.2, 0.2)) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def plain_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


RINGS = {
    "many": lambda rng: [wiggly(rng, 0, 0, 2, 400), wiggly(rng, 0.1, 0, 0.5, 90), wiggly(rng, 4, 1, 0.3, 7)],
    "square": lambda rng: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]],
    "sliver": lambda rng: [[(0, 0), (100, 0.001), (50, 0.002)]],
    "triangle": lambda rng: [[(0, 0), (1, 0), (0.5, 1)]],
}


def table(spark, rings):
    rows = [(r, i, float(x), float(y)) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    return boundary.area(boundary.edges_of(spark.createDataFrame(rows, "ring int, seq int, lon double, lat double")))


@pytest.mark.parametrize("name", sorted(RINGS))
def test_points(spark, name):
    rng = random.Random(3)
    rings = RINGS[name](rng)
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    points = [(i, rng.uniform(min(xs) - 1, max(xs) + 1), rng.uniform(min(ys) - 0.5, max(ys) + 0.5) if name != "sliver" else rng.uniform(-0.001, 0.003)) for i in range(800)]
    points += [(1000, None, 1.0), (1001, 1.0, None), (1002, 1e9, -1e9)]
    got = boundary.points_inside(spark.createDataFrame(points, "id long, lon double, lat double"), table(spark, rings)).collect()
    assert {r["id"]: r["inside"] for r in got} == {i: x is not None and y is not None and plain_inside(x, y, rings) for i, x, y in points}


def test_clip_and_meet(spark):
    rng = random.Random(5)
    rings = RINGS["many"](rng)
    segs = [(i, *[rng.uniform(-3, 5) if k % 2 == 0 else rng.uniform(-3, 3) for k in range(4)]) for i in range(150)]
    area = table(spark, rings)
    pieces = boundary.clip(spark.createDataFrame(segs, "sid long, a_lon double, a_lat double, b_lon double, b_lat double"), area, "sid").collect()
    inner = {s[0]: 0.0 for s in segs}
    for r in pieces:
        inner[r["sid"]] += math.hypot(r["b_lon"] - r["a_lon"], r["b_lat"] - r["a_lat"])
    for sid, x1, y1, x2, y2 in segs:
        steps = 4000
        plain = sum(plain_inside(x1 + (x2 - x1) * (k + 0.5) / steps, y1 + (y2 - y1) * (k + 0.5) / steps, rings) for k in range(0, steps, 20)) * 20 / steps * math.hypot(x2 - x1, y2 - y1)
        assert abs(plain - inner[sid]) < 0.15
    box = lambda x, y, z: [[x - z, y - z], [x + z, y - z], [x + z, y + z], [x - z, y + z], [x - z, y - z]]
    shapes = [(1, "Polygon", box(4, 1, 1.0), True), (2, "Polygon", box(4, 1, 0.05), True), (3, "Polygon", box(0.1, 0, 0.1), False), (4, "Polygon", box(0, 0, 9.0), True), (5, "LineString", [[-9.0, 0.0], [9.0, 0.0]], True), (6, "LineString", [[-9.0, 9.0], [9.0, 9.0]], False), (7, "Point", [[1.5, 0.0]], True), (8, "Point", [[0.1, 0.0]], False), (9, "Polygon", [], False), (10, "LineString", [[8.0, 0.0], [9.0, 0.0]], False)]
    got = boundary.intersects(spark.createDataFrame([s[:3] for s in shapes], "id long, shape string, points array<array<double>>"), area, "id").collect()
    assert {r["id"]: r["meets"] for r in got} == {s[0]: s[3] for s in shapes}
    assert not any(r["meets"] for r in boundary.intersects(spark.createDataFrame([s[:3] for s in shapes], "id long, shape string, points array<array<double>>"), None, "id").collect())


def test_plan_does_not_grow(spark):
    size = lambda n: len(boundary.points_inside(spark.range(9).selectExpr("id AS det", "id * 1.0D AS lon", "id * 1.0D AS lat"), table(spark, [wiggly(random.Random(1), 0, 0, 2, n)]))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(20) - size(2000)) < 200
    assert boundary.area(spark.createDataFrame([], "ring int, x1 double, y1 double, x2 double, y2 double")) is None


def chopped(rng, ring, ways, first, role):
    """A closed ring in ``ways`` parts of either direction."""
    at = sorted(rng.sample(range(1, len(ring) - 1), ways - 1))
    parts = [ring[a : b + 1] for a, b in zip([0, *at], [*at, len(ring) - 1], strict=True)]
    return [(first + i, role, [list(p) for p in (x if rng.random() < 0.5 else x[::-1])]) for i, x in enumerate(parts)]


def test_rings_of_many_ways(spark):
    """Rings of 1 to 60 ways in any order and direction come out whole; holes go to the smallest ring around them."""
    rng = random.Random(8)
    circle = lambda x, y, r, n: [(float(round(x + r * math.cos(2 * math.pi * i / n), 6)), float(round(y + r * math.sin(2 * math.pi * i / n), 6))) for i in range(n)] + [(float(x + r), float(y))]
    rows, want = [], {}
    for rel, ways in enumerate([1, 2, 3, 17, 60]):
        mine = chopped(rng, circle(0, 0, 5, 80), ways, 100, "outer") + chopped(rng, circle(20, 0, 3, 40), 4, 200, None)
        mine += chopped(rng, circle(1, 1, 1, 12), 3, 300, "inner") + chopped(rng, circle(20, 0, 1, 9), 1, 400, "inner") + chopped(rng, circle(50, 50, 1, 9), 2, 500, "inner")
        mine += [(600, "outer", [[9.0, 9.0], [9.0, 8.0]]), (601, "outer", [[9.0, 8.0], [8.0, 8.0]]), (602, "outer", [[7.0, 7.0]]), (603, "outer", None)]
        rng.shuffle(mine)
        rows += [(rel, *m) for m in mine]
        want[rel] = [[80, 12], [40, 9]]
    rows += [(9, 1, "outer", [[0.0, 0.0], [1.0, 1.0]]), (9, 2, "inner", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])]
    got = relations.polygons(spark.createDataFrame(rows, "relation long, way long, role string, points array<array<double>>")).collect()
    assert {r["relation"]: [[len(ring) - 1 for ring in p] for p in r["polygons"]] for r in got} == want
    for r in got:
        for p in r["polygons"]:
            for ring in p:
                assert ring[0] == ring[-1] and len({tuple(x) for x in ring}) == len(ring) - 1


def test_ways_that_meet_oddly(spark):
    """Three ways in one point close nothing there; nested outer rings give a hole to the inner one."""
    ways = [(1, 1, "outer", [[0.0, 0.0], [1.0, 0.0]]), (1, 2, "outer", [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]), (1, 3, "outer", [[0.0, 0.0], [5.0, 5.0]])]
    box = lambda z: [[-z, -z], [z, -z], [z, z], [-z, z], [-z, -z]]
    ways += [(2, 1, "outer", box(4.0)), (2, 2, "outer", box(2.0)), (2, 3, "inner", box(1.0)), (2, 4, "inner", box(3.0)), (2, 5, "outer", [[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])]
    got = {r["relation"]: r["polygons"] for r in relations.polygons(spark.createDataFrame(ways, "relation long, way long, role string, points array<array<double>>")).collect()}
    assert got == {2: [[box(4.0), box(3.0)], [box(2.0), box(1.0)]]}
    assert relations.polygons(spark.createDataFrame([], "relation long, way long, role string, points array<array<double>>")).count() == 0


def test_elements(spark):
    got = {r["id"]: r["shape"] for r in borders.elements(spark, "/root/testdata/sf0.001").collect()}
    assert set(got.values()) == {"Point", "Polygon", "MultiPolygon"} and 10 not in got
