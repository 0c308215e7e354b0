"""Operators against plain Python and small cases whose outcome is known."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from emberfold.operators import association, clusters, detections, graph, grid_etl, series, spatial, windows


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_graph(spark, shape):
    rng = random.Random(1)
    n = 300
    links = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(200)], "path": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)]}[shape]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = components(n, links)
    assert all(want[k] == v for k, v in got.items()) and {x for a, b in links if a != b for x in (a, b)} == set(got)


@pytest.mark.parametrize("lat", [0.0, 40.0, 68.0])
def test_clusters(spark, lat):
    rng = random.Random(int(lat))
    rows = [(i, lat + rng.random() * 0.3, 29 + rng.random() * 0.5, float(rng.randrange(0, 48 * 3_600_000))) for i in range(400)]
    got = {r["det"]: r["cluster"] for r in clusters.cluster(spark.createDataFrame(rows, "det long, lat double, lon double, ms double")).collect()}
    links = [(a[0], b[0]) for a, b in combinations(rows, 2) if abs(a[3] - b[3]) <= 6 * 3_600_000 and km(a[1:3], b[1:3]) <= 5]
    assert [got[i] for i in range(400)] == components(400, links)


@pytest.mark.parametrize(("lat", "pairs"), [(0.0, 1), (38.0, 1), (70.0, 4096)])
def test_clusters_of_busy_cells(spark, monkeypatch, lat, pairs):
    monkeypatch.setattr(clusters, "BUSY", 1)
    monkeypatch.setattr(clusters, "PAIRS", pairs)
    rng, rows = random.Random(4), []
    for _ in range(6):
        y, x, t = lat + rng.uniform(-0.15, 0.15), 20 + rng.uniform(-0.3, 0.3), rng.uniform(0, 8e7)
        rows += [(len(rows) + i, y + rng.gauss(0, 0.008), x + rng.gauss(0, 0.012), t + rng.gauss(0, 4e6)) for i in range(50)]
    rows += [(300 + i, *rows[0][1:]) for i in range(5)]
    got = {r["det"]: r["cluster"] for r in clusters.cluster(spark.createDataFrame(rows, "det long, lat double, lon double, ms double")).collect()}
    links = [(a[0], b[0]) for a, b in combinations(rows, 2) if abs(a[3] - b[3]) <= 6 * 3_600_000 and km(a[1:3], b[1:3]) <= 5]
    assert [got[i] for i in range(305)] == components(305, links)


@pytest.mark.parametrize(("apart", "n"), [(0.0, 1), (0.058, 2)])
def test_two_adjoining_cells_of_fifty_thousand(spark, apart, n):
    """All pairs of the two would be 2.5 thousand million; those that are apart have no link that ends the search."""
    lon = F.when(F.col("id") < 50_000, 20 - F.rand(2) * 0.03).otherwise(20 + apart + F.rand(3) * 0.03)
    hot = spark.range(100_000).select(F.col("id").alias("det"), (38 + F.rand(1) * 0.01).alias("lat"), lon.alias("lon"), (F.rand(5) * 2e7).alias("ms"))
    got = clusters.cluster(hot).groupBy("cluster").count().collect()
    assert len(got) == n and sum(r["count"] for r in got) == 100_000


def test_hot_cells_of_distance_joins(spark, monkeypatch):
    """What is too large to be broadcast meets by cell, hot cells in shares: with the same hits."""
    rng = random.Random(2)
    points = spark.createDataFrame([(i, 38 + rng.random() * (0.01 if i < 300 else 1), 29 + rng.random() * (0.01 if i < 300 else 1)) for i in range(400)], "det long, lat double, lon double")
    places = spark.createDataFrame([(i, 38 + rng.random(), 29 + rng.random()) for i in range(60)], "sub long, lat double, lon double")
    want = sorted(map(tuple, spatial.point_hits(points, places, 30.0).collect()))
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(spatial, "HOT", 20)
    got = spatial.point_hits(points, places, 30.0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    shares = spatial.place_cells(points, 0.09).groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
    assert shares > 10 * spatial.HOT


def observations(rows):
    return [(i, float(la), float(lo), m * 60_000.0, fam, fam, float(frp)) for i, (la, lo, m, fam, frp) in enumerate(rows)]


SCHEMA = "idx long, lat double, lon double, ms double, family string, source_id string, frp double"
DEG = 1 / 111.195


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(40, 29, 0, "slstr", 1), (40, 29, 30, "viirs-modis", 2)], [0, 0]),
        ([(40, 29, 0, "slstr", 1), (40, 29, 120, "viirs-modis", 2)], [0, 1]),
        ([(40, 29, 0, "slstr", 1), (40, 29, 5, "slstr", 2)], [0, 1]),
        ([(40, 29, 0, "slstr", 1), (40 + 8 * DEG, 29, 0, "viirs-modis", 2)], [0, 1]),
        ([(40, 29, 0, "slstr", 1), (40, 29, 10, "viirs-modis", 2), (40, 29, 20, "mtg", 3)], [0, 0, 0]),
        ([(40, 29, 0, "slstr", 1), (40, 29 + 3.5 * DEG / math.cos(math.radians(40)), 0, "mtg", 2)], [0, 0]),
        # chains: all pairs across must be allowed
        ([(40, 29, 0, "viirs-modis", 1), (40 + 2 * DEG, 29, 0, "slstr", 2), (40 + 4.2 * DEG, 29, 0, "mtg", 3)], [0, 0, 2]),
        ([(40, 29, 0, "viirs-modis", 1), (40 + 2 * DEG, 29, 0, "slstr", 2), (40 + 3.6 * DEG, 29, 0, "mtg", 3)], [0, 0, 0]),
    ],
)
def test_association(spark, rows, want):
    got = association.associate(spark.createDataFrame(observations(rows), SCHEMA)).orderBy("idx").collect()
    assert [r["event"] for r in got] == want


def test_association_of_many_agrees_with_plain_merging(spark):
    rng = random.Random(9)
    rows = observations([(40 + rng.random() * 0.2, 29 + rng.random() * 0.2, rng.randrange(600), rng.choice(["slstr", "viirs-modis", "mtg"]), 1) for _ in range(300)])
    obs = {r[0]: r for r in rows}

    def rule(x, y):
        return association.RULES.get(tuple(sorted((obs[x][4], obs[y][4]))))

    def fits(x, y):
        r = rule(x, y)
        return r is None or (km(obs[x][1:3], obs[y][1:3]) <= r[0] and abs(obs[x][3] - obs[y][3]) <= r[1] * 60_000)

    edges = sorted((abs(obs[x][3] - obs[y][3]), km(obs[x][1:3], obs[y][1:3]), "\x00".join(sorted((obs[x][5], obs[y][5]))), x, y) for x, y in combinations(obs, 2) if rule(x, y) and fits(x, y))
    owner, members = {i: i for i in obs}, {i: [i] for i in obs}
    for *_, x, y in edges:
        a, b = owner[x], owner[y]
        if a != b and all(fits(p, q) for p in members[a] for q in members[b]):
            big, small = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
            for m in members[small]:
                owner[m] = big
            members[big] += members.pop(small)
    want = {i: min(g) for g in members.values() for i in g}
    got = {r["idx"]: r["event"] for r in association.associate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(set(want.values())) < 300


def test_association_in_rounds_agrees_with_one_task(spark, monkeypatch):
    """Large components are not merged by one task, and get the same events."""
    rng = random.Random(10)
    rows = observations([(40 + rng.random() * 0.15, 29 + rng.random() * 0.15, rng.randrange(500), rng.choice(["slstr", "viirs-modis", "mtg"]), 1) for _ in range(200)])
    obs = spark.createDataFrame(rows, SCHEMA)
    want = {r["idx"]: r["event"] for r in association.associate(obs).collect()}
    monkeypatch.setattr(association, "MOST", 5)
    got = {r["idx"]: r["event"] for r in association.associate(obs).collect()}
    assert got == want and len(set(want.values())) < 200


def test_dedupe(spark):
    rows = [(1, 40.0, 29.0, 45.0, "high", "p", "a"), (2, 40.0, 29.0, 55.0, None, "p", "b"), (3, 41.0, 29.0, 5.0, None, "p", "a")]
    df = spark.createDataFrame(rows, "seq long, lat double, lon double, frp double, confidence string, product string, source string")
    df = df.withColumns({"country": F.lit("TR"), "satellite": F.lit("S"), "detected_at": F.expr("timestamp_ntz'2026-08-05 12:00:10'")})
    first = {r["seq"]: r for r in detections.dedupe_first(df, ("seq", "frp", "confidence")).collect()}
    assert set(first) == {1, 3} and first[1]["frp"] == 55.0 and first[1]["confidence"] == "high" and first[1]["sources"] == ["a", "b"]
    best = {r["seq"]: r for r in detections.dedupe_strongest(df, ("seq", "frp", "confidence")).collect()}
    assert set(best) == {2, 3} and best[2]["frp"] == 55.0 and best[2]["confidence"] == "high"


def test_normalize(spark):
    raw = spark.createDataFrame([(1, "40.5", "29.5", "350", None, "2026-08-05", "935", "85", "1.1", "0.6", " N "), (2, "35xN", "nan", None, "NaN", "bad", "1", None, None, None, None)], "seq long, latitude string, longitude string, bright_ti4 string, frp string, acq_date string, acq_time string, confidence string, scan string, track string, satellite string")
    a, b = detections.normalize(raw, {"product": "P"}).orderBy("seq").collect()
    assert (a["lat"], a["bright_ti4"], a["satellite"], a["product"]) == (40.5, 350.0, "N", "P") and str(a["detected_at"]) == "2026-08-05 09:35:00"
    assert a["confidence_normalized"] == 0.85 and a["pixel_area_km2"] == pytest.approx(0.66)
    assert all(b[c] is None for c in ("lat", "lon", "frp", "detected_at", "confidence_normalized"))


def test_validity(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (None, 1.0), (1.0, None)], "lat double, lon double").withColumn("detected_at", F.current_timestamp())
    assert detections.valid(df).count() == 2 and detections.valid(df, drop_zero=True).count() == 1


def test_segments(spark):
    lines = spark.createDataFrame([("a", "400", 0, [[1.0, 2.0], [2.0, 3.0], [float("nan"), 1.0], [4.0, 4.0], [5.0, 5.0]]), ("b", "154", 0, [[1.0, 1.0]]), ("c", "154", 0, [])], "asset_key string, grid_class string, part int, points array<array<double>>")
    got = spatial.segments(lines).orderBy("at").collect()
    assert [(r["a_lon"], r["b_lon"]) for r in got] == [(1.0, 2.0), (4.0, 5.0)]


def test_peaks(spark):
    hours = [-49, -48, -20, -20, -3, 0, 1, -1]
    frps = [50.0, 60.0, 10.0, 20.0, 4.9, 30.0, 9.0, 7.0]
    df = spark.createDataFrame([(i, h * 3_600_000.0, f) for i, (h, f) in enumerate(zip(hours, frps, strict=True))], "det long, ms double, frp double")
    got = {r["det"]: r["bucket"] for r in windows.peaks(df, F.lit(0.0), 24).collect()}
    assert got == {1: 0, 3: 14, 5: 23}  # the last bucket holds both -1 h and the end, the stronger wins


def test_rank_value(spark):
    rng = random.Random(2)
    values = [float(rng.randrange(100)) for _ in range(537)]
    got = windows.value_at_rank(spark.createDataFrame([(v,) for v in values], "frp double"), "frp", 0.95).first()
    assert got["value"] == sorted(values)[int(0.95 * 537)] and got["n"] == 537


def test_tiles(spark):
    got = grid_etl.tiles(spark, 0.2, -0.3, 1.1, 0.4, 0.5)
    assert got.count() == 3 * 2
    kids = grid_etl.split_tiles(got)
    assert kids.count() == 24 and kids.agg(F.sum((F.col("e") - F.col("w")) * (F.col("n") - F.col("s")))).first()[0] == pytest.approx(6 * 0.25)


def test_preferred_keeps_pieces(spark):
    rows = [("k", 1, "2024-01-02T00:00:00Z", "1", "LineString", "[1]", None), ("k", 2, "2024-01-02T00:00:00Z", "1", "LineString", "[22]", "n"), ("k", 3, "Jan  1 2024 1:00PM", "9", "LineString", "[333]", "n"), ("m", 4, None, "x", "Point", "[4]", None)]
    df = spark.createDataFrame(rows, "key string, seq long, osm_timestamp string, osm_version string, shape string, geometry string, name string")
    for c in ("ref", "operator", "voltage", "frequency", "cables", "wires"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = {r["key"]: r for r in grid_etl.preferred(df, ("seq",)).collect()}
    assert (got["k"]["seq"], got["k"]["copies"], got["k"]["pieces"]) == (2, 3, 2) and got["m"]["pieces"] == 1


def test_lattice_size():
    assert series.lattice_size(28.6, 37.0, 30.4, 38.8, 7) == (14, 14)
    rows, cols = series.lattice_size(26.0, 36.0, 45.0, 42.0, 6)
    assert rows * cols <= 220 and rows >= 3
