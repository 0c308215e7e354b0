"""Clusters as a state, refined tiles and counted reads against plain versions."""

import math
import random

import pytest

from emberfold.operators import clusters, quadtree
from emberfold.sources import batches
from emberfold.streaming.clusters import ClusterState, clusters_of_arrivals

H = 3_600_000.0


def some_dets(spark, n=160, seed=1):
    rng = random.Random(seed)
    rows = [(i, 37 + rng.uniform(0, 0.3), 29 + rng.uniform(0, 0.3), rng.uniform(0, 60) * H) for i in rng.sample(range(1000), n)]
    return rows + [(2000, None, 29.0, 0.0), (2001, 37.0, 29.0, None), (2002, 37.1, 29.1, 5 * H), (2003, 37.1, 29.1, 5 * H)]


SCHEMA = "det long, lat double, lon double, ms double"


@pytest.mark.parametrize("parts", [1, 4])
def test_clusters_grow_and_merge(spark, tmp_path, parts):
    rows = some_dets(spark)
    random.Random(2).shuffle(rows)
    state = ClusterState(str(tmp_path / "c"))
    got = clusters_of_arrivals([spark.createDataFrame(rows[k::parts], SCHEMA) for k in range(parts)], str(tmp_path / "s"), state)
    want = clusters.cluster(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted((r["det"], r["cluster"]) for r in want.collect())
    assert len({r["cluster"] for r in want.collect()}) < len(rows) - 10


def test_state_is_given_back_and_batches_rerun(spark, tmp_path):
    rows = sorted((r for r in some_dets(spark, 300) if r[1] is not None and r[3] is not None), key=lambda r: r[3])
    state = ClusterState(str(tmp_path / "c"), late=4.0)
    sizes = []
    for k in range(5):
        part = spark.createDataFrame(rows[k * 60 : (k + 1) * 60], SCHEMA)
        state.add(part, k)
        before = sorted(map(tuple, state.clusters(part).collect()))
        state.add(part, k)  # as after a failure
        assert sorted(map(tuple, state.clusters(part).collect())) == before
        sizes.append(spark.read.parquet(str(tmp_path / f"c/active/version={k}")).count())
    assert sizes[-1] < 120
    # in order of time, nothing that is given back could have been reached
    assert before == sorted((r["det"], r["cluster"]) for r in clusters.cluster(spark.createDataFrame(rows[:300], SCHEMA)).select("det", "cluster").collect())


def plain_tiles(points, step, limit, depth):
    count = lambda d, x, y: sum(math.floor(lon / (step / 2**d)) == x and math.floor(lat / (step / 2**d)) == y for lon, lat in points)
    xs, ys = [math.floor(p[0] / step) for p in points], [math.floor(p[1] / step) for p in points]
    top = {(x, y): count(0, x, y) for x in range(min(xs), max(xs) + 1) for y in range(min(ys), max(ys) + 1)}
    out = []

    def look(d, x, y, doubted):
        n = count(d, x, y)
        beside = [top.get((x + a, y + b), 0) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        doubtful = d == 0 and n == 0 and sum(b > 0 for b in beside) >= 2 and sum(beside) >= 20
        if d < depth and (n > limit or doubtful):
            for i in (0, 1):
                for j in (0, 1):
                    look(d + 1, 2 * x + i, 2 * y + j, doubtful)
        else:
            out.append((d, x, y, n, "exceeded" if n > limit else "unresolved" if doubted and n == 0 else "final"))

    for x, y in top:
        look(0, x, y, False)
    return sorted(out)


@pytest.mark.parametrize(("limit", "depth"), [(5, 3), (30, 2), (0, 1), (1000, 3), (5, 0)])
def test_refined_tiles(spark, limit, depth):
    rng = random.Random(6)
    points = [(rng.gauss(0, 2), rng.gauss(0, 2)) for _ in range(300)] + [(0.3, 0.3)] * 40
    points = [p for p in points if not (1 <= p[0] < 2 and 0 <= p[1] < 1)]
    got = quadtree.refined(spark.createDataFrame([*points, (None, 1.0)], "lon double, lat double"), 1.0, limit, depth)
    want = plain_tiles(points, 1.0, limit, depth)
    assert sorted(map(tuple, got.collect())) == want
    assert depth == 0 or any(t[4] == "unresolved" for t in want)
    assert quadtree.refined(spark.createDataFrame([], "lon double, lat double"), 1.0, limit, depth).count() == 0


def test_reads_by_id(spark):
    stored = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id long, v string")
    ids = spark.createDataFrame([(i % 20,) for i in range(60)] + [(None,)], "id long")
    got = batches.by_ids(ids, stored, "id", size=7)
    assert sorted((r["id"], r["v"], r["batch"]) for r in got.collect()) == [(i, f"v{i}", i // 7) for i in range(20)]
    with pytest.raises(batches.LostRows, match="21 ids asked for, 20 rows came, 1 ids without any"):
        batches.by_ids(ids.union(spark.createDataFrame([(77,)], "id long")), stored, "id")
    with pytest.raises(batches.LostRows):
        batches.by_ids(ids, stored.union(stored.where("id = 3")), "id")
