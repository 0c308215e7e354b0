"""Carried slots, playback and coordinates against plain versions and single reference times."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberfold.functions import coordinates
from emberfold.operators import slots, windows

H = slots.HOUR


def plain_carried(requests, frames, most=12):
    rank = {"ok": 0, "invalid": 1, "network": 2, None: 3}
    known = {}
    for layer, slot, kind in frames:
        known[layer, slot] = min(known.get((layer, slot)), kind, key=lambda k: rank[k]) if (layer, slot) in known else kind
    out = []
    for layer, slot in requests:
        kind = known.get((layer, slot))
        if kind in ("invalid", "network"):
            out.append((layer, slot, None, None, kind))
            continue
        used = next((s for s in range(slot, slot - most - 1, -1) if known.get((layer, s)) == "ok"), None)
        out.append((layer, slot, used, None if used is None else slot - used, "ok" if used == slot else "exhausted" if used is None else "carried"))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [0, 1, 12])
def test_carried_back(spark, most):
    rng = random.Random(most)
    frames = [(rng.choice("ab"), rng.randrange(-40, 120), rng.choice(["ok", "invalid", "network", None])) for _ in range(60)] + [("c", 0, "ok")]
    requests = [(rng.choice("abc"), rng.randrange(-60, 150)) for _ in range(200)] + [("c", 12), ("c", 13), ("c", 0), ("d", 5)] * 2
    got = slots.carried_back(spark.createDataFrame(requests, "layer string, slot long"), spark.createDataFrame(frames, "layer string, slot long, kind string"), most)
    assert sorted(map(str, map(tuple, got.collect()))) == plain_carried(requests, frames, most)


@pytest.fixture(scope="module")
def dets(spark):
    """Many detections stand at the very borders of slots and windows."""
    rng = random.Random(4)
    rows = [(i, "pq"[i % 2], float(rng.randrange(-60, 60) * H + rng.choice([0, 0, 1, H // 2, H - 1])), float(rng.choice([1, 5, 7, 7, 30, 31]))) for i in range(500)] + [(900, "p", None, 50.0), (901, "q", 0.0, None)]
    return spark.createDataFrame(rows, "det long, product string, ms double, frp double").cache()


def test_counts_of_each_frame(dets):
    got = {(r["frame"], r["product"]): (r["n_visible"], r["n_threshold"], r["max_frp"], r["latest_ms"]) for r in slots.playback_counts(dets, -12.0 * H, 3, 14).collect()}
    want = {}
    for f in range(14):
        end = -12 * H + f * 3 * H
        for p in "pq":
            mine = [r for r in dets.collect() if r["product"] == p and r["ms"] is not None and end - 24 * H <= r["ms"] <= end]
            if mine:
                want[f, p] = (len(mine), sum((r["frp"] or 0) >= 30 for r in mine), max((r["frp"] for r in mine if r["frp"] is not None), default=None), max(r["ms"] for r in mine))
    assert got == want
    with pytest.raises(ValueError):
        slots.playback_counts(dets, 0.0, 5, 3)


@pytest.mark.parametrize("step", [1, 2, 3, 5])
def test_peaks_of_each_frame(dets, step):
    """As the peaks of one reference time, for each."""
    got = slots.playback_peaks(dets, -7.0 * H, step, 6, by=("product",))
    for f in range(6):
        want = windows.peaks(dets, F.lit(float((-7 + f * step) * H)), by=("product",)).collect()
        assert sorted(map(tuple, want)) == sorted(tuple(r)[1:] for r in got.where(F.col("frame") == f).collect())


def plain_positions(value):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if isinstance(value, list):
        if len(value) >= 2 and number(value[0]) and number(value[1]):
            return [(float(value[0]), float(value[1]))]
        return [p for v in value for p in plain_positions(v)]
    return []


def test_positions(spark):
    shapes = [[1, 2], [1.5, -2.25, 3], [[1, 2], [3, 4]], [[[1, 2], [3, 4]], [[5, 6]]], [[[[1, 2], [3, 4]]], [[[5, 6, 7]], [[8, 9]]]], [], [[]], [1], ["1", "2"], [[1, 2], "x", None, [3, "4"], [5, 6]], [True, False], [None, [1e3, 2e-3]], {"a": [1, 2]}, 7, None]
    rows = [(i, json.dumps(s)) for i, s in enumerate(shapes)] + [(100, None), (101, ""), (102, "{no"), (103, "[1,2")]
    got = spark.createDataFrame(rows, "id long, c string").select("id", coordinates.positions(F.col("c")).alias("p"), coordinates.box(coordinates.positions(F.col("c"))).alias("b")).collect()
    for r in got:
        want = plain_positions(shapes[r["id"]]) if r["id"] < 100 else []
        assert [tuple(p) for p in r["p"]] == want
        assert (r["b"] is None) == (not want)
