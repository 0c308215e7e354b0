"""Assets near an event, whose members are many and lie close together."""

import math
import random

from emberfold.operators import risk, spatial


def test_near_events(spark):
    """As by all pairs; one member of each event and cell looks first, and the others only for what it leaves open."""
    rng = random.Random(2)
    at = [(38.0, 29.0), (38.05, 29.3), (38.3, 29.0)]
    members = [(e, e * 1000 + i, y + rng.gauss(0, 0.012), x + rng.gauss(0, 0.012)) for e, (y, x) in enumerate(at) for i in range(150)]
    places = [(i, 37.8 + rng.random() * 0.7, 28.7 + rng.random() * 0.9) for i in range(800)]
    m = spark.createDataFrame(members, "event long, det long, lat double, lon double")
    p = spark.createDataFrame(places, "sub long, lat double, lon double")
    asked = []

    def search(points, subs, far):
        asked.append((points.count(), 800 if subs is None else subs.count()))
        return spatial.point_hits(points, p if subs is None else p.join(subs, "sub", "left_semi"), far).select("det", "sub", "km")

    got = risk.near_events(m, search, "sub", 10.0)

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want = {(e, s) for e, _, y, x in members for s, b, a in places if km(y, x, b, a) <= 10}
    rows = [(r["event"], r["sub"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert asked[0][0] < 40 and asked[0][1] == 800 and asked[1][1] < 800
