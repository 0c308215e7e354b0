"""Clipping, interior points, rings, hulls and validity of plain coordinate arrays.

Points are arrays of lon and lat. A polygon is a list of rings, the first outside and the others holes; inside is where a
ray crosses an odd number of edges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfold.functions.geo import destination

# types as objects: a text of a type needs a session, and this module is imported before there is one
POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))

Rings = Sequence[Sequence[tuple[float, float]]]


def edges(rings: Rings) -> Column:
    """The edges of fixed rings as an array of (x1, y1, x2, y2)."""
    out = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (x1, y1) != (x2, y2):
                out.append(F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)]))
    return F.array(*out)


def ring_edges(ring: Column) -> Column:
    """The same of an array column of points."""
    at = lambda i, k: F.get(F.get(ring, i), F.lit(k))
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(at(i - 1, 0).alias("x1"), at(i - 1, 1).alias("y1"), at(i, 0).alias("x2"), at(i, 1).alias("y2")))


def inside(x: Column, y: Column, all_edges: Column) -> Column:
    crossed = F.filter(all_edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def clip_segments(segs: DataFrame, rings: Rings) -> DataFrame:
    """``segs`` (a_lon, a_lat, b_lon, b_lat) cut to a polygon: a row for each piece inside, with its number, and whether it was cut."""
    ax, ay, dx, dy = F.col("a_lon"), F.col("a_lat"), F.col("b_lon") - F.col("a_lon"), F.col("b_lat") - F.col("a_lat")

    def meets(e: Column) -> Column:
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        den = dx * ey - dy * ex
        t, u = ((e["x1"] - ax) * ey - (e["y1"] - ay) * ex) / den, ((e["x1"] - ax) * dy - (e["y1"] - ay) * dx) / den
        return F.when((den != 0) & t.between(0, 1) & u.between(0, 1), t)

    rows = segs.withColumn("_edges", edges(rings))
    rows = rows.withColumn("_cuts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform("_edges", meets))))))
    between = F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: F.struct(F.get("_cuts", i - 1).alias("t0"), F.get("_cuts", i).alias("t1")))
    # edges are a column here, as the middle of each stretch is tested against all of them
    rows = rows.withColumn("_in", F.filter(between, lambda s: (s["t1"] - s["t0"] > 1e-12) & inside(ax + dx * (s["t0"] + s["t1"]) / 2, ay + dy * (s["t0"] + s["t1"]) / 2, F.col("_edges"))))
    empty = F.array().cast("array<struct<t0:double,t1:double>>")

    def join(a: Column, s: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["t0"].alias("t0"), s["t1"].alias("t1"))))
        return F.when((F.size(a) > 0) & (last["t1"] == s["t0"]), longer).otherwise(F.concat(a, F.array(s)))

    rows = rows.withColumn("_pieces", F.aggregate("_in", empty, join))
    rest = [c for c in segs.columns if c not in ("a_lon", "a_lat", "b_lon", "b_lat")]
    out = rows.select(*rest, "a_lon", "a_lat", "b_lon", "b_lat", F.posexplode("_pieces").alias("piece", "_p"))
    at = lambda t, x: F.col(f"a_{x}") + (F.col(f"b_{x}") - F.col(f"a_{x}")) * F.col(f"_p.{t}")
    clipped = ~((F.col("_p.t0") == 0) & (F.col("_p.t1") == 1))
    return out.select(*rest, "piece", at("t0", "lon").alias("a_lon"), at("t0", "lat").alias("a_lat"), at("t1", "lon").alias("b_lon"), at("t1", "lat").alias("b_lat"), clipped.alias("clipped"))


def interior_point(ring: Column) -> tuple[Column, Column]:
    """(lon, lat) inside a closed ring (first point repeated): the middle of the widest stretch on the line half way up.

    The line is moved a little, so that it meets no vertex that lies exactly half way.
    """
    ys = F.transform(ring, lambda p: F.get(p, F.lit(1)))
    y = F.array_min(ys) + (F.array_max(ys) - F.array_min(ys)) * 0.5000123
    crossing = F.filter(ring_edges(ring), lambda e: (e["y1"] > y) != (e["y2"] > y))
    xs = F.array_sort(F.transform(crossing, lambda e: e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(xs) / 2).cast("int"))), lambda i: F.struct((F.get(xs, 2 * i - 1) - F.get(xs, 2 * i - 2)).alias("w"), ((F.get(xs, 2 * i - 1) + F.get(xs, 2 * i - 2)) / 2).alias("x")))
    return F.array_max(spans)["x"], y


def closed_way(points: Column) -> Column:
    """A way whose ends meet, as a ring; null for open ones and those of fewer than four points."""
    return F.when((F.size(points) >= 4) & (F.get(points, F.lit(0)) == F.element_at(points, -1)), points)


@F.pandas_udf(T.ArrayType(POINTS))
def assemble(ways: pd.Series) -> pd.Series:
    """Rings that the ways (arrays of points) of one relation form end to end; ways that close nothing are left out."""

    def rings(parts) -> list:
        rest = [[tuple(map(float, p)) for p in w] for w in (parts if parts is not None else []) if w is not None and len(w) > 1]
        out = []
        while rest:
            chain = rest.pop(0)
            grown = True
            while chain[0] != chain[-1] and grown:
                grown = False
                for k, w in enumerate(rest):
                    if chain[-1] in (w[0], w[-1]):
                        chain = chain + (w if w[0] == chain[-1] else w[::-1])[1:]
                        rest.pop(k)
                        grown = True
                        break
            if chain[0] == chain[-1] and len(chain) >= 4:
                out.append([list(p) for p in chain])
        return out

    return ways.map(rings)


@F.pandas_udf(POINTS)
def hull(points: pd.Series) -> pd.Series:
    """The convex hull of points (arrays of lon and lat), counter-clockwise from the leftmost; fewer than three stay as they are."""

    def one(ps) -> list:
        pts = sorted({tuple(map(float, p)) for p in ps if p is not None and np.isfinite(p).all()})
        if len(pts) < 3:
            return [list(p) for p in pts]

        def half(order):
            side: list = []
            for p in order:
                while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                    side.pop()
                side.append(p)
            return side[:-1]

        return [list(p) for p in half(pts) + half(pts[::-1])]

    return points.map(one)


@F.pandas_udf(T.BooleanType())
def simple_ring(points: pd.Series) -> pd.Series:
    """Does no edge of the ring cross another one."""

    def one(ps) -> bool:
        p = np.array([list(x) for x in ps], float)
        if len(p) < 4:
            return False
        a, b = p[:-1], p[1:]
        side = lambda o, q, r: (q[..., 0] - o[..., 0]) * (r[..., 1] - o[..., 1]) - (q[..., 1] - o[..., 1]) * (r[..., 0] - o[..., 0])
        for i in range(len(a) - 2):
            # the edge beside it shares an end, and so does the last one with the first
            c, d = a[i + 2 : len(a) - (i == 0)], b[i + 2 : len(a) - (i == 0)]
            one_side = side(a[i], b[i], c) * side(a[i], b[i], d) <= 0
            other = side(c, d, a[i][None]) * side(c, d, b[i][None]) <= 0
            box = (np.maximum(a[i], b[i]) >= np.minimum(c, d)).all(-1) & (np.minimum(a[i], b[i]) <= np.maximum(c, d)).all(-1)
            if (one_side & other & box).any():
                return False
        return True

    return points.map(one)


def valid(shape: Column, points: Column) -> Column:
    """Validity of a point, a line or a ring given as an array of points: finite numbers, length, closure, no crossing."""
    finite = F.forall(points, lambda p: (F.size(p) >= 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    line = (F.size(points) >= 2) & (F.size(F.array_distinct(points)) >= 2)
    ring = F.when(closed_way(points).isNotNull() & finite, simple_ring(F.when(finite, points).otherwise(F.array().cast("array<array<double>>")))).otherwise(False)
    ok = F.when(shape == "Point", F.size(points) == 1).when(shape == "LineString", line).when(shape == "Polygon", ring).otherwise(False)
    return F.coalesce(finite & ok, F.lit(False))


def corridor_polygon(lat: Column, lon: Column, direction: Column, km: Column, half: float = 22.0, steps: int = 10) -> Column:
    """The sector of a corridor as a closed array of (lon, lat): the centre, an arc of ``steps`` parts, and the centre again."""

    def arc(i: Column) -> Column:
        to = destination(lat, lon, direction - half + 2 * half * i / steps, km)
        return F.array(to[1], to[0])

    centre = F.array(F.array(lon, lat))
    return F.concat(centre, F.transform(F.sequence(F.lit(0), F.lit(steps)), arc), centre)


def footprint(lat: Column, lon: Column, scan_km: Column, track_km: Column) -> Column:
    """(west, south, east, north) of a pixel, half a thousandth of a degree at least to each side."""
    dy = F.greatest(F.lit(0.0005), F.coalesce(track_km, F.lit(0.375)) / 2 / 110.574)
    dx = F.greatest(F.lit(0.0005), F.coalesce(scan_km, F.lit(0.375)) / 2 / (111.32 * F.cos(F.radians(lat))))
    return F.struct((lon - dx).alias("west"), (lat - dy).alias("south"), (lon + dx).alias("east"), (lat + dy).alias("north"))
