"""Distances, bearings and point-in-polygon tests on a sphere of 6371 km."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres of a degree of longitude at the equator, and of latitude, in the flat approximation near a point.
KM_LON, KM_LAT = 111.320, 110.574


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    dl, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    y = F.sin(dl) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest difference of two directions, 0 to 180."""
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """(lat, lon) reached from a point along a bearing."""
    d, br, la = km / EARTH_KM, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(br))
    east = F.atan2(F.sin(br) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(to))
    return F.degrees(to), lon + F.degrees(east)


def km_per_lon(lat: Column) -> Column:
    """Kilometres of a degree of longitude at a latitude, in the flat approximation."""
    return KM_LON * F.cos(F.radians(lat))


def segment_nearest(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> tuple[Column, Column, Column]:
    """(km, lat, lon) of the point of a segment that is nearest to a point, in the flat approximation around that point."""
    kx = km_per_lon(lat)
    ax, ay, bx, by = (a_lon - lon) * kx, (a_lat - lat) * KM_LAT, (b_lon - lon) * kx, (b_lat - lat) * KM_LAT
    dx, dy = bx - ax, by - ay
    den = dx * dx + dy * dy
    t = F.when(den > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / den))).otherwise(0.0)
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y), lat + y / KM_LAT, lon + x / kx


def in_ring(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Is a point inside a ring of (lon, lat): an odd number of edges crossed, edges half open in latitude."""
    crossed = F.lit(0)
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if yi != yj:
            hit = (F.lit(yi) > lat) != (F.lit(yj) > lat)
            crossed = crossed + (hit & (lon < (xj - xi) * (lat - yi) / (yj - yi) + xi)).cast("int")
    return crossed % 2 == 1


def in_polygon(lat: Column, lon: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Inside the first ring and outside the holes that follow."""
    out = in_ring(lat, lon, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(lat, lon, hole)
    return out


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def bounds(rings: Sequence[Sequence[tuple[float, float]]]) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a polygon's rings."""
    lons, lats = zip(*[p for r in rings for p in r], strict=True)
    return min(lons), min(lats), max(lons), max(lats)


def in_region(lat: Column, lon: Column, rings: Sequence[Sequence[tuple[float, float]]] | None) -> Column:
    """Inside the bounds, and inside the polygon, which is looked at second; true without a polygon."""
    if not rings:
        return lat.isNotNull() & lon.isNotNull()
    return F.coalesce(F.when(in_box(lat, lon, *bounds(rings)), in_polygon(lat, lon, rings)), F.lit(False))
