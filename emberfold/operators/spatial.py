"""Distance joins by cells of a grid.

Places are put into square cells, lines into every cell that they pass, and a point looks into the cells around it: an
equi-join on cells with the distance as a rest condition. What is found in several cells is found several times, so
that results are always aggregated by minima, which repeats do not change.

The nearest is searched in rings: all points look a little way first, in small cells, and only those that found nothing
look farther. Lines and places are tables of assets, far smaller than the points; up to a size that is checked their
cells are broadcast; beyond it ``meet`` deals out the points of hot cells, so that no cell with many points is one task's.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.geo import KM_LAT, angle_diff, bearing_deg, haversine_km, km_per_lon
from emberfold.runtime import BROADCAST_ROWS, settle, wide

CELL = 0.5
#: Each ring of a search is so many times as wide as the one before.
WIDER, RINGS = 4.0, 3
#: Points of a cell above which they are dealt out in shares, where assets are too many to be broadcast.
HOT = 20_000
#: Samples that every point looks at.
LATTICE = 1_000


def cells(df: DataFrame, west: Column, south: Column, east: Column, north: Column, size: float = CELL) -> DataFrame:
    """``df`` with a row for each cell (cx, cy) that its box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))
    return df.withColumn("cx", F.explode(span(west, east))).withColumn("cy", F.explode(span(south, north)))


def place_cells(df: DataFrame, size: float = CELL) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("lon") / size).cast("int"), "cy": F.floor(F.col("lat") / size).cast("int")})


def around(df: DataFrame, km: Column | float, size: float = CELL) -> DataFrame:
    """``df`` (lat, lon) with a row for each cell within ``km``; degrees of longitude are taken at the far side, where they are shortest."""
    km = F.lit(km) if not isinstance(km, Column) else km
    dy = km / 110.5
    dx = km / (111.1 * F.greatest(F.lit(0.05), F.cos(F.radians(F.abs("lat") + dy))))
    return cells(df, F.col("lon") - dx, F.col("lat") - dy, F.col("lon") + dx, F.col("lat") + dy, size)


def segments(lines: DataFrame) -> DataFrame:
    """Segments of lines (asset_key, grid_class, part, points: array of lon, lat): two finite points in a row each."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(i.alias("at"), F.get("points", i - 1).alias("a"), F.get("points", i).alias("b")))
    rows = lines.where("size(points) > 1").select("asset_key", "grid_class", "part", F.explode(pairs).alias("s"))
    at = lambda p, i: F.get(F.col(f"s.{p}"), F.lit(i))
    out = rows.select("asset_key", "grid_class", "part", "s.at", at("a", 0).alias("a_lon"), at("a", 1).alias("a_lat"), at("b", 0).alias("b_lon"), at("b", 1).alias("b_lat"))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out.where(fine("a_lon") & fine("a_lat") & fine("b_lon") & fine("b_lat"))


def segment_cells(segs: DataFrame, size: float = CELL) -> DataFrame:
    lo, hi = lambda x: F.least(f"a_{x}", f"b_{x}"), lambda x: F.greatest(f"a_{x}", f"b_{x}")
    return cells(segs, lo("lon"), lo("lat"), hi("lon"), hi("lat"), size)


def cell_for(km: float) -> float:
    """Degrees of a cell for a radius: a third of it, so that the cells around a point hold little beyond the circle."""
    return max(0.02, km / 111.0 / 3)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key``: few input files must not mean few tasks for all pairs, and what follows groups by the key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def meet(points: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """``points`` (key) joined to ``assets`` on their cells (cx, cy).

    Up to a number of rows the assets are broadcast. Beyond it both are shuffled by cell: the points of a cell that has more
    than HOT are dealt out in shares by their key, and its assets, which are few beside them, are copied to each share.
    """
    if assets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return points.join(F.broadcast(assets), ["cx", "cy"])
    hot = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = settle(hot.select("cx", "cy", F.ceil(F.col("n") / HOT).cast("int").alias("shares")))
    # a hot cell stands for more than HOT points, so that this table is slim; it is broadcast if it is known to be small
    near = F.broadcast(hot) if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hot
    shares = F.coalesce("shares", F.lit(1))
    dealt = points.join(near, ["cx", "cy"], "left").withColumn("share", F.pmod(F.hash(key), shares)).drop("shares")
    copied = assets.join(near, ["cx", "cy"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    return wide(dealt).join(copied, ["cx", "cy", "share"]).drop("share")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, whatever is built on them.

    The optimizer writes an alias out wherever it is used, so that long formulas grow into methods too large to be compiled.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def line_hits(points: DataFrame, segs: DataFrame, km: float, size: float | None = None) -> DataFrame:
    """(det, lat, lon, sid, asset_key, grid_class, km, near_lat, near_lon, mid_lat, mid_lon) of segments within ``km``, with repeats.

    The distance is that of ``segment_nearest``, step by step.
    """
    size = size or cell_for(km)
    asked = spread(points.select("det", "lat", "lon", km_per_lon(F.col("lat")).alias("kx")), "det")
    return segment_hits(meet(around(asked, km, size), segment_cells(segs, size), "det"), km)


def segment_hits(hits: DataFrame, km: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``line_hits`` of rows that hold a point (det, lat, lon, kx) and a segment each, with the columns ``keep`` beside."""
    c = F.col
    hits = fixed(hits, ax=(c("a_lon") - c("lon")) * c("kx"), ay=(c("a_lat") - c("lat")) * KM_LAT, dx=(c("b_lon") - c("a_lon")) * c("kx"), dy=(c("b_lat") - c("a_lat")) * KM_LAT)
    hits = fixed(hits, den=c("dx") * c("dx") + c("dy") * c("dy"))
    hits = fixed(hits, t=F.when(c("den") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(c("ax") * c("dx") + c("ay") * c("dy")) / c("den")))).otherwise(0.0))
    hits = fixed(hits, x=c("ax") + c("t") * c("dx"), y=c("ay") + c("t") * c("dy"))
    hits = hits.withColumn("km", F.sqrt(c("x") * c("x") + c("y") * c("y"))).where(c("km") <= km)
    mid = [((F.col(f"a_{x}") + F.col(f"b_{x}")) / 2).alias(f"mid_{x}") for x in ("lat", "lon")]
    return hits.select(*keep, "det", "lat", "lon", "sid", "asset_key", "grid_class", "km", (c("lat") + c("y") / KM_LAT).alias("near_lat"), (c("lon") + c("x") / c("kx")).alias("near_lon"), *mid)


def point_hits(points: DataFrame, places: DataFrame, km: float, size: float | None = None) -> DataFrame:
    """(det, sub, km, sub_lat, sub_lon) of ``places`` (sub, lat, lon) within ``km``."""
    size = size or cell_for(km)
    there = place_cells(places, size).select("cx", "cy", "sub", F.col("lat").alias("sub_lat"), F.col("lon").alias("sub_lon"))
    hits = meet(around(spread(points.select("det", "lat", "lon"), "det"), km, size), there, "det")
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("sub_lat"), F.col("sub_lon"))
    return hits.select("det", "sub", d.alias("km"), "sub_lat", "sub_lon").where(F.col("km") <= km)


def in_rings(points: DataFrame, search: Callable[[DataFrame, float], DataFrame], km: float) -> DataFrame:
    """What ``search`` (points, radius) finds for each det: within the smallest of RINGS radii up to ``km`` in which it finds anything.

    A hit within a radius is nearer than anything beyond it, so that the nearest of the found ones is the nearest of all.
    """
    found, left = None, points
    for ring in range(RINGS):
        radius = km / WIDER ** (RINGS - 1 - ring)
        got = settle(search(left, radius))
        found = got if found is None else found.unionByName(got)
        if ring < RINGS - 1:
            left = settle(left.join(got.select("det"), "det", "left_anti"))
            if not left.head(1):
                break
    return found


def nearest_lines(points: DataFrame, segs: DataFrame, km: float) -> DataFrame:
    """``nearest_line`` of each det (det, lat, lon) that has one within ``km``."""
    points, segs = settle(points.select("det", "lat", "lon")), settle(segs)
    return in_rings(points, lambda left, radius: nearest_line(line_hits(left, segs, radius)), km)


def nearest_places(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """``nearest_place`` of each det (det, lat, lon) that has one within ``km``."""
    points, places = settle(points.select("det", "lat", "lon")), settle(places)
    return in_rings(points, lambda left, radius: nearest_place(point_hits(left, places, radius)), km)


def nearest_line(hits: DataFrame) -> DataFrame:
    """The nearest segment of each det; of equally near ones the first."""
    best = hits.groupBy("det").agg(F.min(F.struct("km", "sid", "asset_key", "grid_class", "near_lat", "near_lon", "mid_lat", "mid_lon")).alias("l"))
    return best.select("det", *[F.col(f"l.{c}").alias(f"line_{c}" if not c.startswith("line") else c) for c in ("km", "sid", "asset_key", "grid_class", "near_lat", "near_lon", "mid_lat", "mid_lon")])


def nearest_place(hits: DataFrame) -> DataFrame:
    best = hits.groupBy("det").agg(F.min(F.struct("km", "sub", "sub_lat", "sub_lon")).alias("s"))
    return best.select("det", F.col("s.km").alias("sub_km"), F.col("s.sub").alias("sub"), F.col("s.sub_lat").alias("sub_lat"), F.col("s.sub_lon").alias("sub_lon"))


def lines_within(hits: DataFrame, km: float) -> DataFrame:
    """(det, asset_key, km, sid): the least distance of each line within ``km`` of each det."""
    best = hits.where(F.col("km") <= km).groupBy("det", "asset_key").agg(F.min(F.struct("km", "sid")).alias("b"))
    return best.select("det", "asset_key", "b.km", "b.sid")


def _in_sector(df: DataFrame, places: dict[str, tuple[Column, Column]], half: float) -> DataFrame:
    """``df`` (lat, lon, direction, reach) with ``hit``, where one of ``places`` lies in the sector: (off, km, bearing) of the
    one that is nearest in angle."""
    lat, lon, c = F.col("lat"), F.col("lon"), F.col
    df = fixed(df, **{f"_km_{k}": haversine_km(lat, lon, *p) for k, p in places.items()}, **{f"_way_{k}": bearing_deg(lat, lon, *p) for k, p in places.items()})
    df = fixed(df, **{f"_off_{k}": angle_diff(c("direction"), c(f"_way_{k}")) for k in places})
    seen = [F.when((c(f"_km_{k}") <= c("reach")) & (c(f"_km_{k}") >= 0.05) & (c(f"_off_{k}") <= half), F.struct(c(f"_off_{k}").alias("off"), c(f"_km_{k}").alias("km"), c(f"_way_{k}").alias("bearing"))) for k in places]
    return fixed(df, hit=F.array_min(F.array_compact(F.array(*seen)))).where("hit is not null")


def sector_cells(events: DataFrame, half: float, most_km: float, size: float) -> DataFrame:
    """``events`` (lat, lon, direction, reach) with a row for each cell that the box of its sector touches.

    The box spans the event itself, both ends of the arc, and the arc's point due north, east, south or west where the
    sector has it. A tenth is added to the reach for the difference between sphere and plane.
    """
    reach = F.least(F.col("reach"), F.lit(most_km)) * 1.1 + 0.5
    ways = [F.col("direction") - half - 1, F.col("direction") + half + 1]
    ahead = [F.when(angle_diff(F.col("direction"), F.lit(float(w))) <= half + 1, 1.0).otherwise(0.0) for w in (0, 90, 180, 270)]
    north = [F.cos(F.radians(w)) for w in ways]
    east = [F.sin(F.radians(w)) for w in ways]
    dy = reach / 110.5
    dx = reach / (111.1 * F.greatest(F.lit(0.05), F.cos(F.radians(F.abs("lat") + dy))))
    zero = F.lit(0.0)
    return cells(
        events,
        F.col("lon") + dx * F.least(zero, *east, -ahead[3]), F.col("lat") + dy * F.least(zero, *north, -ahead[2]),
        F.col("lon") + dx * F.greatest(zero, *east, ahead[1]), F.col("lat") + dy * F.greatest(zero, *north, ahead[0]), size,
    )


def lines_in_sector(events: DataFrame, segs: DataFrame, half: float, most_km: float, size: float | None = None) -> DataFrame:
    """(event, asset_key, km, bearing) of lines in the sector of each event (event, lat, lon, direction, reach).

    A segment is seen by its ends and its middle, of which the one nearest in angle counts; a line is as far as its
    nearest such segment.
    """
    size = size or cell_for(most_km)
    way = F.radians("direction")
    flat = events.where("direction is not null").withColumns({"kx": km_per_lon(F.col("lat")), "ux": F.sin(way), "uy": F.cos(way)})
    asked = sector_cells(spread(flat, "event"), half, most_km, size)
    own = segs.withColumn("half_km", haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) / 2)
    # a look on the plane first, with room for the segment's length and for the sphere
    x = ((F.col("a_lon") + F.col("b_lon")) / 2 - F.col("lon")) * F.col("kx")
    y = ((F.col("a_lat") + F.col("b_lat")) / 2 - F.col("lat")) * KM_LAT
    room = F.col("half_km") * 1.1 + 1
    along, aside = x * F.col("ux") + y * F.col("uy") + room, F.abs(x * F.col("uy") - y * F.col("ux"))
    near = (along >= 0) & (along <= F.col("reach") * 1.1 + room * 2) & (aside <= along * math.tan(math.radians(half + 3)) + room) if half < 80 else F.lit(True)
    hits = meet(asked, segment_cells(own, size), "event").where(near)
    mid = [(F.col(f"a_{x}") + F.col(f"b_{x}")) / 2 for x in ("lat", "lon")]
    hits = _in_sector(hits, {"a": (F.col("a_lat"), F.col("a_lon")), "b": (F.col("b_lat"), F.col("b_lon")), "mid": (mid[0], mid[1])}, half)
    best = hits.groupBy("event", "asset_key").agg(F.min(F.struct("hit.km", "sid", "hit.bearing")).alias("b"))
    return best.select("event", "asset_key", "b.km", "b.bearing")


def places_in_sector(events: DataFrame, places: DataFrame, half: float, most_km: float, size: float | None = None) -> DataFrame:
    size = size or cell_for(most_km)
    there = place_cells(places, size).select("cx", "cy", "sub", F.col("lat").alias("sub_lat"), F.col("lon").alias("sub_lon"))
    hits = meet(sector_cells(spread(events.where("direction is not null"), "event"), half, most_km, size), there, "event")
    hits = _in_sector(hits, {"sub": (F.col("sub_lat"), F.col("sub_lon"))}, half)
    best = hits.groupBy("event", "sub").agg(F.min(F.struct("hit.km", "hit.bearing")).alias("b"))
    return best.select("event", "sub", "b.km", "b.bearing")


def nearest_sample(points: DataFrame, samples: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Each point with the nearest of ``samples`` (sample, lat, lon, ...).

    Model samples are a lattice of a few hundred places, of which every point looks at all, in one broadcast array; beyond
    LATTICE samples points look in rings up to half the earth's circumference.
    """
    s = settle(samples.select("sample", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), *columns))
    if s.limit(LATTICE + 1).count() > LATTICE:
        there = s.select(F.col("sample").alias("sub"), F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"))
        asked = settle(points.select(F.col(key).alias("det"), "lat", "lon"))
        found = None
        radius, left = 50.0, asked
        while found is None or left.head(1):
            got = settle(nearest_place(point_hits(left, there, radius)))
            found = got if found is None else found.unionByName(got)
            left = settle(left.join(got.select("det"), "det", "left_anti"))
            radius *= WIDER
            if radius > 20_100:
                break
        best = found.select(F.col("det").alias(key), F.col("sub_km").alias("sample_km"), F.col("sub").alias("sample"))
        return best.join(s.select("sample", *columns), "sample").select(key, "sample_km", "sample", *columns)
    all_ = s.agg(F.collect_list(F.struct("sample", "s_lat", "s_lon", *columns)).alias("all"))
    d = lambda x: haversine_km(F.col("lat"), F.col("lon"), x["s_lat"], x["s_lon"])
    best = F.array_min(F.transform("all", lambda x: F.struct(d(x).alias("sample_km"), x["sample"].alias("sample"), *[x[c].alias(c) for c in columns])))
    return points.select(key, "lat", "lon").crossJoin(F.broadcast(all_)).select(key, best.alias("b")).where("b is not null").select(key, "b.*")
