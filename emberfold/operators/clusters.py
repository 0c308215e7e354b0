"""Clusters of detections in space and time by single linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.geo import haversine_km
from emberfold.functions.numbers import confidence_weight
from emberfold.operators.graph import components, components_nearby
from emberfold.operators.spatial import around, cells, place_cells
from emberfold.runtime import settle, wide

#: Links between cells up to which one task merges them.
ALONE = 200_000
#: Pairs of members of two cells that are looked at as they are, and how often busier cells are cut.
PAIRS, DEPTH = 4_096, 3
#: Members above which a cell is busy.
BUSY = 64
#: Cells of a block: east, north, in time.
BLOCK = (16, 16, 8)


def close_pairs(dets: DataFrame, km: float = 5.0, hours: float = 6.0) -> DataFrame:
    """(u, v, km) with u < v of detections (det, lat, lon, ms) at most ``km`` and ``hours`` apart.

    Cells are ``km`` high and as wide as the radius needs at each latitude, so that no pair is missed; time steps of
    ``hours`` keep dense places apart.
    """
    size, step = km / 110.574, hours * 3_600_000
    left = around(dets.select("det", "lat", "lon", "ms"), km, size)
    left = left.withColumn("slot", F.explode(F.sequence(F.floor(F.col("ms") / step) - 1, F.floor(F.col("ms") / step) + 1)))
    right = place_cells(dets, size).select("cx", "cy", F.floor(F.col("ms") / step).alias("slot"), F.col("det").alias("v"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), F.col("ms").alias("v_ms"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon"))
    both = wide(left).join(right, ["cx", "cy", "slot"]).where((F.col("det") < F.col("v")) & (F.abs(F.col("ms") - F.col("v_ms")) <= step))
    return both.select(F.col("det").alias("u"), "v", d.alias("km")).where(F.col("km") <= km)


def _groups(places: DataFrame, *keys: str) -> DataFrame:
    """A row for each group of ``places``: how many it has, its box, and its outermost places in each direction and in time."""
    place = F.struct("lat", "lon", "ms")
    ways = [F.col("lat"), F.col("lon"), F.col("lat") + F.col("lon"), F.col("lat") - F.col("lon"), F.col("ms")]
    ends = F.array_distinct(F.array(*[f(place, w) for w in ways for f in (F.min_by, F.max_by)]))
    box = [f(c).alias(f"{name}_{c}") for c in ("lat", "lon", "ms") for name, f in (("lo", F.min), ("hi", F.max))]
    return places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *box, ends.alias("ends"))


def _side(df: DataFrame, side: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in keep])


def _reach(km: float, step: float) -> Column:
    """Whether boxes a and b are so near that members can be linked; degrees count a little less than they are long."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"lo_{c}_a") - F.col(f"hi_{c}_b"), F.col(f"lo_{c}_b") - F.col(f"hi_{c}_a"))
    far = F.greatest(*[F.abs(f"{end}_lat_{side}") for end in ("lo", "hi") for side in "ab"])
    dy, dx = gap("lat") * 110.5, gap("lon") * 110.5 * F.cos(F.radians(far))
    return (gap("ms") <= step) & (dy * dy + dx * dx <= km * km)


def _cells_around(df: DataFrame, km: float, size: float) -> DataFrame:
    """``df`` with its cell (cx, cy, slot) replaced by each cell that its members can be linked with, the cell itself among them."""
    south, north = F.col("cy") * size, (F.col("cy") + 1) * size
    up = km / 110.5
    aside = km / (111.1 * F.greatest(F.lit(0.05), F.cos(F.radians(F.greatest(F.abs(south), F.abs(north)) + up))))
    boxed = df.withColumns({"w": F.col("cx") * size - aside, "e": (F.col("cx") + 1) * size + aside, "s": south - up, "n_": north + up, "own": F.col("slot")})
    out = cells(boxed.drop("cx", "cy"), F.col("w"), F.col("s"), F.col("e"), F.col("n_"), size)
    return out.withColumn("slot", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1))).drop("w", "e", "s", "n_", "own")


def busy_links(placed: DataFrame, busy: DataFrame, km: float, hours: float, size: float, among: DataFrame | None = None) -> DataFrame:
    """(u, v): the pairs of a ``busy`` cell (rep, cx, cy, slot) and another one, by their ``rep``, of which any members
    (rep, cx, cy, slot, lat, lon, ms) of ``placed`` are linked.

    One link of two cells is enough. Outermost members show it for most pairs of busy cells; of other pairs, up to PAIRS
    pairs of members are looked at. Beyond that both cells are cut into 64 parts, DEPTH times at most, and what is compared
    are parts whose boxes are near enough, so that two busy cells meet along their border alone. ``among`` (low, high) are the
    pairs that are asked for, by their smaller and larger ``rep``; without it all are.
    """
    step, cell, fine = hours * 3_600_000, ["cx", "cy", "slot"], 4**DEPTH
    linked = lambda x, y: (F.abs(x["ms"] - y["ms"]) <= step) & (haversine_km(x["lat"], x["lon"], y["lat"], y["lon"]) <= km)
    within = lambda c, unit, whole: F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((F.col(c) / unit - F.col(whole)) * fine)))
    places = placed.select("rep", *cell, "lat", "lon", "ms", within("lon", size, "cx").alias("x"), within("lat", size, "cy").alias("y"), within("ms", step, "slot").alias("t")).distinct()

    def part(depth: int) -> Column:
        """The part of its cell that a place is in after so many cuts."""
        return F.concat_ws("/", *[F.floor(F.col(c) / 4 ** (DEPTH - depth)).cast("string") for c in "xyt"]) if depth else F.lit("")

    def judged(pairs: DataFrame) -> DataFrame:
        """Pairs of groups within reach: whether outermost members are linked, and whether there are others to look at."""
        met = F.exists("ends_a", lambda p: F.exists("ends_b", lambda q: linked(p, q)))
        more = (F.col("n_a") > F.size("ends_a")) | (F.col("n_b") > F.size("ends_b"))
        return settle(pairs.where(_reach(km, step)).select("u", "v", "part_a", "part_b", "n_a", "n_b", met.alias("met"), more.alias("more")))

    near = _cells_around(busy, km, size).select(*cell).distinct()
    groups = settle(_groups(places.join(near, cell, "left_semi"), "rep", *cell))
    hot = busy.select("rep", F.lit(True).alias("hot"))
    groups = groups.join(hot, "rep", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    left, right = _cells_around(groups.where("hot"), km, size), groups
    both = wide(_side(left, "a", *cell)).join(_side(right, "b", *cell), cell).where("rep_a < rep_b or (rep_a <> rep_b and not hot_b)")
    if among is not None:
        both = both.join(among, (F.least("rep_a", "rep_b") == F.col("low")) & (F.greatest("rep_a", "rep_b") == F.col("high")), "left_semi")
    seen = judged(both.select("*", F.col("rep_a").alias("u"), F.col("rep_b").alias("v"), F.lit("").alias("part_a"), F.lit("").alias("part_b")))
    links, left = seen.where("met").select("u", "v"), seen.where("not met and more")
    for depth in range(DEPTH + 1):
        if not left.head(1):
            break
        few = left if depth == DEPTH else left.where(F.col("n_a") * F.col("n_b") <= PAIRS)
        members = places.select("rep", part(depth).alias("part"), F.struct("lat", "lon", "ms").alias("p"))
        pairs = few.select("u", "v", "part_a", "part_b").join(_side(members, "a").withColumnRenamed("rep_a", "u"), ["u", "part_a"])
        pairs = pairs.join(_side(members, "b").withColumnRenamed("rep_b", "v"), ["v", "part_b"])
        links = links.union(pairs.where(linked(F.col("p_a"), F.col("p_b"))).select("u", "v").distinct())
        if depth == DEPTH:
            break
        # the parts of what is left, less the pairs of cells of which parts are linked already
        parts = _groups(places.withColumns({"whole": part(depth), "part": part(depth + 1)}), "rep", "whole", "part")
        large = left.where(F.col("n_a") * F.col("n_b") > PAIRS).select("u", "v", F.col("part_a").alias("whole_a"), F.col("part_b").alias("whole_b"))
        large = large.join(_side(parts, "a").withColumnRenamed("rep_a", "u"), ["u", "whole_a"]).join(_side(parts, "b").withColumnRenamed("rep_b", "v"), ["v", "whole_b"])
        seen = judged(large)
        done = seen.where("met").select("u", "v").distinct()
        links, left = links.union(done), settle(seen.where("not met and more").join(done, ["u", "v"], "left_anti"))
    return links.distinct()


def _forward(df: DataFrame) -> DataFrame:
    """``df`` (slot) with a row for its slot and the next: the earlier one of two slots looks for the later one."""
    return df.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))


def _rep_links(groups: DataFrame, km: float, hours: float, size: float) -> DataFrame:
    """(u, v, block): the pairs of cells whose first members (rep, lat, lon, ms) are linked; those of one block are neighbours."""
    step, cell = hours * 3_600_000, ["cx", "cy", "slot"]
    left = _forward(around(groups.select("rep", "lat", "lon", "ms", "slot", F.col("slot").alias("own")), km, size))
    right = groups.select(*cell, *[F.col(c).alias(f"v_{c}") for c in ("rep", "lat", "lon", "ms")])
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon")) <= km
    both = wide(left).join(right, cell).where(((F.col("slot") > F.col("own")) | (F.col("rep") < F.col("v_rep"))) & (F.abs(F.col("ms") - F.col("v_ms")) <= step) & near)
    block = F.xxhash64(*[F.floor(F.col(c) / n) for c, n in zip(cell, BLOCK, strict=True)])
    return both.select(F.col("rep").alias("u"), F.col("v_rep").alias("v"), block.alias("block"))


def _apart(groups: DataFrame, km: float, size: float) -> DataFrame:
    """(low, high, busy): the pairs of cells of ``groups`` (rep, cx, cy, slot, n, label) that differ in label, may be linked, and have more than one pair of members.

    Of two labels one at least is not the most frequent one, so that only cells of the others look around.
    """
    cell = ["cx", "cy", "slot"]
    slim = groups.select("rep", "label", "n", *cell)
    most = groups.groupBy("label").agg(F.count(F.lit(1)).alias("cells")).agg(F.max_by("label", "cells")).first()[0]
    left = _cells_around(slim.where(F.col("label") != F.lit(most)), km, size)
    right = slim.select(*cell, *[F.col(c).alias(f"v_{c}") for c in ("rep", "label", "n")])
    both = wide(left).join(right, cell).where("label <> v_label and n * v_n > 1")
    return both.select(F.least("rep", "v_rep").alias("low"), F.greatest("rep", "v_rep").alias("high"), (F.greatest("n", "v_n") > BUSY).alias("busy")).distinct()


def _few_links(placed: DataFrame, pairs: DataFrame, km: float, hours: float) -> DataFrame:
    """(u, v): those of ``pairs`` (low, high) of cells of which any members are linked, by looking at all members."""
    side = lambda rep, s: placed.select(F.col("rep").alias(rep), *[F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "ms")])
    both = wide(wide(pairs.select("low", "high")).join(side("low", "a"), "low")).join(side("high", "b"), "high")
    near = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= km
    return both.where((F.abs(F.col("ms_a") - F.col("ms_b")) <= hours * 3_600_000) & near).select(F.col("low").alias("u"), F.col("high").alias("v")).distinct()


def cluster(dets: DataFrame, km: float = 5.0, hours: float = 6.0) -> DataFrame:
    """``dets`` with ``cluster``, the smallest det that links reach.

    Whatever shares a cell whose diagonal is below ``km``, and a step of ``hours``, is linked. Its smallest det stands for
    it, so that a site with many detections makes no pairs within itself. Cells whose smallest dets are linked are joined first;
    other members are compared only of cells that are still apart, for one link of two cells.
    """
    size, step = km / 158.0, hours * 3_600_000
    placed = place_cells(dets.where("ms is not null and lat is not null and lon is not null").select("det", "lat", "lon", "ms"), size).withColumn("slot", F.floor(F.col("ms") / step))
    cell = ["cx", "cy", "slot"]
    first = F.min_by(F.struct("lat", "lon", "ms"), "det").alias("at")
    groups = settle(placed.groupBy(*cell).agg(F.min("det").alias("rep"), F.count(F.lit(1)).alias("n"), first).select("*", "at.lat", "at.lon", "at.ms").drop("at"))
    placed = settle(placed.join(groups.select(*cell, "rep"), cell))
    joined = components_nearby(_rep_links(groups, km, hours, size), "block", ALONE).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    groups = settle(groups.join(joined, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    apart = settle(_apart(groups, km, size))
    links = _few_links(placed, apart.where("not busy"), km, hours)
    hot = apart.where("busy").select("low", "high")
    if hot.head(1):
        ends = hot.select(F.explode(F.array("low", "high")).alias("rep")).distinct()
        busy = groups.where(F.col("n") > BUSY).join(ends, "rep", "left_semi").select("rep", *cell)
        links = links.union(busy_links(placed, settle(busy), km, hours, size, hot))
    label = lambda c: groups.select(F.col("rep").alias(c), F.col("label").alias(f"{c}_label"))
    found = components(links.join(label("u"), "u").join(label("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v")), alone=ALONE)
    last = groups.select("rep", "label").join(found.select(F.col("node").alias("label"), "component"), "label", "left").select("rep", F.coalesce("component", "label").alias("cluster"))
    told = placed.select("det", "rep").join(last, "rep")
    return dets.join(told.groupBy("det").agg(F.min("cluster").alias("cluster")), "det", "left").withColumn("cluster", F.coalesce("cluster", "det"))


def summarize(members: DataFrame) -> DataFrame:
    """One row of each cluster of members (cluster, det, lat, lon, ms, detected_at, frp, confidence, source, product, satellite)."""
    frp = F.coalesce("frp", F.lit(0.0))
    w = F.greatest(F.lit(1.0), F.coalesce("frp", F.lit(1.0)))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"),
        (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"),
        F.max(frp).alias("max_frp"),
        F.sum(frp).alias("sum_frp"),
        F.min("detected_at").alias("earliest"),
        F.max("detected_at").alias("latest"),
        F.max("ms").alias("latest_ms"),
        F.max(confidence_weight(F.col("confidence"))).alias("confidence"),
        # the strongest, the earliest of equals
        F.min(F.struct(-frp, F.col("ms"), F.col("det")))["det"].alias("representative"),
        listed("product").alias("products"),
        listed("satellite").alias("satellites"),
        listed("source").alias("sources"),
    )


def source_counts(members: DataFrame) -> DataFrame:
    """(cluster, n, sources) of members (cluster, source): how many each source has of a cluster, as ``source:count`` in order of source.

    Counts come first, so that a cluster's list is as long as the sources are many; a null source is written ``unknown``.
    """
    each = members.groupBy("cluster", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    named = F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda s: F.concat_ws(":", s["source"], s["n"].cast("string")))
    return each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array_join(named, ",").alias("sources"))


def event_names(summary: DataFrame, country: str) -> DataFrame:
    """``summary`` with ``name`` (country, day of the first detection, and a digest of the smallest member) in the order that
    events are shown in: the latest first, the smallest of equals."""
    day = F.date_format("earliest", "yyyyMMdd")
    name = F.concat_ws("-", F.lit(country), F.lit("fire"), day, F.substring(F.md5(F.col("cluster").cast("string").cast("binary")), 1, 10))
    return summary.withColumn("name", name).orderBy(F.desc("latest_ms"), "cluster")
