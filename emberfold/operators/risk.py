"""Which lines and substations are at risk from which fire event, how much, and on what evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions import risk as R
from emberfold.functions.geo import angle_diff, bearing_deg
from emberfold.functions.numbers import confidence_weight, round_up
from emberfold.operators import spatial
from emberfold.runtime import settle


def analyze_detections(dets: DataFrame, segs: DataFrame, subs: DataFrame, km: float = 25.0) -> DataFrame:
    """Nearest assets of each det with distance and band, searched in rings up to ``km``."""
    near = dets.select("det").join(spatial.nearest_lines(dets, segs, km), "det", "left").join(spatial.nearest_places(dets, subs, km), "det", "left")
    near = near.withColumn("min_km", F.least("line_km", "sub_km"))
    return near.withColumn("band", R.impact_band(F.col("min_km")))


def near_events(members: DataFrame, search: Callable[[DataFrame, DataFrame | None, float], DataFrame], key: str, km: float) -> DataFrame:
    """(event, key): the assets within ``km`` of any of an event's members (event, det, lat, lon).

    ``search`` (points, assets that are asked for or None, radius) gives (det, key, km). A member of each event and cell looks
    first, as much farther as the cell is wide: what it finds within ``km`` is near. All members look for the rest alone, so
    that the pairs made are those of an event's area with its assets, however many members it has.
    """
    size = km / 2 / 111.0
    slack = size * 111.4 * 2**0.5 * 1.02 + 0.1
    placed = spatial.place_cells(members.select("event", "det", "lat", "lon"), size)
    first = placed.groupBy("event", "cx", "cy").agg(F.min_by(F.struct("det", "lat", "lon"), "det").alias("p"), (F.count(F.lit(1)) > 1).alias("more"))
    first = settle(first.select("event", "p.*", "more"))
    seen = search(first, None, km + slack).join(first.select("det", "event", "more"), "det")
    seen = settle(seen.groupBy("event", key).agg((F.min("km") <= km).alias("near"), F.max("more").alias("more")))
    near, open_ = seen.where("near").select("event", key), seen.where("not near and more").select("event", key)
    if open_.head(1):
        asked = members.join(open_.select("event").distinct(), "event", "left_semi").select("event", "det", "lat", "lon")
        rest = search(asked, open_.select(key).distinct(), km).where(F.col("km") <= km).join(asked.select("det", "event"), "det")
        near = near.union(rest.select("event", key).join(open_, ["event", key], "left_semi").distinct())
    return near


def evidence_order(dist: Column, confidence: Column, frp: Column, ms: Column, key: Column) -> Column:
    """Sorts first the nearest to three decimals, then the surest, strongest, newest, and the first by name."""
    return F.struct(round_up(dist, 3), -confidence_weight(confidence), -F.coalesce(frp, F.lit(0.0)), -ms, key)


def analyze_events(members: DataFrame, events: DataFrame, segs: DataFrame, subs: DataFrame, wind: DataFrame, as_of_ms: float, km: float = 25.0, near_km: float = 10.0) -> DataFrame:
    """One row of each event (event, lat, lon, max_frp, latest_ms, n) with its nearest assets, score, corridor and evidence.

    ``members`` has (event, det, lat, lon, ms, frp, confidence, key). Distances and assets come from the members, the
    nearest of which decides; wind comes from the nearest sample, and the corridor from the event's centre.
    """
    near, close = analyze_detections(members, segs, subs, km), min(near_km, km)
    own = members.select("det", "event", "ms", "frp", "confidence", "key")
    near = near.join(own, "det")
    cols = ["line_km", "line_sid", "line_asset_key", "line_grid_class", "line_mid_lat", "line_mid_lon", "sub_km", "sub", "sub_lat", "sub_lon", "min_km"]
    best = near.groupBy("event").agg(F.min_by(F.struct(*cols), F.struct(F.coalesce("min_km", F.lit(float("inf"))), F.col("ms"), F.col("det"))).alias("b")).select("event", "b.*")
    best = settle(best)

    of = lambda assets, asked, key: assets if asked is None else assets.join(asked, key, "left_semi")
    lines = near_events(members, lambda points, asked, far: spatial.line_hits(points, of(segs, asked, "asset_key"), far).select("det", "asset_key", "km"), "asset_key", close)
    places = near_events(members, lambda points, asked, far: spatial.point_hits(points, of(subs, asked, "sub"), far).select("det", "sub", "km"), "sub", close)
    counts_l = lines.groupBy("event").agg(F.sort_array(F.collect_set("asset_key")).alias("lines"))
    counts_s = places.groupBy("event").agg(F.sort_array(F.collect_set("sub")).alias("subs"))

    air = spatial.nearest_sample(events.withColumnRenamed("event", "_e"), wind, "_e", ("speed", "direction")).withColumnRenamed("_e", "event")
    blown = events.join(air, "event", "left").withColumn("downwind", F.pmod(F.col("direction") + 180, F.lit(360.0)))
    blown = blown.withColumn("corridor_km", F.when(F.col("direction").isNotNull(), R.corridor_km(F.col("max_frp"), F.col("speed"))))
    asked = blown.select("event", "lat", "lon", F.col("downwind").alias("direction"), F.col("corridor_km").alias("reach"))
    down_l = spatial.lines_in_sector(asked, segs, R.HALF_ANGLE, R.MAX_KM).groupBy("event").agg(F.sort_array(F.collect_set("asset_key")).alias("lines_down"))
    down_s = spatial.places_in_sector(asked, subs, R.HALF_ANGLE, R.MAX_KM).groupBy("event").agg(F.sort_array(F.collect_set("sub")).alias("subs_down"))

    out = blown.join(best, "event", "left")
    for extra in (counts_l, counts_s, down_l, down_s):
        out = out.join(extra, "event", "left")
    # the keys of an event's assets, as many as lie within its few kilometres
    out = out.withColumns({n: F.coalesce(F.size(c), F.lit(0)).cast("long") for n, c in (("n_lines", "lines"), ("n_subs", "subs"), ("down_lines", "lines_down"), ("down_subs", "subs_down"))})
    by_line = F.col("line_km").isNotNull() & (F.col("sub_km").isNull() | (F.col("line_km") <= F.col("sub_km")))
    out = out.withColumn("asset_kind", F.when(by_line, "line").when(F.col("sub_km").isNotNull(), "substation"))
    asset = F.when(by_line, F.when(F.col("line_grid_class") == "400", 10).otherwise(7)).when(F.col("sub_km").isNotNull(), 10).otherwise(0)
    to_lat, to_lon = F.when(by_line, F.col("line_mid_lat")).otherwise(F.col("sub_lat")), F.when(by_line, F.col("line_mid_lon")).otherwise(F.col("sub_lon"))
    off = angle_diff(F.col("downwind"), bearing_deg(F.col("lat"), F.col("lon"), to_lat, to_lon))
    any_down = (F.col("down_lines") + F.col("down_subs")) > 0
    wind_score = F.when(F.col("downwind").isNull(), 0).when(off <= 35, 8).when(off <= 60, 4).when(any_down, 3).otherwise(0)
    age = R.age_hours(F.col("latest_ms"), F.lit(float(as_of_ms)))
    score = R.risk_score(R.distance_score(F.col("min_km")), R.frp_score(F.col("max_frp")), R.age_score(age), asset, wind_score)
    out = out.withColumn("aligned", F.coalesce(F.col("downwind").isNotNull() & (off <= 35), F.lit(False)))
    out = out.withColumns({"age_hours": age, "band": R.impact_band(F.col("min_km")), "asset_score": asset, "wind_score": wind_score, "risk": score})
    out = out.withColumn("risk_band", R.risk_band(F.col("risk")))

    # evidence: the best member for the event's nearest line, among members that have it within ten kilometres
    named = best.where("line_asset_key is not null").select("event", F.col("line_asset_key").alias("asset_key"))
    # members meet their own event's line alone
    asked = members.select("event", "det", "lat", "lon", spatial.km_per_lon(F.col("lat")).alias("kx"))
    cand = spatial.segment_hits(asked.join(named.join(segs, "asset_key"), "event"), close, ("event",))
    cand = cand.groupBy("event", "det").agg(F.min(F.struct("km", "sid")).alias("b")).select("event", "det", "b.*").join(own.drop("event"), "det")
    order = evidence_order(F.col("km"), F.col("confidence"), F.col("frp"), F.col("ms"), F.col("key"))
    seen = cand.groupBy("event").agg(F.min_by(F.struct("det", "km", "sid"), order).alias("e")).select("event", F.col("e.det").alias("evidence_det"), F.col("e.km").alias("evidence_km"), F.col("e.sid").alias("evidence_sid"))
    return out.join(seen, "event", "left")


def ordered(impacts: DataFrame) -> DataFrame:
    return impacts.orderBy(F.desc("risk"), F.asc_nulls_last("min_km"), "event")


def risky_substations(impacts: DataFrame, km: float = 5.0) -> DataFrame:
    """The highest risk of each substation that is nearest to an event within ``km``."""
    best = impacts.where(F.col("sub_km") <= km).groupBy("sub").agg(F.max_by(F.struct("event", "risk", "sub_km"), F.struct("risk", -F.col("event"))).alias("b"))
    return best.select("sub", "b.event", "b.risk", "b.sub_km")


def kpis(impacts: DataFrame, least: int = 35) -> DataFrame:
    """One row: events by risk band; distinct lines and substations near any event; those downwind of an event of ``least`` or above."""
    bands = impacts.agg(*[F.count_if(F.col("risk_band") == b).alias(b) for _, b in R.RISK_BANDS])
    kinds = {"lines": F.col("lines"), "subs": F.col("subs"), "down_lines": F.when(F.col("risk") >= least, F.col("lines_down")), "down_subs": F.when(F.col("risk") >= least, F.col("subs_down"))}
    none = F.array().cast("array<string>")
    named = lambda kind, keys: F.transform(F.coalesce(keys.cast("array<string>"), none), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    keyed = [named(kind, keys) for kind, keys in kinds.items()]
    each = impacts.select(F.explode(F.concat(*keyed)).alias("k")).select("k.kind", "k.key").distinct()
    return bands.crossJoin(each.agg(*[F.count_if(F.col("kind") == n).alias(n) for n in kinds]))
