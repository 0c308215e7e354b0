"""The offline build of one country's grid: raw features to published layers, with a manifest that accounts for every feature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfold.functions.voltage import voltage_class
from emberfold.operators import boundary
from emberfold.operators import grid_etl as G
from emberfold.operators.geometry import interior_point
from emberfold.runtime import settle
from emberfold.sources.sinks import write_layers

#: What an asset is published with, beside its place, class and label.
CARRIED = ("osm_id", "osm_id2", "osmId", "osm_type", "name", "ref", "operator", "from", "to", "voltage", "frequency", "cables", "wires", "osm_timestamp", "provider")


class BuildError(ValueError):
    """A feature of another country, two assets of one id, or layers that are not what the manifest says."""


@dataclass
class Build:
    """``assets`` (country, layer, asset_id, ...) and ``manifest`` (counter, n)."""

    assets: DataFrame
    manifest: DataFrame


def fate(kv: Column, country: str) -> Column:
    """Why a feature is left out before its place is looked at, or ``kept``; substations of TR need no voltage."""
    is_line, is_place = F.col("power").isin(*G.LINES) & F.col("shape").isin(*G.LINE_SHAPES), (F.col("power") == "substation") & F.col("shape").isin(*G.PLACE_SHAPES)
    needs = is_line if country == "TR" else F.lit(True)
    return F.when(~(is_line | is_place), "unsupported").when(kv < 50, "below-50").when(kv > 550, "above-550").when(needs & kv.isNull(), "unclassified").otherwise("kept")


def with_country(features: DataFrame, country: str) -> DataFrame:
    """``features``, if each names ``country`` as its own or none; otherwise BuildError."""
    strangers = features.where(F.col("raw_country") != country).limit(1).count()
    if strangers:
        raise BuildError(f"features of another country than {country}")
    return features


def build(features: DataFrame, of: boundary.Area, country: str) -> Build:
    """The layers of ``country``: lines cut to the area ``of`` it, a row for each piece, and substations as points.

    ``features`` has seq (unique), valid, key, power, shape, geometry (text), kv, raw_country, osm_version and CARRIED, and
    their places: lines have a_lon, a_lat, b_lon and b_lat, points lon and lat, polygons a closed ring (points).
    In turn: invalid ones go; of those that share a key the preferred one stays (``preferred``); what is unsupported or
    of another voltage goes; what lies outside goes. A polygon becomes a point inside it, or its first corner that lies in
    the area. Every feature is in one counter of the manifest; an empty table gives empty layers and counters of 0.
    """
    raw = with_country(features, country)
    valid = raw.where(F.coalesce("valid", F.lit(False)))
    places = ("a_lon", "a_lat", "b_lon", "b_lat", "lon", "lat", "points")
    one = G.preferred(valid, ("seq", "power", "shape", "geometry", "kv", *places, *[c for c in CARRIED if c != "osm_timestamp"], "osm_timestamp"))
    one = settle(one.withColumn("fate", fate(F.col("kv"), country)))
    kept = one.where("fate = 'kept'")
    is_line = F.col("power").isin(*G.LINES)

    pieces = boundary.clip(kept.where(is_line).select("seq", "a_lon", "a_lat", "b_lon", "b_lat"), of, "seq")
    pieces = settle(pieces.withColumn("n_parts", F.count(F.lit(1)).over(Window.partitionBy("seq"))))
    # substations by the places they can be shown at, in order of preference
    x, y = interior_point(F.col("points"))
    spot = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    corners = F.transform(F.col("points"), lambda p: spot(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    polygon = F.col("shape") != "Point"
    spots = kept.where(~is_line).select("seq", polygon.alias("converted"), F.posexplode(F.when(polygon, F.concat(F.array(spot(x, y)), corners)).otherwise(F.array(spot(F.col("lon"), F.col("lat"))))).alias("at", "s"))
    shown = boundary.points_inside(spots.select("seq", "converted", "at", "s.lon", "s.lat"), of).where("inside").groupBy("seq", "converted").agg(F.min_by(spot(F.col("lon"), F.col("lat")), "at").alias("s"))
    shown = settle(shown.select("seq", "converted", "s.lon", "s.lat"))

    ends = [F.lit(None).cast("double").alias(c) for c in ("b_lon", "b_lat")]
    placed = pieces.select("seq", "piece", "n_parts", "a_lon", "a_lat", "b_lon", "b_lat").unionByName(shown.select("seq", F.lit(0).alias("piece"), F.lit(1).cast("long").alias("n_parts"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), *ends))
    text, source = G.label()
    told = kept.drop(*places).join(placed, "seq")
    kind = F.when(is_line, "line").otherwise("substation")
    number = F.when(F.col("n_parts") > 1, F.concat(F.lit("-part-"), (F.col("piece") + 1).cast("string"))).otherwise("")
    layer = F.when(is_line, voltage_class(F.col("kv"))).otherwise("substations")
    assets = told.select(
        F.lit(country).alias("country"), layer.alias("layer"), F.concat(G.asset_id(F.lit(country), kind), number).alias("asset_id"), kind.alias("asset_type"), "power", F.col("kv").alias("actual_kv"), voltage_class(F.col("kv")).alias("grid_class"),
        text.alias("display_label"), source.alias("label_source"), "seq", *CARRIED, "a_lon", "a_lat", "b_lon", "b_lat",
    )
    assets = settle(assets)
    twice = assets.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise BuildError("two assets of one id")

    count = lambda name, df: df.agg(F.lit(name).alias("counter"), F.count(F.lit(1)).alias("n"))
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    line = assets.where("asset_type = 'line'")
    lost = kept.select("seq").join(placed.select("seq").distinct(), "seq", "left_anti")
    rows = [("raw", raw), ("invalid", raw.where(~F.coalesce("valid", F.lit(False)))), ("outside", lost), ("clipped-lines", pieces.where("clipped").select("seq").distinct()), ("representative-points", shown.where("converted"))]
    rows += [("lines", line), ("substations", assets.where("asset_type = 'substation'")), ("grid-400", assets.where("layer = '400'")), ("grid-154", assets.where("layer = '154'"))]
    rows += [("named-lines", line.where(full("name"))), ("referenced-lines", line.where(full("ref"))), ("operator-lines", line.where(full("operator")))]
    rows += [(f, one.where(F.col("fate") == f)) for f in ("unsupported", "below-50", "above-550", "unclassified")]
    manifest = None
    for name, df in rows:
        manifest = count(name, df) if manifest is None else manifest.unionByName(count(name, df))
    manifest = manifest.unionByName(one.agg(F.lit("duplicates").alias("counter"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")))
    manifest = manifest.unionByName(assets.groupBy(F.concat(F.lit("source:"), F.coalesce("provider", F.lit("OpenStreetMap"))).alias("counter")).agg(F.count(F.lit(1)).alias("n")))
    return Build(assets, settle(manifest))


def publish(made: Build, path: str) -> DataFrame:
    """Write the layers (by country and layer) and the manifest below ``path``, read them back, and return the manifest if they agree."""
    spark = made.assets.sparkSession
    write_layers(made.assets, f"{path}/layers")
    made.manifest.write.mode("overwrite").json(f"{path}/manifest")
    manifest = spark.read.schema("counter string, n long").json(f"{path}/manifest")
    layers = spark.read.schema(made.assets.schema).parquet(f"{path}/layers").groupBy(F.col("layer").cast("string").alias("layer")).agg(F.count(F.lit(1)).alias("found"))
    said = manifest.select(F.when(F.col("counter") == "substations", "substations").when(F.col("counter").startswith("grid-"), F.substring("counter", 6, 9)).alias("layer"), "n").where("layer is not null")
    wrong = said.join(layers, "layer", "full").where("coalesce(n, 0) <> coalesce(found, 0)").limit(1).count()
    if wrong:
        raise BuildError("layers are not what the manifest says")
    return manifest
