"""Small steps over grid assets and impacts: parts, labels, corridors that are shown, and checks of published layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfold.functions.geo import in_region
from emberfold.functions.numbers import str_or_null

#: Sources by name fragment are matched without case.
SHOWN_CLASS = {"400": "400 kV", "154": "154 kV"}


def line_parts(lines: DataFrame) -> DataFrame:
    """A row for each part of a multi-line (asset_id, parts: array of arrays of points); parts without length go, and parts of several get a number."""
    rows = lines.select("*", F.posexplode(F.filter("parts", lambda p: F.size(F.array_distinct(p)) > 1)).alias("part", "points"))
    several = F.size(F.filter("parts", lambda p: F.size(F.array_distinct(p)) > 1)) > 1
    return rows.withColumn("asset_id", F.when(several, F.concat_ws("-", "asset_id", (F.col("part") + 1).cast("string"))).otherwise(F.col("asset_id"))).drop("parts")


def any_vertex_inside(points: Column, rings: Sequence) -> Column:
    return F.exists(points, lambda p: in_region(F.get(p, F.lit(1)), F.get(p, F.lit(0)), rings))


def asset_key(asset_id: Column, osm_id: Column, name: Column, kv: Column, operator: Column, prefix: str = "line") -> Column:
    """The asset's id, or one made of prefix and the OSM id, the name, or voltage and operator (120 characters at most)."""
    made = F.coalesce(str_or_null(osm_id), str_or_null(name), F.substring(F.to_json(F.array(kv.cast("string"), operator)), 1, 120))
    return F.coalesce(str_or_null(asset_id), F.concat(F.lit(f"{prefix}:"), made))


def detection_id(df: DataFrame) -> Column:
    """The first id that is there, or six fields joined by bars."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    made = F.concat_ws("|", *map(field, ("satellite", "sensor", "product", "detected_at", "lat", "lon")))
    given = [str_or_null(F.col(c)) for c in ("detection_id", "native_id") if c in df.columns]
    return F.coalesce(*given, made)


def asset_label(fallback: str = "unnamed") -> Column:
    return F.coalesce(*[str_or_null(F.col(c)) for c in ("name", "ref", "label")], F.lit(fallback))


def of_provider(df: DataFrame, fragment: str) -> DataFrame:
    return df.where(F.lower("provider").contains(fragment.lower()))


def shown_corridors(impacts: DataFrame, lines: DataFrame, events: int = 30, each: int = 4, least: int = 35) -> DataFrame:
    """The first lines of the riskiest events with wind: (event, asset_key, km); the numbers shown are parameters.

    Only the chosen events' lines are ranked, and an event's lines lie within thirty kilometres.
    """
    chosen = impacts.where((F.col("risk") >= least) & F.col("corridor_km").isNotNull()).orderBy(F.desc("risk"), F.asc_nulls_last("min_km"), "event").limit(events).select("event")
    rank = F.row_number().over(Window.partitionBy("event").orderBy("km", "asset_key"))
    return lines.join(F.broadcast(chosen), "event").withColumn("rank", rank).where(F.col("rank") <= each).select("event", "asset_key", "km")


def evidence_of(impacts: DataFrame, asset: str) -> DataFrame:
    """The evidence for one line: of the event with the highest risk."""
    return impacts.where((F.col("line_asset_key") == asset) & F.col("evidence_det").isNotNull()).orderBy(F.desc("risk"), "event").limit(1).select("event", "evidence_det", "evidence_km", "risk")


def evidence_of_lines(impacts: DataFrame) -> DataFrame:
    """The evidence for every line: of the event with the highest risk, the first of equals."""
    rows = impacts.where(F.col("line_asset_key").isNotNull() & F.col("evidence_det").isNotNull())
    best = rows.groupBy("line_asset_key").agg(F.max_by(F.struct("event", "evidence_det", "evidence_km", "risk"), F.struct("risk", -F.col("event"))).alias("b"))
    return best.select("line_asset_key", "b.*")


def violations(layer: DataFrame, country: str, rings: Sequence) -> DataFrame:
    """One row of counts that are all 0 for a publishable layer (asset_id, country, grid_class, kv, lat, lon, label_source)."""
    expected = F.when(F.col("kv").between(300, 550), "400").when((F.col("kv") >= 50) & (F.col("kv") < 300), "154")
    return layer.agg(
        F.count_if(F.col("asset_id").isNull() | (F.col("asset_id") == "")).alias("nameless"),
        (F.count("asset_id") - F.count_distinct("asset_id")).alias("repeated"),
        F.count_if(F.col("country") != country).alias("foreign"),
        F.count_if(~F.coalesce(F.col("grid_class") == expected, F.lit(False))).alias("misclassed"),
        F.count_if(~in_region(F.col("lat"), F.col("lon"), rings)).alias("outside"),
        F.count_if(~F.coalesce(F.col("label_source").isin("osm-name", "osm-ref", "osm-from-to", "generated-identifier"), F.lit(False))).alias("unlabelled"),
    )


def download_state(metadata: DataFrame) -> DataFrame:
    """(country, partial, failed) from diagnostics, or else from the top of old metadata."""
    return metadata.select("country", F.coalesce("diagnostics.partial", "partial").alias("partial"), F.coalesce("diagnostics.failedRequests", "failedRequests").alias("failed"))
