"""The impact table, its evidence, and what is exported of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions import risk as R
from emberfold.functions.geo import segment_nearest
from emberfold.functions.numbers import round_up
from emberfold.sources import sinks

#: The table's columns.
COLUMNS = (
    "countryCode", "countryName", "eventId", "latestDetectedAt", "lat", "lon", "hotspotCount", "maxFrp_MW", "riskScore", "riskLevel",
    "nearestGridKm", "assetId", "gridClass", "actualVoltageKv", "displayLabel", "nearestAsset", "downwindAlignment", "corridorDistanceKm", "corridorWindSpeedKmh", "corridorWindSource",
    "corridorConfidence", "affectedLines10km", "affectedSubstations10km", "triggerDetectionId", "triggerSource", "triggerSatellite", "triggerInstrument", "triggerProduct", "triggerDetectedAt", "triggerFrpMw",
    "triggerConfidence", "triggerLatitude", "triggerLongitude", "triggerDistanceKm", "nearestLineLatitude", "nearestLineLongitude", "eventCenterLatitude", "eventCenterLongitude", "evidenceCount", "selectionRule",
)
EVIDENCE = COLUMNS[COLUMNS.index("triggerDetectionId") :]
RULE = "nearest_raw_detection"


def with_evidence(impacts: DataFrame, detections: DataFrame, segs: DataFrame) -> DataFrame:
    """``impacts`` with the evidence of each: the detection (det, source, satellite, sensor, product, detected_at, frp, confidence,
    lat, lon) that decided, and the point of the line that is nearest to it; all null without a line."""
    seen = detections.select(F.col("det").alias("evidence_det"), *[F.col(c).alias(f"t_{c}") for c in ("source", "satellite", "sensor", "product", "detected_at", "frp", "confidence", "lat", "lon")])
    ends = segs.select(F.col("sid").alias("evidence_sid"), *[F.col(c).alias(f"e_{c}") for c in ("a_lat", "a_lon", "b_lat", "b_lon")])
    rows = impacts.join(seen, "evidence_det", "left").join(ends, "evidence_sid", "left")
    _, lat, lon = segment_nearest(F.col("t_lat"), F.col("t_lon"), F.col("e_a_lat"), F.col("e_a_lon"), F.col("e_b_lat"), F.col("e_b_lon"))
    told = F.col("evidence_det").isNotNull()
    of = lambda c, digits: F.when(told, round_up(c, digits))
    return rows.withColumns({
        "triggerDetectionId": F.col("evidence_det").cast("string"), "triggerSource": F.col("t_source"), "triggerSatellite": F.col("t_satellite"), "triggerInstrument": F.col("t_sensor"), "triggerProduct": F.col("t_product"),
        "triggerDetectedAt": F.col("t_detected_at"), "triggerFrpMw": of(F.coalesce("t_frp", F.lit(0.0)), 2), "triggerConfidence": F.col("t_confidence"), "triggerLatitude": of(F.col("t_lat"), 6), "triggerLongitude": of(F.col("t_lon"), 6),
        "triggerDistanceKm": of(F.col("evidence_km"), 3), "nearestLineLatitude": of(lat, 6), "nearestLineLongitude": of(lon, 6), "eventCenterLatitude": of(F.col("lat"), 6), "eventCenterLongitude": of(F.col("lon"), 6),
        "evidenceCount": F.when(told, F.col("n")), "selectionRule": F.when(told, RULE),
    })


def impact_table(impacts: DataFrame, assets: DataFrame, country: str, country_name: str) -> DataFrame:
    """The table's COLUMNS of the impacts of one country; ``assets`` has (asset_key, kv, label) of lines."""
    rows = impacts.where(F.col("country") == country).join(assets.withColumnRenamed("asset_key", "line_asset_key"), "line_asset_key", "left")
    line, blown = F.col("line_asset_key").isNotNull(), F.col("downwind").isNotNull()
    own: dict[str, Column] = {
        "countryCode": F.lit(country), "countryName": F.lit(country_name), "eventId": F.col("event"), "latestDetectedAt": F.col("latest"), "hotspotCount": F.col("n"), "maxFrp_MW": round_up(F.col("max_frp"), 2),
        "riskScore": F.col("risk"), "riskLevel": F.col("risk_band"), "nearestGridKm": F.when(line, round_up(F.col("line_km"), 3)), "assetId": F.col("line_asset_key"), "gridClass": F.when(line, F.col("line_grid_class")),
        "actualVoltageKv": F.when(line, F.col("kv")), "displayLabel": F.when(line, F.col("label")), "nearestAsset": F.when(line, "line"), "downwindAlignment": F.when(F.col("aligned"), "yes").otherwise("no"),
        "corridorDistanceKm": F.col("corridor_km"), "corridorWindSpeedKmh": F.when(blown, F.coalesce("speed", F.lit(R.FALLBACK_WIND))), "corridorWindSource": F.when(blown & F.col("speed").isNull(), "fallback").otherwise("model"),
        "corridorConfidence": F.when(blown & F.col("speed").isNull(), "low").otherwise("normal"), "affectedLines10km": F.col("n_lines"), "affectedSubstations10km": F.col("n_subs"),
    }
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in COLUMNS])


def features(events: DataFrame, samples: DataFrame, impacts: DataFrame) -> DataFrame:
    """(kind, feature): a point of each event (event, lat, lon, n, max_frp, sum_frp, latest, earliest, country), a point of each
    model sample with a finite value, and the segment of each impact's nearest line (a_lon, a_lat, b_lon, b_lat)."""
    fire = sinks.point_features(events.select("lat", "lon", F.col("country").alias("countryCode"), F.col("event").alias("eventId"), F.col("n").alias("hotspotCount"), F.col("max_frp").alias("maxFrp"), F.col("sum_frp").alias("sumFrp"), F.col("latest").alias("latestDetectedAt"), F.col("earliest").alias("earliestDetectedAt")), "FIRMS_fire_event_cluster", ("countryCode", "eventId", "hotspotCount", "maxFrp", "sumFrp", "latestDetectedAt", "earliestDetectedAt"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    names = ("countryCode", "variable", "value", "unit", "validAt", "source", "resolutionKm")
    model = sinks.point_features(samples.where(finite), "model_sample", names)
    risky = impacts.where("line_asset_key is not null").select("a_lon", "a_lat", "b_lon", "b_lat", F.col("line_asset_key").alias("assetId"), F.col("line_grid_class").alias("gridClass"), F.col("event").alias("eventId"), F.col("risk").alias("riskScore"), F.col("risk_band").alias("riskLevel"), *EVIDENCE)
    lines = sinks.line_features(risky, "risky_line_segment", ("assetId", "gridClass", "eventId", "riskScore", "riskLevel", *EVIDENCE))
    return fire.unionByName(model).unionByName(lines)


def provenance(app: str, version: str, country: str, country_name: str, exported: Column, selected: Column, timezone: str, domain: tuple[float, float, float, float]) -> Column:
    """What an export says of itself."""
    w, s, e, n = domain
    words = {"application": app, "version": version, "countryCode": country, "countryName": country_name, "timezone": timezone, "gridAttribution": "© OpenStreetMap contributors / ODbL 1.0", "warning": "screening aids, no safety distances, perimeters or outage probabilities"}
    return F.struct(*[F.lit(v).alias(k) for k, v in words.items()], exported.alias("exportedAt"), selected.alias("selectedTime"), F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("wsen", (w, s, e, n), strict=True)]).alias("domain"))


def snapshot(parts: dict[str, DataFrame], meta: Column) -> DataFrame:
    """(part, line): the provenance first, and every row of each named table as JSON, in lines that are written side by side."""
    out = next(iter(parts.values())).sparkSession.range(1).select(F.lit("metadata").alias("part"), F.to_json(meta).alias("line"))
    for name, df in parts.items():
        out = out.unionByName(df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("line")))
    return out
