"""Normalising, validating and de-duplicating thermal detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.geo import in_region
from emberfold.functions.numbers import confidence_weight, num_or_null, str_or_null
from emberfold.functions.text import hhmm

#: The names under which feeds bring each field, the first that is present wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "frp": ("frpMw", "FRP", "frp", "brightness"),
    "frp_uncertainty": ("frpUncertaintyMw", "frp_uncertainty", "uncertainty", "FRP_UNCERTAINTY"),
    "bright_ti4": ("brightTi4K", "bright_ti4", "brightTi4"),
    "bright_ti5": ("brightTi5K", "bright_ti5", "brightTi5"),
    "scan": ("scan", "pixelWidthKm"),
    "track": ("track", "pixelHeightKm"),
}
TEXTS: dict[str, tuple[str, ...]] = {
    "satellite": ("satellite",),
    "sensor": ("sensor", "instrument"),
    "product": ("product",),
    "source": ("sourceName", "source"),
    "source_id": ("sourceId",),
    "sensor_family": ("sensorFamily",),
    "native_id": ("id", "nativeId"),
    "country": ("countryCode",),
    "day_night": ("dayNight", "daynight"),
}
#: The sensor family of each source.
FAMILIES = {"nasa-firms": "viirs-modis", "sentinel3a-slstr": "slstr", "sentinel3b-slstr": "slstr", "mtg-fci-frp": "mtg", "msg-seviri-frp": "msg"}


def _first(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that is there and not null."""
    there = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def normalize(raw: DataFrame, defaults: dict[str, str] | None = None, keep: Sequence[str] = ("seq",), brightness_first: bool = False) -> DataFrame:
    """The canonical columns of raw detections of any feed; ``defaults`` fill texts that are missing.

    ``brightness_first`` puts brightness before the plain power column, as some feeds' readers do.
    """
    defaults = defaults or {}
    names = dict(ALIASES)
    if brightness_first:
        names["frp"] = ("frpMw", "FRP", "brightness", "frp")
    nums = {k: num_or_null(_first(raw, v)) for k, v in names.items()}
    texts = {k: str_or_null(F.coalesce(_first(raw, v).cast("string"), F.lit(defaults.get(k)).cast("string"))) for k, v in TEXTS.items()}
    given = str_or_null(_first(raw, ("detectedAt",)))
    at = F.coalesce(given, F.when(_first(raw, ("acq_date",)).isNotNull(), hhmm(_first(raw, ("acq_date",)).cast("string"), _first(raw, ("acq_time",)).cast("string"))))
    detected = F.regexp_replace(at, "Z$", "").try_cast("timestamp_ntz")
    confidence = _first(raw, ("confidenceRaw", "confidence", "CONFIDENCE")).cast("string")
    out = raw.select(*keep, *[c.alias(k) for k, c in (nums | texts).items()], detected.alias("detected_at"), confidence.alias("confidence"))
    weight = F.when(F.col("confidence").isNotNull(), confidence_weight(F.col("confidence")))
    return out.withColumns({"confidence_normalized": weight, "pixel_area_km2": F.col("scan") * F.col("track")})


def valid(df: DataFrame, rings: Sequence | None = None, drop_zero: bool = False) -> DataFrame:
    """Rows with a place, a time, and a place inside the region; ``drop_zero`` also drops a coordinate of exactly 0."""
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("detected_at").isNotNull() & in_region(F.col("lat"), F.col("lon"), rings)
    return df.where(ok & (F.col("lat") != 0) & (F.col("lon") != 0)) if drop_zero else df.where(ok)


def at_least(df: DataFrame, threshold: float, unknown: bool) -> DataFrame:
    """Rows whose power reaches a threshold above 0; those of unknown power stay if ``unknown``."""
    enough = F.col("frp") >= threshold
    return df.where(F.coalesce(enough, F.lit(unknown))) if threshold > 0 else df


def identity_key() -> Column:
    """Country, product, satellite, minute and place to four decimals."""
    place = lambda c: F.coalesce((F.floor(F.col(c) * 10_000 + 0.5) / 10_000.0).cast("decimal(12,4)").cast("string"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    minute = F.coalesce(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm"), F.lit(""))
    return F.concat_ws(":", F.coalesce("country", F.lit("TR")), text("product"), text("satellite"), minute, place("lat"), place("lon"))


def dedupe_first(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of each identity: the first by seq, with the largest frp, the first confidence, and the sorted sources."""
    first = F.min_by(F.struct(*columns), "seq").alias("r")
    some = F.min_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("seq"))).alias("some_confidence")
    got = df.withColumn("key", identity_key()).groupBy("key").agg(first, F.max("frp").alias("max_frp"), some, F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("copies"))
    rest = [F.col(f"r.{c}") for c in columns if c not in ("frp", "confidence")]
    return got.select("key", *rest, F.coalesce("max_frp", "r.frp").alias("frp"), F.coalesce("r.confidence", "some_confidence").alias("confidence"), "sources", "copies")


def dedupe_strongest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of each identity: the one with the largest frp (the first of equals), and the sorted sources."""
    rank = F.struct(F.coalesce("frp", F.lit(float("-inf"))), -F.col("seq"))
    some = F.min_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("seq"))).alias("some_confidence")
    got = df.withColumn("key", identity_key()).groupBy("key").agg(F.max_by(F.struct(*columns), rank).alias("r"), some, F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("copies"))
    rest = [F.col(f"r.{c}") for c in columns if c != "confidence"]
    return got.select("key", *rest, F.coalesce("r.confidence", "some_confidence").alias("confidence"), "sources", "copies")


def first_by(df: DataFrame, key: Column, order: Column, columns: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each ``key``; combined before the shuffle."""
    got = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*columns), order).alias("r"))
    return got.select(*[F.col(f"r.{c}") for c in columns])


def family(source_id: Column, sensor: Column | None = None, given: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    parts = [c for c in (given, F.try_element_at(known, source_id)) if c is not None]
    if sensor is not None:
        parts.append(F.when(sensor == "SLSTR", "slstr"))
    return F.coalesce(*parts, F.lit("unknown"))


def in_window(ts_ms: Column, end_ms: Column, hours: float = 24) -> Column:
    """Closed look-back window."""
    return ts_ms.between(end_ms - hours * 3_600_000, end_ms)
