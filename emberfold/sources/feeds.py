"""Feeds from file to valid, de-duplicated detections, with the counts on the way and the state of each source."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.operators import detections, metrics
from emberfold.sources import files

#: The archive's columns, and its products.
ARCHIVE = ("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_ti5", "frp", "daynight")
PRODUCTS = ("VIIRS_NOAA21_NRT", "VIIRS_NOAA20_NRT", "VIIRS_SNPP_NRT")
COLUMNS = ("seq", "lat", "lon", "frp", "confidence", "satellite", "sensor", "product", "source", "source_id", "country", "detected_at")
DAYS = (1, 5)


def request(bbox: str, days: int, country_box: Sequence[float]) -> tuple[tuple[float, ...], int]:
    """Bounds and days of a request: the bounds must lie inside the country's, days are clamped."""
    box = tuple(float(x) for x in bbox.split(","))
    if len(box) != 4 or not (box[0] < box[2] and box[1] < box[3]):
        raise ValueError(f"not bounds: {bbox}")
    w, s, e, n = country_box
    if not (w <= box[0] and s <= box[1] and box[2] <= e and box[3] <= n):
        raise ValueError("bounds outside the country")
    return box, min(DAYS[1], max(DAYS[0], int(days)))


def _ordered(raw: DataFrame) -> DataFrame:
    """``seq`` by content, so that the first of equal rows is the same one in every run."""
    return raw.withColumn("seq", F.xxhash64(*[F.col(c).cast("string") for c in raw.columns]))


def load_archive(spark: SparkSession, path: str, product: str, country: str, rings: Sequence | None = None) -> DataFrame:
    """One product of the archive: valid detections inside the region."""
    raw = _ordered(files.read_csv(spark, path, ARCHIVE))
    rows = detections.normalize(raw, {"product": product, "source": product, "source_id": "nasa-firms", "country": country})
    return detections.valid(rows, rings).select(*COLUMNS)


def load_fire_power(spark: SparkSession, path: str, source_id: str, product: str, country: str, rings: Sequence | None = None, satellite: str | None = None) -> DataFrame:
    """One fire-power source from its stored pages: valid detections inside the region, each once."""
    features = files.feature_id(files.read_features(spark, path))
    once = detections.first_by(features, F.col("fid"), F.struct("file", "at"), features.columns)
    raw = files.fire_power_raw(once).withColumn("seq", F.xxhash64("fid"))
    rows = detections.normalize(raw, {"product": product, "source": product, "source_id": source_id, "country": country, "satellite": satellite, "sensor": "SLSTR" if "slstr" in source_id else None})
    ok = detections.valid(rows, rings).select(*COLUMNS)
    return detections.dedupe_first(ok, COLUMNS).select(*COLUMNS)


def load_all(loads: dict[str, Callable[[], DataFrame]], dedupe: bool = True) -> tuple[DataFrame | None, dict[str, str], str]:
    """Several products at once: their union (each detection once), what failed, and ok, warn or error."""
    out, failed = None, {}
    for name, load in loads.items():
        try:
            df = load()
        except (OSError, ValueError) as e:
            failed[name] = str(e)
            continue
        out = df if out is None else out.unionByName(df)
    if out is not None and dedupe:
        out = detections.dedupe_first(out, COLUMNS).select(*COLUMNS)
    return out, failed, "error" if out is None else "warn" if failed else "ok"


def load_counts(valid: DataFrame) -> DataFrame:
    """(source_id, valid, deduplicated) of loaded rows."""
    return valid.withColumn("key", detections.identity_key()).groupBy("source_id").agg(F.count(F.lit(1)).alias("valid"), F.count_distinct("key").alias("deduplicated"))


def by_satellite(rows: DataFrame) -> DataFrame:
    """Rows of the two polar satellites under their own sources."""
    own = F.when(F.col("satellite").isin("S3A", "Sentinel-3A"), "sentinel3a-slstr").when(F.col("satellite").isin("S3B", "Sentinel-3B"), "sentinel3b-slstr")
    return rows.withColumn("source_id", F.when(F.col("source_id").contains("slstr"), F.coalesce(own, "source_id")).otherwise(F.col("source_id")))


def update_states(states: DataFrame, loads: DataFrame) -> DataFrame:
    """(source_id, seq, status) after loads (source_id, seq, failed, n): a load that is older than the state changes nothing."""
    new = loads.select("source_id", F.col("seq").alias("_seq"), "failed", "n")
    both = states.join(new, "source_id", "left")
    later = F.coalesce(F.col("_seq") > F.col("seq"), F.lit(False))
    status = F.when(later, metrics.next_status(F.col("status"), F.col("failed"), F.col("n"))).otherwise(F.col("status"))
    return both.select("source_id", F.when(later, F.col("_seq")).otherwise(F.col("seq")).alias("seq"), status.alias("status"))
