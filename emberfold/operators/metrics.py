"""Counts that describe sources, products and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.operators.detections import in_window


def thermal_metrics(dets: DataFrame, end_ms: Column, threshold: float = 30.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (or one, without ``by``) of: detections, at the threshold or above, in the last 24 hours, and the latest time."""
    seen = F.coalesce(in_window(F.col("ms"), end_ms), F.lit(False))
    return dets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("frp") >= threshold, F.lit(False))).alias("n_threshold"), F.count_if(seen).alias("n_visible"), F.max("detected_at").alias("latest"))


def status_rows(defs: DataFrame, metrics: DataFrame, mode: str = "SEPARATE_SOURCES", manual: str = "AUTO") -> DataFrame:
    """Every defined row with its counts and status; rows that the mode or a manual choice leaves out are disabled."""
    out = defs.join(F.broadcast(metrics), "product", "left")
    off = (F.col("manual_only") & F.lit(manual != "MODIS_NRT")) | (~F.col("manual_only") & (F.lit(manual) != "AUTO") & (F.col("product") != manual)) | (F.lit(mode == "FIRMS_ONLY") & (F.col("source_id") != "nasa-firms"))
    status = F.when(off, "disabled").when(F.col("n").isNull(), "idle").when(F.col("n") == 0, "empty").otherwise("ok")
    return out.withColumn("status", status)


def group_status(loads: DataFrame) -> DataFrame:
    """One row of a table of loads (source, failed, n): error if all failed, empty, warn if some failed, else ok."""
    some = loads.agg(F.count(F.lit(1)).alias("sources"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    status = F.when(F.col("failed") == F.col("sources"), "error").when((F.col("n") == 0) & (F.col("failed") == 0), "empty").when(F.col("failed") > 0, "warn").otherwise("ok")
    return some.withColumn("status", status)


def next_status(before: Column, failed: Column, n: Column) -> Column:
    """Status of a source after a load: an error after a success leaves it stale."""
    return F.when(failed & before.isin("ok", "empty", "stale"), "stale").when(failed, "error").when(n == 0, "empty").otherwise("ok")
