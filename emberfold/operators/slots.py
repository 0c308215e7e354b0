"""Slots of time: frames carried back over missing ones, and playback of many reference times in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000


def carried_back(requests: DataFrame, frames: DataFrame, most: int = 12) -> DataFrame:
    """(layer, slot, used, back, reason) of each row of ``requests`` (layer, slot: whole numbers): the frame that is shown.

    ``frames`` (layer, slot, kind) says of the frames that were asked for once whether they are ok, invalid or failed in
    the network; of one that is not listed nothing is known, it is missing. An ok frame is used as it is. If the frame that
    was asked for is invalid, or failed, nothing else is tried; otherwise the newest ok one of the ``most`` slots before it
    is carried (reason carried), or none is there (exhausted). A frame that is listed twice is ok if it ever was.

    Slots meet in buckets of ``most`` + 1, so that a request sees the frames of two buckets and no more.
    """
    width = most + 1
    rank = F.when(F.col("kind") == "ok", 0).when(F.col("kind") == "invalid", 1).when(F.col("kind") == "network", 2).otherwise(3)
    known = frames.groupBy("layer", "slot").agg(F.min_by("kind", rank).alias("kind"))
    asked = requests.select("layer", "slot").join(known, ["layer", "slot"], "left")
    stop = F.coalesce(F.col("kind").isin("invalid", "network"), F.lit(False))
    bucket = lambda shift: F.floor(F.col("slot") / width) + shift
    held = known.where("kind = 'ok'").select("layer", F.col("slot").alias("at"), F.explode(F.array(bucket(0), bucket(1))).alias("bucket"))
    held = held.groupBy("layer", "bucket").agg(F.sort_array(F.collect_list("at"), asc=False).alias("ats"))
    met = asked.withColumn("bucket", bucket(0)).join(held, ["layer", "bucket"], "left")
    newest = F.get(F.filter("ats", lambda a: (a <= F.col("slot")) & (a >= F.col("slot") - most)), F.lit(0))
    used = F.when(~stop, newest)
    out = met.select("layer", "slot", used.alias("used"), F.when(stop, F.col("kind")).alias("_stop"))
    reason = F.coalesce("_stop", F.when(F.col("used") == F.col("slot"), "ok").when(F.col("used").isNotNull(), "carried").otherwise("exhausted"))
    return out.select("layer", "slot", "used", (F.col("slot") - F.col("used")).alias("back"), reason.alias("reason"))


def _slots(dets: DataFrame, zero: float, ms: int) -> DataFrame:
    """Adds slot, the slot of length ``ms`` from ``zero`` on, and edge, whether the detection stands at its very beginning."""
    since = F.col("ms") - zero
    return dets.withColumn("slot", F.floor(since / ms)).withColumn("edge", F.pmod(since, F.lit(float(ms))) == 0)


def frame_times(spark: SparkSession, zero: float, step: int, n: int) -> DataFrame:
    """(frame, end_ms): ``n`` reference times, ``step`` hours apart, from ``zero`` on."""
    return spark.range(n).select(F.col("id").alias("frame"), (F.lit(zero) + F.col("id") * (step * HOUR)).alias("end_ms"))


def _in_frames(first: Column, last: Column, n: int) -> Column:
    """The frames from ``first`` to ``last``, of ``n``."""
    a, b = F.greatest(first, F.lit(0)).cast("long"), F.least(last, F.lit(n - 1)).cast("long")
    return F.explode(F.when(a <= b, F.sequence(a, b)))


def playback_counts(dets: DataFrame, zero: float, step: int, n: int, window: int = 24, threshold: float = 30.0, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """(frame, by, n_visible, n_threshold, max_frp, latest_ms): what is in the closed ``window`` hours before each of ``n`` reference times.

    Frame i ends at ``zero`` plus i times ``step`` hours. Detections (ms, frp) are added up by slots of ``step`` hours first,
    those at the very border of two slots apart, and slots are then added to the frames whose window holds them; ``window``
    is a multiple of ``step``. Frames without detections have no row; detections without a time are in none.
    """
    if window % step:
        raise ValueError("window must be a multiple of step")
    wide = window // step
    sums = _slots(dets.where("ms is not null"), zero, step * HOUR).groupBy(*by, "slot", "edge").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("frp") >= threshold).alias("hot"), F.max("frp").alias("frp"), F.max("ms").alias("ms"))
    # a slot ends where the frame after it does; its border belongs to the frame that ends there as well
    first = F.when(F.col("edge"), F.col("slot")).otherwise(F.col("slot") + 1)
    told = sums.select("*", _in_frames(first, F.col("slot") + wide, n).alias("frame"))
    return told.groupBy("frame", *by).agg(F.sum("n").alias("n_visible"), F.sum("hot").alias("n_threshold"), F.max("frp").alias("max_frp"), F.max("ms").alias("latest_ms"))


def playback_peaks(dets: DataFrame, zero: float, step: int, n: int, buckets: int = 24, least_frp: float = 5.0, hours: int = 48, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """(frame, by, bucket, det, frp, ms): the strongest detection of each of ``buckets`` in the ``hours`` before each reference time (ties: the earliest, then
    the smallest det), as ``windows.peaks`` finds them for one. The end itself is in the last bucket.

    The strongest of each slot is found once; a slot is as long as all frames and buckets allow.
    """
    if hours % buckets:
        raise ValueError("buckets must be whole hours")
    width = hours // buckets
    slot = next(h for h in range(min(step, width), 0, -1) if step % h == 0 and width % h == 0)
    live = _slots(dets.where("ms is not null").where(F.col("frp") >= least_frp), zero, slot * HOUR)
    best = live.groupBy(*by, "slot", "edge").agg(F.min(F.struct((-F.col("frp")).alias("o"), "ms", "det")).alias("b"))
    span, pace = hours // slot, step // slot
    # frames that end at the slot's border see it as their end, later ones as a part of a bucket
    from_border = F.when(F.col("edge"), F.ceil(F.col("slot") / pace)).otherwise(F.floor(F.col("slot") / pace) + 1)
    told = best.select("*", _in_frames(from_border, F.floor((F.col("slot") + span) / pace), n).alias("frame"))
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("slot") - (F.col("frame") * pace - span)) / (width // slot)).cast("int"))
    peak = told.withColumn("bucket", bucket).groupBy("frame", *by, "bucket").agg(F.min("b").alias("b"))
    return peak.select("frame", *by, "bucket", F.col("b.det").alias("det"), (-F.col("b.o")).alias("frp"), F.col("b.ms").alias("ms"))
