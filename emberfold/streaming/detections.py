"""Streams of detections: de-duplication, windows and sessions with watermarks, and replays that end.

Windows and sessions are for append mode: one is given out, and its state given back, once the watermark has passed its
end; rows that come later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "48 hours"


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def dedupe(stream: DataFrame, key: list[str], ts: str = "detected_at", late: str = LATE) -> DataFrame:
    """Each key once; keys are forgotten when the watermark has passed them."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, width: str, slide: str | None = None, start: str | None = None, ts: str = "detected_at", late: str = LATE, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and peaks by window: tumbling without ``slide``, sliding with it, anchored at ``start``."""
    w = F.window(ts, width, slide or width, start) if start else F.window(ts, width, slide or width)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.max("frp").alias("max_frp"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "max_frp")


def sessions(stream: DataFrame, gap: str, by: str, ts: str = "detected_at", late: str = LATE) -> DataFrame:
    """Runs of detections of one key with gaps below ``gap``."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.max("frp").alias("max_frp"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n", "max_frp")


def replay(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all that is there, and stop. Results go to Parquet in ``folder``, or to ``each`` batch.

    A batch that is run again writes over its own folder, so that a restart leaves each batch once. A complete result takes
    the place of the one before.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(each or write).start().awaitTermination()


def arrivals(parts: list[DataFrame], folder: str, make: Callable[[DataFrame], DataFrame], last: DataFrame | None = None) -> DataFrame:
    """What the stream ``make`` gives out when ``parts`` arrive one after the other, each before the stream goes on from where it stopped.

    ``last`` is a row far ahead of all others: it moves the watermark beyond every window, so that all are given out.
    """
    spark = parts[0].sparkSession
    for part in [*parts, *([] if last is None else [last])]:
        part.write.mode("append").parquet(f"{folder}/in")
        replay(make(read_files(spark, f"{folder}/in", part.schema, 1 << 30)), folder)
    return spark.read.parquet(f"{folder}/out").drop("batch")
