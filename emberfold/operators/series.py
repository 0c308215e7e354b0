"""Hourly model series: the hour nearest to a time, windows, and samples of places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.risk import wildfire_share
from emberfold.functions.text import epoch_ms


def hours(points: DataFrame, times: str, values: Sequence[str], keep: Sequence[str] = ("sample",)) -> DataFrame:
    """One row of each hour of each point: (keep, at, time, values), from arrays of equal length."""
    zipped = F.arrays_zip(*[F.col(c) for c in (times, *values)])
    rows = points.select(*keep, F.posexplode(zipped).alias("at", "h"))
    time = F.regexp_replace(F.col(f"h.{times}"), "Z$", "").try_cast("timestamp_ntz")
    return rows.select(*keep, "at", time.alias("time"), *[F.col(f"h.{v}").cast("double").alias(v) for v in values])


def nearest_hour(rows: DataFrame, target: Column, values: Sequence[str], keep: Sequence[str] = ("sample",)) -> DataFrame:
    """Of each point, the values of the hour nearest to ``target`` (timestamp without zone); the first of equals."""
    gap = F.abs(epoch_ms(F.col("time")) - epoch_ms(target))
    best = rows.where("time is not null").groupBy(*keep).agg(F.min_by(F.struct("time", *values), F.struct(gap, F.col("at"))).alias("b"))
    return best.select(*keep, "b.time", *[f"b.{v}" for v in values])


#: Fixed names of the hourly weather values, and the level whose speed and direction a map shows.
WEATHER = (
    "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "temperature_2m", "relative_humidity_2m",
    "precipitation", "wind_speed_850hPa", "wind_direction_850hPa", "wind_speed_700hPa", "wind_direction_700hPa",
)
LEVELS = ("10m", "850hPa", "700hPa")


def finite(value: Column) -> Column:
    """Null for what is no number."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def weather_at(rows: DataFrame, target: Column, keep: Sequence[str] = ("sample",)) -> DataFrame:
    """All weather values of each point in the hour nearest to ``target``; what is no finite number is null."""
    got = nearest_hour(rows, target, WEATHER, keep)
    return got.withColumns({v: finite(F.col(v)) for v in WEATHER})


def wind_at(rows: DataFrame, target: Column, level: str = "10m", keep: Sequence[str] = ("sample",)) -> DataFrame:
    """(keep, time, speed, direction, level) of each point in the hour nearest to ``target``; an unknown level is that of 10 m."""
    level = level if level in LEVELS else LEVELS[0]
    names = [f"wind_speed_{level}", f"wind_direction_{level}"]
    got = nearest_hour(rows, target, names, keep)
    return got.select(*keep, "time", finite(F.col(names[0])).alias("speed"), finite(F.col(names[1])).alias("direction"), F.lit(level).alias("level"))


def clean(value: Column) -> Column:
    """Null for negative values."""
    return F.when(value >= 0, value)


def shares(rows: DataFrame) -> DataFrame:
    """Adds the share of wildfire smoke in all particles."""
    return rows.withColumn("share", wildfire_share(F.col("pm10_wildfires"), F.col("pm10")))


def batches(df: DataFrame, seq: str, size: int = 45) -> DataFrame:
    """Adds the number of the request batch that a row belongs to."""
    return df.withColumn("batch", F.floor(F.col(seq) / size))


def lattice(spark, west: float, south: float, east: float, north: float, rows: int, cols: int) -> DataFrame:
    """(r, c, lat, lon): a regular lattice over a box."""
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    lat = F.lit(south) + (north - south) * F.col("r") / max(1, rows - 1)
    lon = F.lit(west) + (east - west) * F.col("c") / max(1, cols - 1)
    return grid.select("r", "c", lat.alias("lat"), lon.alias("lon"))


def lattice_size(west: float, south: float, east: float, north: float, zoom: int, most: int = 220) -> tuple[int, int]:
    """Rows and columns by zoom and shape of the box: spaced by a tenth of a degree at least, ``most`` points at most."""
    tall, wide = max(0.01, north - south), max(0.01, east - west)
    shape = max(0.2, wide / tall)
    wish = min(most, 150 if zoom <= 5 else 190 if zoom <= 7 else 220 if zoom <= 9 else 260)
    rows = max(3, int((wish / shape) ** 0.5 + 0.5))
    cols = min(max(3, int(rows * shape + 0.5)), max(2, int(wide / 0.1) + 1))
    rows = min(rows, max(2, int(tall / 0.1) + 1))
    while rows * cols > most and max(rows, cols) > 3:
        if cols >= rows and cols > 3:
            cols -= 1
        else:
            rows -= 1
    return rows, cols
