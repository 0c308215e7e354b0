"""Queries of weather by hour and level, layers of a country's box, and named events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.operators import clusters, grid_etl, series
from emberfold.plans import tables as T
from emberfold.plans.space import REACH

BOOK = T.Book()

#: A model hour of each event at one of fifty places; some values are missing.
HOURS = ("CAST(user_id % 50 AS BIGINT) AS sample", 'event_id AS "at"', "ts AS time", *[f"CASE WHEN (event_id + {i}) % 7 > 0 THEN value * {i + 1} + event_id % 13 END AS {v}" for i, v in enumerate(series.WEATHER)])
_hours = T._cte("h", HOURS, "events")
_nearest = f"QUALIFY row_number() OVER (PARTITION BY sample ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '{T.AS_OF}')), \"at\") = 1"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T._read(spark, sf_dir, "events", HOURS)


@BOOK.add("S22_weather_detail", f"WITH {_hours} SELECT sample, time, {', '.join(series.WEATHER)} FROM h {_nearest}")
def weather_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten weather values of each place in the hour nearest to AS_OF."""
    return series.weather_at(_rows(spark, sf_dir), F.lit(T.AS_OF).cast("timestamp_ntz"))


@BOOK.add("S21_wind_levels", f"WITH {_hours}, n AS (SELECT * FROM h {_nearest}) " + " UNION ALL ".join(f"SELECT sample, time, wind_speed_{v} AS speed, wind_direction_{v} AS direction, '{v}' AS level FROM n" for v in series.LEVELS))
def wind_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed and direction at three levels in the hour nearest to AS_OF."""
    rows, target = _rows(spark, sf_dir), F.lit(T.AS_OF).cast("timestamp_ntz")
    out = [series.wind_at(rows, target, v) for v in series.LEVELS]
    return out[0].unionByName(out[1]).unionByName(out[2])


BOX = (29.0, 37.2, 30.2, 38.6)
SHAPES = (
    "sid", "CASE sid % 6 WHEN 0 THEN 'substation' WHEN 1 THEN 'minor_line' WHEN 2 THEN 'cable' ELSE 'line' END AS kind",
    "CASE sid % 7 WHEN 0 THEN '300-500kV' WHEN 1 THEN '>500kV' WHEN 2 THEN '66-300kV' WHEN 3 THEN '20-66kV' WHEN 4 THEN '<20kV' WHEN 5 THEN 'other' END AS voltage_group",
    "a_lon + sid / 7.1e6 AS a_lon", "a_lat + sid / 7.1e6 AS a_lat", "b_lon + sid / 8.9e6 AS b_lon", "b_lat + sid / 8.9e6 AS b_lat",
)
_micro = lambda x: f"CAST(round({x} * 1e5) AS BIGINT)"


@BOOK.add(
    "S41_country_layers",
    f"WITH {T.S}, f AS (SELECT {', '.join(SHAPES)} FROM seg), b AS (SELECT *, least(a_lon, b_lon) AS w, greatest(a_lon, b_lon) AS e, least(a_lat, b_lat) AS s, greatest(a_lat, b_lat) AS n FROM f WHERE kind <> 'cable'), "
    f"c AS (SELECT *, (w + e) / 2 AS x, (s + n) / 2 AS y FROM b WHERE e >= {BOX[0]} AND w <= {BOX[2]} AND n >= {BOX[1]} AND s <= {BOX[3]}) "
    f"SELECT sid, CASE WHEN kind = 'substation' THEN 'substations' WHEN voltage_group IN ('300-500kV', '>500kV') THEN '400' WHEN voltage_group = '66-300kV' THEN '154' WHEN voltage_group IN ('20-66kV', '<20kV') THEN '33' ELSE 'unknown' END AS layer, "
    f"CASE WHEN kind = 'substation' THEN 1 ELSE 2 END AS n_points, {_micro('CASE WHEN kind = $$substation$$ THEN x ELSE a_lon END')} AS lon5, {_micro('CASE WHEN kind = $$substation$$ THEN y ELSE a_lat END')} AS lat5 FROM c WHERE kind <> 'substation' OR (x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]})",
)
def country_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer and the rounded places of what belongs to a box."""
    rows = T.segments(spark, sf_dir).selectExpr(*SHAPES).withColumn("points", F.array(F.array("a_lon", "a_lat"), F.array("b_lon", "b_lat")))
    got = grid_etl.country_layers(rows, *BOX)
    at = lambda i: F.round(F.get(F.get("points", F.lit(0)), F.lit(i)) * 1e5).cast("long")
    return got.select("sid", "layer", F.size("points").alias("n_points"), at(0).alias("lon5"), at(1).alias("lat5"))


@BOOK.add("A10_O8_event_names", f"WITH RECURSIVE {REACH} SELECT cluster, 'TR-fire-' || strftime(min(detected_at), '%Y%m%d') || '-' || md5(CAST(cluster AS VARCHAR))[:10] AS name, max(ms) AS latest_ms FROM det_ JOIN lab USING (det) GROUP BY cluster ORDER BY latest_ms DESC, cluster")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by name, the latest first."""
    return clusters.event_names(clusters.summarize(clusters.cluster(T.detections(spark, sf_dir))), "TR").select("cluster", "name", "latest_ms")
