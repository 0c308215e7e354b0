"""Domain tables bound to the test tables by integer arithmetic on their keys, and pieces of SQL for DuckDB.

The column lists are read alike by Spark and by DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: 2024-01-15 12:00 UTC.
AS_OF_MS = 1_705_320_000_000.0
AS_OF = "2024-01-15 12:00:00"
#: (lon, lat) of the region and of a hole in it.
REGION = (
    ((28.6, 37.0), (29.5, 36.95), (30.4, 37.1), (30.45, 38.0), (30.3, 38.8), (29.4, 38.85), (28.7, 38.6), (28.55, 37.8)),
    ((29.3, 37.6), (29.7, 37.6), (29.7, 38.1), (29.3, 38.1)),
)

_spread = lambda base, key, prime, n=20000, by="1e4": f"{base}e0 + ({key} * {prime} % {n}) / {by}"
_of = lambda values: "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
#: Every user is a fire's site, and events scatter around it by some kilometres.
LAT, LON = "36.9e0 + ((user_id * 1543 + event_id % 97 * 3) % 20000) / 1e4", "28.5e0 + ((user_id * 7411 + event_id % 89 * 4) % 20000) / 1e4"
DETECTIONS = (
    "event_id AS det", "event_id AS seq", f"{LAT} AS lat", f"{LON} AS lon", "value AS frp", "ts AS detected_at",
    "CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'nominal' WHEN 'error' THEN 'low' WHEN 'purchase' THEN CAST(user_id AS STRING) END AS confidence",
    f"{_of(('N20', 'S3A', 'MTI1'))} AS satellite", f"{_of(('VIIRS_NOAA20_NRT', 'SLSTR L2P FRP', 'MTG FCI FRP'))} AS product", f"{_of(('nasa-firms', 'sentinel3a-slstr', 'mtg-fci-frp'))} AS source_id",
    f"{_of(('viirs-modis', 'slstr', 'mtg'))} AS family", "CASE WHEN event_id % 4 = 0 THEN 'archive' ELSE 'live' END AS source", "'TR' AS country",
)
SEGMENTS = (
    "p_partkey AS sid", "concat('line-', CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING)) AS asset_key", "CASE WHEN p_partkey % 3 = 0 THEN '400' ELSE '154' END AS grid_class",
    f"{_spread(28.5, 'p_partkey', 7907)} AS a_lon", f"{_spread(36.9, 'p_partkey', 104723)} AS a_lat",
    f"{_spread(28.5, 'p_partkey', 7907)} + (p_partkey % 7 - 3) / 1e2 AS b_lon", f"{_spread(36.9, 'p_partkey', 104723)} + (p_partkey % 5 - 2) / 1e2 + 0.001e0 AS b_lat",
)
SUBSTATIONS = ("s_suppkey AS sub", f"{_spread(36.9, 's_suppkey', 15485863)} AS lat", f"{_spread(28.5, 's_suppkey', 32452843)} AS lon")
WIND = (
    "CAST(n_nationkey AS BIGINT) AS sample", f"{_spread(36.9, 'n_nationkey', 37, 20, '1e1')} AS lat", f"{_spread(28.5, 'n_nationkey', 53, 20, '1e1')} AS lon",
    "CASE WHEN n_nationkey % 6 > 0 THEN n_nationkey * 1.7e0 END AS speed", "CASE WHEN n_nationkey % 11 > 0 THEN (n_nationkey * 37 % 360) * 1e0 END AS direction",
)
#: Raw grid features of parts: text properties, a point or a line, and voltages as volunteers write them.
FEATURES = (
    "p_partkey AS seq", "CASE p_partkey % 5 WHEN 0 THEN 'substation' WHEN 1 THEN 'line' WHEN 2 THEN ' Line' WHEN 3 THEN 'cable' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'tower' ELSE 'line' END END AS power",
    "CASE WHEN p_partkey % 5 = 0 THEN 'Point' WHEN p_partkey % 13 = 0 THEN 'Polygon' ELSE 'LineString' END AS shape",
    "CASE p_partkey % 8 WHEN 0 THEN '400000;225000' WHEN 1 THEN '20000;400' WHEN 2 THEN '63 kV' WHEN 3 THEN '154000' WHEN 4 THEN '' WHEN 5 THEN '380000,5' WHEN 6 THEN '765000' END AS voltage",
    "CASE WHEN p_partkey % 16 = 4 THEN '154000' END AS voltage_raw", "CASE WHEN p_partkey % 8 = 7 THEN '66' END AS explicit_kv",
    "CASE WHEN p_partkey % 9 > 0 THEN CAST(p_partkey % 700 AS STRING) END AS osm_id", "CAST(NULL AS STRING) AS osm_id2", "CAST(NULL AS STRING) AS osmId", "CASE WHEN p_partkey % 10 = 0 THEN 'relation' END AS osm_type",
    "CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name", "CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS ref", "CASE WHEN p_partkey % 3 = 0 THEN p_type END AS operator",
    "CASE WHEN p_partkey % 7 = 0 THEN 'North' END AS \"from\"", "CASE WHEN p_partkey % 14 = 0 THEN 'South' END AS \"to\"", "'50' AS frequency", "CASE WHEN p_size > 25 THEN '3' END AS cables", "CAST(NULL AS STRING) AS wires",
    "CASE WHEN p_partkey % 2 = 0 THEN concat('2024-01-', CASE WHEN p_partkey % 28 < 9 THEN '0' ELSE '' END, CAST(p_partkey % 28 + 1 AS STRING), 'T00:00:00Z') END AS osm_timestamp", "CAST(p_partkey % 3 AS STRING) AS osm_version",
    f"{_spread(28.5, 'p_partkey', 7907)} AS lon", f"{_spread(36.9, 'p_partkey', 104723)} AS lat",
    "concat('[', CAST(p_partkey * 7907 % 20000 AS STRING), ',', CAST(p_partkey * 104723 % 20000 AS STRING), ']') AS geometry",
)


def _read(spark: SparkSession, sf_dir: str, table: str, columns: tuple[str, ...]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[c.replace('"', "`") for c in columns])


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", (*DETECTIONS, "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e3 AS ms"))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of the closed 24 hours before AS_OF."""
    return detections(spark, sf_dir).where(f"ms BETWEEN {AS_OF_MS - 86_400_000} AND {AS_OF_MS}")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part", SEGMENTS)


def substations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier", SUBSTATIONS)


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation", WIND)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part", FEATURES)


class Book:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


# DuckDB: the same tables as common table expressions
_cte = lambda name, columns, table: f"{name} AS (SELECT {', '.join(columns)} FROM {table})"
D = _cte("det_", (*DETECTIONS, "epoch_us(ts) / 1e3 AS ms"), "events")
R = D + f", recent AS (SELECT * FROM det_ WHERE ms BETWEEN {AS_OF_MS - 86_400_000} AND {AS_OF_MS})"
#: All detections by the name of the recent ones.
ALL = D + ", recent AS (SELECT * FROM det_)"
S = _cte("seg", SEGMENTS, "part")
B = _cte("sub_", SUBSTATIONS, "supplier")
W = _cte("wind_", WIND, "nation")
F_ = _cte("feat", FEATURES, "part")


def hav(a: str, b: str, c: str, d: str) -> str:
    """Kilometres from (a, b) to (c, d), as lat and lon."""
    return f"(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"(((degrees(atan2({y}, {x})) + 360) % 360 + 360) % 360)"


def off(a: str, b: str) -> str:
    return f"abs((({a} - {b} + 540) % 360 + 360) % 360 - 180)"


def seg_xy(lat: str = "lat", lon: str = "lon", a_lat: str = "a_lat", a_lon: str = "a_lon", b_lat: str = "b_lat", b_lon: str = "b_lon") -> tuple[str, str, str]:
    """(km, lat, lon) of the nearest point of a segment."""
    kx = f"(111.320 * cos(radians({lat})))"
    ax, ay, dx, dy = f"(({a_lon} - {lon}) * {kx})", f"(({a_lat} - {lat}) * 110.574)", f"(({b_lon} - {a_lon}) * {kx})", f"(({b_lat} - {a_lat}) * 110.574)"
    t = f"least(1.0, greatest(0.0, -({ax} * {dx} + {ay} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
    x, y = f"({ax} + {t} * {dx})", f"({ay} + {t} * {dy})"
    return f"sqrt({x} * {x} + {y} * {y})", f"({lat} + {y} / 110.574)", f"({lon} + {x} / {kx})"


def weight(c: str) -> str:
    n = f"TRY_CAST({c} AS DOUBLE)"
    return f"(CASE WHEN lower({c}) IN ('high', 'h') THEN 1.0 WHEN lower({c}) IN ('nominal', 'n') THEN 0.75 WHEN lower({c}) IN ('low', 'l') THEN 0.45 WHEN {c} IS NULL OR trim({c}) = '' THEN 0.0 WHEN {n} IS NOT NULL THEN least(1.0, greatest(0.0, {n} / 100)) ELSE 0.6 END)"


def ring(points: tuple, lat: str = "lat", lon: str = "lon") -> str:
    parts = []
    for (xi, yi), (xj, yj) in zip(points, (points[-1], *points[:-1]), strict=True):
        if yi != yj:
            parts.append(f"CAST((({yi}e0 > {lat}) <> ({yj}e0 > {lat})) AND {lon} < ({xj}e0 - {xi}e0) * ({lat} - {yi}e0) / ({yj}e0 - {yi}e0) + {xi}e0 AS INT)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def inside() -> str:
    return f"({ring(REGION[0])} AND NOT {ring(REGION[1])})"
