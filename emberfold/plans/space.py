"""Queries of ingest, de-duplication, regions, distance joins, clusters and association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.functions.geo import haversine_km, in_region
from emberfold.functions.numbers import confidence_weight
from emberfold.operators import association, clusters, spatial
from emberfold.operators import detections as dets
from emberfold.plans import tables as T

BOOK = T.Book()
r6 = lambda c, name: F.round(c, 6).alias(name)
_q6 = lambda x, name: f"round({x}, 6) AS {name}"

RAW = (
    "event_id AS seq", f"CASE WHEN event_id % 50 = 3 THEN '35xN' ELSE CAST({T._spread(36.9, 'event_id', 7919)} AS STRING) END AS latitude", f"CAST({T._spread(28.5, 'event_id', 104729)} AS STRING) AS longitude",
    "CASE WHEN event_id % 2 = 0 THEN CAST(value AS STRING) END AS \"FRP\"", "CAST(user_id AS STRING) AS brightness", "'2024-01-05' AS acq_date", "CAST(event_id % 2400 AS STRING) AS acq_time",
    "CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN '85' END AS confidence", "'0.5' AS scan", "CASE WHEN event_id % 3 > 0 THEN '0.6' END AS track", "concat(' ', event_type, ' ') AS satellite", "'VIIRS' AS instrument",
)
_hm = "lpad(acq_time, 4, '0')"


@BOOK.add(
    "F1_normalize",
    f"WITH raw AS (SELECT {', '.join(RAW)} FROM events) SELECT seq, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon, TRY_CAST(coalesce(\"FRP\", brightness) AS DOUBLE) AS frp, trim(satellite) AS satellite, instrument AS sensor, 'V' AS product, "
    f"TRY_CAST(concat(acq_date, ' ', substr({_hm}, 1, 2), ':', substr({_hm}, 3), ':00') AS TIMESTAMP) AS detected_at, confidence, CASE confidence WHEN 'high' THEN 1.0 WHEN '85' THEN 0.85 END AS confidence_normalized, round(TRY_CAST(scan AS DOUBLE) * TRY_CAST(track AS DOUBLE), 6) AS area FROM raw",
)
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[c.replace('"', "`") for c in RAW])
    return dets.normalize(raw, {"product": "V"}).select("seq", "lat", "lon", "frp", "satellite", "sensor", "product", "detected_at", "confidence", "confidence_normalized", r6(F.col("pixel_area_km2"), "area"))


#: Rows that repeat with another power, later and from another source.
def _twice(df: DataFrame) -> DataFrame:
    more = df.where("seq % 10 = 0").withColumns({"frp": F.col("frp") + F.when(F.col("seq") % 20 == 0, 5.0).otherwise(-5.0), "seq": F.col("seq") + 10_000_000, "source": F.lit("again"), "confidence": F.coalesce("confidence", F.lit("late"))})
    return df.unionByName(more)


TWICE = f"{T.D}, twice AS (SELECT * FROM det_ UNION ALL SELECT * REPLACE (frp + CASE WHEN seq % 20 = 0 THEN 5.0 ELSE -5.0 END AS frp, seq + 10000000 AS seq, 'again' AS source, coalesce(confidence, 'late') AS confidence) FROM det_ WHERE seq % 10 = 0)"
_round4 = lambda c: f"CAST(CAST(floor({c} * 10000 + 0.5) / 10000.0 AS DECIMAL(12, 4)) AS VARCHAR)"
KEY = f"concat_ws(':', country, product, satellite, strftime(detected_at, '%Y-%m-%dT%H:%M'), {_round4('lat')}, {_round4('lon')})"


@BOOK.add(
    "A1_A2_dedupe_first",
    f"WITH {TWICE}, k AS (SELECT *, {KEY} AS key FROM twice) SELECT key, arg_min(seq, seq) AS seq, max(frp) AS frp, arg_min(confidence, seq) FILTER (confidence IS NOT NULL) AS confidence, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS copies FROM k GROUP BY key",
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dets.dedupe_first(_twice(T.detections(spark, sf_dir)), ("seq", "frp", "confidence"))
    return out.select("key", "seq", "frp", "confidence", F.array_join("sources", ",").alias("sources"), "copies")


@BOOK.add(
    "A3_dedupe_strongest",
    f"WITH {TWICE}, k AS (SELECT *, {KEY} AS key, row_number() OVER (PARTITION BY {KEY} ORDER BY frp DESC, seq) AS rn FROM twice) SELECT key, max(seq) FILTER (rn = 1) AS seq, max(frp) FILTER (rn = 1) AS frp, coalesce(max(confidence) FILTER (rn = 1), arg_min(confidence, seq) FILTER (confidence IS NOT NULL)) AS confidence, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS copies FROM k GROUP BY key",
)
def dedupe_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dets.dedupe_strongest(_twice(T.detections(spark, sf_dir)), ("seq", "frp", "confidence"))
    return out.select("key", "seq", "frp", "confidence", F.array_join("sources", ",").alias("sources"), "copies")


@BOOK.add("A4_feature_dedupe", "SELECT user_id AS fid, min(event_id) AS seq, arg_min(event_type, event_id) AS kind FROM events GROUP BY user_id")
def feature_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS fid", "event_id AS seq", "event_type AS kind")
    return dets.first_by(rows, F.col("fid"), F.col("seq"), ("fid", "seq", "kind"))


@BOOK.add("P1_P5_region", f"WITH {T.ALL} SELECT det, {T.inside()} AS inside FROM recent")
def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detections(spark, sf_dir).select("det", in_region(F.col("lat"), F.col("lon"), T.REGION).alias("inside"))


@BOOK.add("P6_P8_filters", f"WITH {T.R} SELECT det, frp, detected_at FROM recent WHERE {T.inside()} AND (frp IS NULL OR frp >= 30)")
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dets.valid(T.recent(spark, sf_dir), T.REGION)
    return dets.at_least(rows, 30.0, unknown=True).select("det", "frp", "detected_at")


@BOOK.add("F11_sensor_family", "SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'viirs-modis' WHEN 1 THEN 'slstr' WHEN 2 THEN 'slstr' WHEN 3 THEN 'mtg' WHEN 4 THEN 'own' WHEN 5 THEN 'slstr' ELSE 'unknown' END AS family FROM supplier")
def sensor_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey", "CASE s_suppkey % 7 WHEN 0 THEN 'nasa-firms' WHEN 1 THEN 'sentinel3a-slstr' WHEN 2 THEN 'sentinel3b-slstr' WHEN 3 THEN 'mtg-fci-frp' ELSE 'x' END AS sid", "CASE WHEN s_suppkey % 7 = 5 THEN 'SLSTR' END AS sensor", "CASE WHEN s_suppkey % 7 = 4 THEN 'own' END AS given")
    return rows.select("s_suppkey", dets.family(F.col("sid"), F.col("sensor"), F.col("given")).alias("family"))


_cells = "SELECT sid, unnest(range(CAST(floor(least(a_lon, b_lon) / 0.5) AS BIGINT), CAST(floor(greatest(a_lon, b_lon) / 0.5) AS BIGINT) + 1)) AS cx, a_lat, b_lat FROM seg"


@BOOK.add("X1_X3_segment_cells", f"WITH {T.S}, c AS ({_cells}), e AS (SELECT sid, cx, unnest(range(CAST(floor(least(a_lat, b_lat) / 0.5) AS BIGINT), CAST(floor(greatest(a_lat, b_lat) / 0.5) AS BIGINT) + 1)) AS cy FROM c) SELECT CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, count(*) AS n FROM e GROUP BY ALL")
def segment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.segment_cells(T.segments(spark, sf_dir)).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


SEG = T.seg_xy()
HITS = f"{T.R}, {T.S}, {T.B}, lh AS (SELECT det, sid, asset_key, grid_class, {SEG[0]} AS km, {SEG[1]} AS near_lat, {SEG[2]} AS near_lon, (a_lat + b_lat) / 2 AS mid_lat, (a_lon + b_lon) / 2 AS mid_lon FROM recent, seg), sh AS (SELECT det, sub, {T.hav('recent.lat', 'recent.lon', 'sub_.lat', 'sub_.lon')} AS km, sub_.lat AS sub_lat, sub_.lon AS sub_lon FROM recent, sub_)"
NEAR = f"{HITS}, nl AS (SELECT * FROM lh WHERE km <= 25 QUALIFY row_number() OVER (PARTITION BY det ORDER BY km, sid) = 1), ns AS (SELECT * FROM sh WHERE km <= 25 QUALIFY row_number() OVER (PARTITION BY det ORDER BY km, sub) = 1)"


@BOOK.add("J1_nearest_assets", f"WITH {NEAR.replace(T.R, T.ALL)} SELECT det, CAST(nl.sid AS VARCHAR) AS sid, nl.asset_key, round(nl.km, 6) AS line_km, round(nl.near_lat, 6) AS near_lat, round(nl.near_lon, 6) AS near_lon, CAST(ns.sub AS VARCHAR) AS sub, round(ns.km, 6) AS sub_km FROM recent LEFT JOIN nl USING (det) LEFT JOIN ns USING (det)")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.detections(spark, sf_dir)
    line = spatial.nearest_lines(points, T.segments(spark, sf_dir), 25.0)
    sub = spatial.nearest_places(points, T.substations(spark, sf_dir), 25.0)
    out = points.select("det").join(line, "det", "left").join(sub, "det", "left")
    return out.select("det", F.col("line_sid").cast("string").alias("sid"), F.col("line_asset_key").alias("asset_key"), r6(F.col("line_km"), "line_km"), r6(F.col("line_near_lat"), "near_lat"), r6(F.col("line_near_lon"), "near_lon"), F.col("sub").cast("string").alias("sub"), r6(F.col("sub_km"), "sub_km"))


@BOOK.add("J2_assets_within", f"WITH {HITS.replace(T.R, T.ALL)} SELECT det, asset_key, round(min(km), 6) AS km FROM lh WHERE km <= 10 GROUP BY ALL")
def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spatial.line_hits(T.detections(spark, sf_dir), T.segments(spark, sf_dir), 10.0)
    return spatial.lines_within(hits, 10.0).select("det", "asset_key", r6(F.col("km"), "km"))


_sec = lambda la, lo, i: f"SELECT det, sid, asset_key, {T.hav('lat', 'lon', la, lo)} AS km, {T.bearing('lat', 'lon', la, lo)} AS bearing, CAST(det * 37 % 360 AS DOUBLE) AS dir, 10e0 + det % 21 AS reach FROM recent, seg"


@BOOK.add(
    "J3_sector",
    f"WITH {T.ALL}, {T.S}, p AS ({_sec('a_lat', 'a_lon', 0)} UNION ALL {_sec('b_lat', 'b_lon', 1)} UNION ALL {_sec('(a_lat + b_lat) / 2', '(a_lon + b_lon) / 2', 2)}), h AS (SELECT *, {T.off('dir', 'bearing')} AS o FROM p), "
    "s AS (SELECT det, sid, asset_key, arg_min(km, (o, km)) AS km FROM h WHERE o <= 22 AND km <= reach AND km >= 0.05 GROUP BY ALL) SELECT det AS event, asset_key, round(min(km), 6) AS km FROM s GROUP BY ALL",
)
def sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.detections(spark, sf_dir).selectExpr("det AS event", "lat", "lon", "CAST(det * 37 % 360 AS DOUBLE) AS direction", "10e0 + det % 21 AS reach")
    return spatial.lines_in_sector(events, T.segments(spark, sf_dir), 22.0, 30.0).select("event", "asset_key", r6(F.col("km"), "km"))


PAIRS = f"{T.D}, pr AS (SELECT u.det AS u, v.det AS v, {T.hav('u.lat', 'u.lon', 'v.lat', 'v.lon')} AS km FROM det_ u JOIN det_ v ON u.det < v.det AND v.lat BETWEEN u.lat - 0.05 AND u.lat + 0.05 AND v.ms BETWEEN u.ms - 21600000 AND u.ms + 21600000), e AS (SELECT * FROM pr WHERE km <= 5)"


@BOOK.add("J4_space_time_pairs", f"WITH {PAIRS} SELECT u, v, round(km, 6) AS km FROM e")
def space_time_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.close_pairs(T.detections(spark, sf_dir)).select("u", "v", r6(F.col("km"), "km"))


REACH = f"{PAIRS}, b AS (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e), reach(a, b) AS (SELECT det, det FROM det_ UNION SELECT r.a, b.b FROM reach r JOIN b ON r.b = b.a), lab AS (SELECT a AS det, min(b) AS cluster FROM reach GROUP BY a)"


@BOOK.add("A8_clusters", f"WITH RECURSIVE {REACH} SELECT det, cluster FROM lab")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(T.detections(spark, sf_dir)).select("det", "cluster")


@BOOK.add("A9_source_counts", f"WITH RECURSIVE {REACH}, c AS (SELECT cluster, source_id || '-' || source AS source, count(*) AS n FROM det_ JOIN lab USING (det) GROUP BY ALL) SELECT cluster, CAST(sum(n) AS BIGINT) AS n, string_agg(source || ':' || n, ',' ORDER BY source) AS sources FROM c GROUP BY cluster")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many detections each source and feed has of a cluster."""
    return clusters.source_counts(clusters.cluster(T.detections(spark, sf_dir)).withColumn("source", F.concat_ws("-", "source_id", "source")))


@BOOK.add(
    "A9_cluster_summary",
    f"WITH RECURSIVE {REACH}, m AS (SELECT det_.*, cluster, greatest(1.0, coalesce(frp, 1.0)) AS w FROM det_ JOIN lab USING (det)) SELECT cluster, count(*) AS n, {_q6('sum(lat * w) / sum(w)', 'lat')}, {_q6('sum(lon * w) / sum(w)', 'lon')}, max(frp) AS max_frp, round(sum(frp), 6) AS sum_frp, min(detected_at) AS earliest, max(detected_at) AS latest, "
    f"max({T.weight('confidence')}) AS confidence, arg_min(det, (-frp, ms, det)) AS representative, array_to_string(list_sort(list(DISTINCT product)), ',') AS products FROM m GROUP BY cluster",
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clusters.summarize(clusters.cluster(T.detections(spark, sf_dir)))
    return got.select("cluster", "n", r6(F.col("lat"), "lat"), r6(F.col("lon"), "lon"), "max_frp", r6(F.col("sum_frp"), "sum_frp"), "earliest", "latest", "confidence", "representative", "products")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detections(spark, sf_dir).withColumn("idx", F.col("det"))


_rules = "(VALUES " + ", ".join(f"('{a}', '{b}', {km}, {m})" for (a, b), (km, m) in association.RULES.items()) + ") r(fa, fb, rkm, rmin)"


@BOOK.add(
    "J5_J13_association_edges",
    f"WITH {T.D}, p AS (SELECT u.det AS u, v.det AS v, abs(u.ms - v.ms) AS dt, {T.hav('u.lat', 'u.lon', 'v.lat', 'v.lon')} AS km, least(u.family, v.family) AS fa, greatest(u.family, v.family) AS fb FROM det_ u JOIN det_ v ON u.det < v.det AND u.family <> v.family AND v.lat BETWEEN u.lat - 0.05 AND u.lat + 0.05 AND v.ms BETWEEN u.ms - 5400000 AND u.ms + 5400000) "
    f"SELECT u, v, round(km, 6) AS km FROM p JOIN {_rules} USING (fa, fb) WHERE km <= rkm AND dt <= rmin * 60000",
)
def association_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.edges(_observations(spark, sf_dir)).select("u", "v", r6(F.col("km"), "km"))


@BOOK.add("A11_associate")
def associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.associate(_observations(spark, sf_dir)).select("idx", "event")


@BOOK.add("A12_association_events")
def association_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = association.associate(_observations(spark, sf_dir))
    return association.association_events(members).join(association.max_frp_by_source(members), "event", "left").withColumn("frp_by_source", F.to_json("frp_by_source"))


@BOOK.add("A15_multi_sensor_metrics")
def multi_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.multi_sensor_metrics(association.association_events(association.associate(_observations(spark, sf_dir))))


@BOOK.add("J6_nearest_wind", f"WITH {T.ALL}, {T.W} SELECT det, sample, round(km, 6) AS km FROM (SELECT det, sample, {T.hav('recent.lat', 'recent.lon', 'wind_.lat', 'wind_.lon')} AS km FROM recent, wind_) QUALIFY row_number() OVER (PARTITION BY det ORDER BY km, sample) = 1")
def nearest_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.nearest_sample(T.detections(spark, sf_dir), T.wind(spark, sf_dir), "det", ("speed", "direction"))
    return got.select("det", "sample", r6(F.col("sample_km"), "km"))


@BOOK.add("J8_J9_O6_nearby", f"WITH {T.D}, d AS (SELECT *, {T.hav('lat', 'lon', '37.9e0', '29.5e0')} AS km FROM det_) SELECT count(*) AS n, count(*) FILTER (ms BETWEEN {T.AS_OF_MS - 86_400_000} AND {T.AS_OF_MS}) AS n_day, min(detected_at) AS first_at, max(detected_at) AS last_at, round(min(km), 6) AS nearest_km FROM d WHERE km <= 10")
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = T.detections(spark, sf_dir).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.lit(37.9), F.lit(29.5))).where("km <= 10")
    day = F.col("ms").between(T.AS_OF_MS - 86_400_000, T.AS_OF_MS)
    return near.agg(F.count(F.lit(1)).alias("n"), F.count_if(day).alias("n_day"), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"), r6(F.min("km"), "nearest_km"))


@BOOK.add("F5_confidence_by_product", f"WITH {T.D} SELECT product, {_q6(f'avg({T.weight("confidence")})', 'weight')} FROM det_ GROUP BY product")
def confidence_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detections(spark, sf_dir).groupBy("product").agg(r6(F.avg(confidence_weight(F.col("confidence"))), "weight"))
