"""Queries of risk, evidence, rankings, metrics and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.functions.geo import haversine_km
from emberfold.operators import clusters, metrics, risk, spatial, windows
from emberfold.plans import tables as T
from emberfold.plans.scalar import _steps
from emberfold.plans.space import NEAR, REACH
from emberfold.functions import risk as R
from emberfold.runtime import settle
from emberfold.sources import sinks

BOOK = T.Book()
r6 = lambda c, name: F.round(c, 6).alias(name)
_q6 = lambda x, name: f"round({x}, 6) AS {name}"
THRESHOLD = 30.0


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members and events of the last 24 hours whose strongest detection is at the threshold or above."""
    found = clusters.cluster(T.recent(spark, sf_dir)).withColumnRenamed("cluster", "event")
    events = clusters.summarize(found.withColumnRenamed("event", "cluster")).withColumnRenamed("cluster", "event").where(F.col("max_frp") >= THRESHOLD)
    events = settle(events)
    members = found.join(events.select("event"), "event", "left_semi").withColumn("key", F.col("det").cast("string"))
    return settle(members), events


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, events = _members(spark, sf_dir)
    return risk.analyze_events(members, events.select("event", "lat", "lon", "max_frp", "sum_frp", "latest", "earliest", "latest_ms", "n"), T.segments(spark, sf_dir), T.substations(spark, sf_dir), T.wind(spark, sf_dir), T.AS_OF_MS)


# the same in SQL: clusters of recent detections, their assets, wind, corridor, score and evidence
_reach = REACH.replace(T.D, T.R).replace("det_ u JOIN det_ v", "recent u JOIN recent v").replace("SELECT det, det FROM det_", "SELECT det, det FROM recent")
_tables = NEAR[len(T.R) :]
_weight = T.weight("confidence")
_age = f"greatest(0.0, ({T.AS_OF_MS} - latest_ms) / 3600000.0)"
_corr = "floor(least(30.0, greatest(10.0, 10 + 20 * (0.65 * least(1.0, greatest(0.0, (coalesce(speed, 15) - 5) / 30)) + 0.35 * least(1.0, greatest(0.0, ln(greatest(max_frp, 30.0) / 30) / ln(10.0)))))) + 0.5)"
_see = lambda la, lo: f"SELECT event, sid, asset_key, direction, reach, {T.hav('lat', 'lon', la, lo)} AS km, {T.bearing('lat', 'lon', la, lo)} AS way FROM blown, seg WHERE direction IS NOT NULL"
IMPACT = f"""{_reach}{_tables}, {T.W},
    mem AS (SELECT recent.*, cluster AS event, greatest(1.0, coalesce(frp, 1.0)) AS w FROM recent JOIN lab USING (det)),
    ev AS (SELECT event, count(*) AS n, sum(lat * w) / sum(w) AS lat, sum(lon * w) / sum(w) AS lon, max(frp) AS max_frp, max(ms) AS latest_ms FROM mem GROUP BY event HAVING max(frp) >= {THRESHOLD}),
    mn AS (SELECT mem.det, event, ms, nl.km AS line_km, nl.asset_key, nl.grid_class, nl.mid_lat, nl.mid_lon, ns.km AS sub_km, ns.sub, ns.sub_lat, ns.sub_lon, least(nl.km, ns.km) AS min_km FROM mem LEFT JOIN nl USING (det) LEFT JOIN ns USING (det) WHERE event IN (SELECT event FROM ev)),
    best AS (SELECT * FROM mn QUALIFY row_number() OVER (PARTITION BY event ORDER BY min_km NULLS LAST, ms, det) = 1),
    nls AS (SELECT event, count(DISTINCT lh.asset_key) AS n_lines FROM lh JOIN mn USING (det) WHERE lh.km <= 10 GROUP BY event),
    nss AS (SELECT event, count(DISTINCT sh.sub) AS n_subs FROM sh JOIN mn USING (det) WHERE sh.km <= 10 GROUP BY event),
    air AS (SELECT ev.event, sample, speed, direction FROM ev, wind_ QUALIFY row_number() OVER (PARTITION BY ev.event ORDER BY {T.hav('ev.lat', 'ev.lon', 'wind_.lat', 'wind_.lon')}, sample) = 1),
    blown AS (SELECT ev.*, sample, speed, (direction + 180) % 360 AS direction, CASE WHEN direction IS NOT NULL THEN {_corr} END AS reach FROM ev JOIN air USING (event)),
    sec AS ({_see('a_lat', 'a_lon')} UNION ALL {_see('b_lat', 'b_lon')} UNION ALL {_see('(a_lat + b_lat) / 2', '(a_lon + b_lon) / 2')}),
    dl AS (SELECT event, count(DISTINCT asset_key) AS down_lines FROM sec WHERE {T.off('direction', 'way')} <= 22 AND km <= reach AND km >= 0.05 GROUP BY event),
    ssec AS (SELECT event, sub, direction, reach, {T.hav('blown.lat', 'blown.lon', 'sub_.lat', 'sub_.lon')} AS km, {T.bearing('blown.lat', 'blown.lon', 'sub_.lat', 'sub_.lon')} AS way FROM blown, sub_ WHERE direction IS NOT NULL),
    ds AS (SELECT event, count(DISTINCT sub) AS down_subs FROM ssec WHERE {T.off('direction', 'way')} <= 22 AND km <= reach AND km >= 0.05 GROUP BY event),
    j AS (SELECT blown.*, best.* EXCLUDE (event, det, ms), coalesce(n_lines, 0) AS n_lines, coalesce(n_subs, 0) AS n_subs, coalesce(down_lines, 0) AS down_lines, coalesce(down_subs, 0) AS down_subs, CASE WHEN line_km IS NOT NULL AND (sub_km IS NULL OR line_km <= sub_km) THEN 'line' WHEN sub_km IS NOT NULL THEN 'substation' END AS asset_kind
      FROM blown LEFT JOIN best USING (event) LEFT JOIN nls USING (event) LEFT JOIN nss USING (event) LEFT JOIN dl USING (event) LEFT JOIN ds USING (event)),
    o AS (SELECT *, CASE asset_kind WHEN 'line' THEN CASE WHEN grid_class = '400' THEN 10 ELSE 7 END WHEN 'substation' THEN 10 ELSE 0 END AS asset_score,
      {T.off('direction', T.bearing('lat', 'lon', "CASE WHEN asset_kind = 'line' THEN mid_lat ELSE sub_lat END", "CASE WHEN asset_kind = 'line' THEN mid_lon ELSE sub_lon END"))} AS aside FROM j),
    p AS (SELECT *, CASE WHEN direction IS NULL THEN 0 WHEN aside <= 35 THEN 8 WHEN aside <= 60 THEN 4 WHEN down_lines + down_subs > 0 THEN 3 ELSE 0 END AS wind_score FROM o),
    imp AS (SELECT *, CAST(least(100, greatest(0, floor(CASE WHEN min_km IS NULL THEN 0 ELSE {_steps('min_km', R.DISTANCE_SCORES, 0)} END + least(18.0, sqrt(greatest(0.0, max_frp)) * 2) + {_steps(_age, R.AGE_SCORES, 1)} + asset_score + wind_score + 0.5))) AS INT) AS risk FROM p),
    cand AS (SELECT event, lh.det, min(lh.km) AS km FROM lh JOIN mn USING (det) JOIN best USING (event) WHERE lh.km <= 10 AND lh.asset_key = best.asset_key GROUP BY ALL),
    evi AS (SELECT cand.event, cand.det AS evidence_det, km AS evidence_km FROM cand JOIN mem USING (det) QUALIFY row_number() OVER (PARTITION BY cand.event ORDER BY floor(km * 1000 + 0.5), {_weight} DESC, coalesce(frp, 0) DESC, ms DESC, CAST(cand.det AS VARCHAR)) = 1)"""
_band = "CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 55 THEN 'high' WHEN risk >= 35 THEN 'medium' ELSE 'watch' END"
_prox = f"CASE WHEN min_km IS NOT NULL THEN {_steps('min_km', R.IMPACT_BANDS, 'low')} END"


@BOOK.add(
    "Z2_analyze_events",
    f"WITH RECURSIVE {IMPACT} SELECT event, n, {_q6('lat', 'lat')}, {_q6('lon', 'lon')}, max_frp, {_q6('min_km', 'min_km')}, {_prox} AS band, asset_kind, asset_key AS line, CAST(sub AS VARCHAR) AS sub, n_lines, n_subs, down_lines, down_subs, CAST(reach AS DOUBLE) AS corridor_km, asset_score, wind_score, risk, {_band} AS risk_band, CAST(evidence_det AS VARCHAR) AS evidence_det, {_q6('evidence_km', 'evidence_km')} FROM imp LEFT JOIN evi USING (event)",
)
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = impacts(spark, sf_dir)
    return got.select(
        "event", "n", r6(F.col("lat"), "lat"), r6(F.col("lon"), "lon"), "max_frp", r6(F.col("min_km"), "min_km"), "band", "asset_kind", F.col("line_asset_key").alias("line"), F.col("sub").cast("string").alias("sub"), "n_lines", "n_subs", "down_lines", "down_subs",
        "corridor_km", "asset_score", "wind_score", "risk", "risk_band", F.col("evidence_det").cast("string").alias("evidence_det"), r6(F.col("evidence_km"), "evidence_km"),
    )


@BOOK.add("O1_O4_risk_table", f"WITH RECURSIVE {IMPACT}, t AS (SELECT event, risk, min_km FROM imp WHERE min_km <= 25 ORDER BY risk DESC, min_km, event LIMIT 200) SELECT event, risk, round(min_km, 6) AS min_km FROM t")
def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 by risk, as the table of risks shows them."""
    return risk.ordered(impacts(spark, sf_dir).where("min_km <= 25")).limit(200).select("event", "risk", r6(F.col("min_km"), "min_km"))


@BOOK.add("J12_risky_substations", f"WITH RECURSIVE {IMPACT} SELECT sub, event, risk, round(sub_km, 6) AS sub_km FROM imp WHERE sub_km <= 5 QUALIFY row_number() OVER (PARTITION BY sub ORDER BY risk DESC, event) = 1")
def risky_substations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.risky_substations(impacts(spark, sf_dir)).select("sub", "event", "risk", r6(F.col("sub_km"), "sub_km"))


@BOOK.add(
    "A18_kpis",
    f"WITH RECURSIVE {IMPACT} SELECT count(*) FILTER (risk >= 75) AS critical, count(*) FILTER (risk BETWEEN 55 AND 74) AS high, count(*) FILTER (risk BETWEEN 35 AND 54) AS medium, count(*) FILTER (risk < 35) AS watch, (SELECT count(DISTINCT lh.asset_key) FROM lh JOIN mn USING (det) WHERE lh.km <= 10) AS lines, (SELECT count(DISTINCT sh.sub) FROM sh JOIN mn USING (det) WHERE sh.km <= 10) AS subs, (SELECT count(DISTINCT sec.asset_key) FROM sec JOIN imp USING (event) WHERE imp.risk >= 35 AND {T.off('sec.direction', 'way')} <= 22 AND km <= sec.reach AND km >= 0.05) AS down_lines, (SELECT count(DISTINCT ssec.sub) FROM ssec JOIN imp USING (event) WHERE imp.risk >= 35 AND {T.off('ssec.direction', 'way')} <= 22 AND km <= ssec.reach AND km >= 0.05) AS down_subs FROM imp",
)
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.kpis(impacts(spark, sf_dir))


@BOOK.add("K1_impact_csv", f"WITH RECURSIVE {IMPACT} SELECT concat_ws(',', CAST(event AS VARCHAR), CAST(n AS VARCHAR), coalesce(asset_kind, ''), coalesce(asset_key, ''), CAST(risk AS VARCHAR), {_band}) AS line FROM imp")
def impact_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(impacts(spark, sf_dir).withColumnRenamed("line_asset_key", "line"), ("event", "n", "asset_kind", "line", "risk", "risk_band"))


@BOOK.add("Z1_min_slice", f"WITH {NEAR} SELECT det, frp, round(least(nl.km, ns.km), 6) AS min_km, CASE WHEN least(nl.km, ns.km) IS NOT NULL THEN {_steps('least(nl.km, ns.km)', R.IMPACT_BANDS, 'low')} END AS band FROM recent LEFT JOIN nl USING (det) LEFT JOIN ns USING (det) WHERE frp >= {THRESHOLD}")
def min_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strong recent detection with its nearest asset."""
    strong = T.recent(spark, sf_dir).where(F.col("frp") >= THRESHOLD)
    near = risk.analyze_detections(strong, T.segments(spark, sf_dir), T.substations(spark, sf_dir))
    return strong.select("det", "frp").join(near.select("det", r6(F.col("min_km"), "min_km"), "band"), "det")


_met = f"count(*) AS n, count(*) FILTER (frp >= {THRESHOLD}) AS n_threshold, count(*) FILTER (ms BETWEEN {T.AS_OF_MS - 86_400_000} AND {T.AS_OF_MS}) AS n_visible, max(detected_at) AS latest"


@BOOK.add("A13_A14_metrics", f"WITH {T.D} SELECT product, {_met} FROM det_ GROUP BY product")
def product_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.thermal_metrics(T.detections(spark, sf_dir), F.lit(T.AS_OF_MS), THRESHOLD, ("product",))


@BOOK.add("A16_status_rows", f"WITH {T.D}, m AS (SELECT product, {_met} FROM det_ GROUP BY product), d AS (SELECT * FROM (VALUES ('VIIRS_NOAA20_NRT', 'nasa-firms', false), ('MODIS_NRT', 'nasa-firms', true), ('SLSTR L2P FRP', 'sentinel3a-slstr', false), ('MTG FCI FRP', 'mtg-fci-frp', false), ('VIIRS_SNPP_NRT', 'nasa-firms', false)) v(product, source_id, manual_only)) SELECT product, source_id, coalesce(n, 0) AS n, coalesce(n_visible, 0) AS n_visible, CASE WHEN manual_only THEN 'disabled' WHEN n IS NULL THEN 'idle' ELSE 'ok' END AS status FROM d LEFT JOIN m USING (product)")
def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (("VIIRS_NOAA20_NRT", "nasa-firms", False), ("MODIS_NRT", "nasa-firms", True), ("SLSTR L2P FRP", "sentinel3a-slstr", False), ("MTG FCI FRP", "mtg-fci-frp", False), ("VIIRS_SNPP_NRT", "nasa-firms", False))
    defs = spark.createDataFrame(rows, "product string, source_id string, manual_only boolean")
    m = metrics.thermal_metrics(T.detections(spark, sf_dir), F.lit(T.AS_OF_MS), THRESHOLD, ("product",))
    return metrics.status_rows(defs, m).fillna(0).select("product", "source_id", "n", "n_visible", "status")


@BOOK.add("A33_next_status", "SELECT event_id, CASE WHEN user_id % 3 = 0 AND event_type IN ('view', 'click') THEN 'stale' WHEN user_id % 3 = 0 THEN 'error' WHEN user_id % 3 = 1 THEN 'empty' ELSE 'ok' END AS status FROM events")
def next_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "stale").otherwise("loading")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", metrics.next_status(before, F.col("user_id") % 3 == 0, F.when(F.col("user_id") % 3 == 1, 0).otherwise(5)).alias("status"))


_bucket = f"least(11, CAST(floor((ms - {T.AS_OF_MS - 172_800_000}) / 172800000.0 * 12) AS INT))"


@BOOK.add("W1_W3_sparkline", f"WITH {T.D}, b AS (SELECT *, {_bucket} AS bucket FROM det_ WHERE frp >= 5 AND ms BETWEEN {T.AS_OF_MS - 172_800_000} AND {T.AS_OF_MS}) SELECT product, bucket, det, frp, ms FROM b QUALIFY row_number() OVER (PARTITION BY product, bucket ORDER BY frp DESC, ms, det) = 1")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.peaks(T.detections(spark, sf_dir), F.lit(T.AS_OF_MS), 12, by=("product",))


@BOOK.add("W2_event_sparkline", f"WITH {T.D}, {T.B}, n AS (SELECT sub, det_.*, {T.hav('sub_.lat', 'sub_.lon', 'det_.lat', 'det_.lon')} AS km FROM sub_, det_ WHERE frp >= 5 AND ms BETWEEN {T.AS_OF_MS - 172_800_000} AND {T.AS_OF_MS}), b AS (SELECT *, {_bucket} AS bucket FROM n WHERE km <= 10) SELECT sub, bucket, det, frp, ms FROM b QUALIFY row_number() OVER (PARTITION BY sub, bucket ORDER BY frp DESC, ms, det) = 1")
def event_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks around each place by the radius join."""
    near = spatial.point_hits(T.detections(spark, sf_dir), T.substations(spark, sf_dir), 10.0).select("det", "sub")
    rows = near.join(T.detections(spark, sf_dir).select("det", "frp", "ms"), "det")
    return windows.peaks(rows, F.lit(T.AS_OF_MS), 12, by=("sub",))


@BOOK.add("W4_heat_p95", f"WITH {T.D}, s AS (SELECT frp, row_number() OVER (ORDER BY frp) - 1 AS i, count(*) OVER () AS n FROM det_ WHERE frp IS NOT NULL) SELECT max(n) AS n, max(frp) AS value FROM s WHERE i = CAST(floor(0.95 * n) AS BIGINT)")
def heat_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.value_at_rank(T.detections(spark, sf_dir), "frp", 0.95)


_path = REACH


@BOOK.add("W5_event_paths", f"WITH RECURSIVE {_path}, m AS (SELECT det_.*, cluster AS event FROM det_ JOIN lab USING (det)) SELECT event, count(*) AS n, arg_min(det, (ms, det)) AS first_det, arg_max(det, (ms, det)) AS last_det, string_agg(CAST(det AS VARCHAR), '>' ORDER BY ms, det) AS path FROM m GROUP BY event HAVING count(*) >= 2")
def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.paths(clusters.cluster(T.detections(spark, sf_dir)).withColumnRenamed("cluster", "event"))


@BOOK.add("W6_decimate", f"WITH {T.B} SELECT min(sub) AS sub, count(*) AS n, CAST(floor(lon / 0.25) AS BIGINT) AS cx, CAST(floor(lat / 0.25) AS BIGINT) AS cy FROM sub_ GROUP BY cx, cy")
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.one_a_cell(T.substations(spark, sf_dir), 0.25)


@BOOK.add("W7_wind_arrows", f"WITH {T.W}, s AS (SELECT *, row_number() OVER (ORDER BY lat, lon, sample) - 1 AS pos FROM wind_) SELECT sample, speed, direction FROM s WHERE pos % CAST(ceil(25 / 12.0) AS BIGINT) = 0 ORDER BY pos LIMIT 12")
def wind_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.thin(T.wind(spark, sf_dir), 12).select("sample", "speed", "direction")


@BOOK.add("O5_in_view_top", f"WITH {T.D} SELECT det, frp FROM det_ WHERE lat BETWEEN 37.5 AND 38.5 AND (frp IS NULL OR frp >= 30) ORDER BY abs(frp) DESC, det LIMIT 5000")
def in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest 5000 in view."""
    return T.detections(spark, sf_dir).where("lat BETWEEN 37.5 AND 38.5 AND (frp IS NULL OR frp >= 30)").orderBy(F.desc(F.abs("frp")), "det").limit(5000).select("det", "frp")


@BOOK.add("A19_A31_A32_environment", f"WITH {T.R}, {T.W} SELECT (SELECT count(*) FROM recent) AS visible, (SELECT count(frp) FROM recent) AS with_frp, (SELECT max(speed) FROM wind_) AS max_wind, (SELECT arg_max(sample, speed) FROM wind_) AS windiest")
def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = T.recent(spark, sf_dir).agg(F.count(F.lit(1)).alias("visible"), F.count("frp").alias("with_frp"))
    return seen.crossJoin(T.wind(spark, sf_dir).agg(F.max("speed").alias("max_wind"), F.max_by("sample", "speed").alias("windiest")))


@BOOK.add("J11_evidence_exists", f"WITH {T.ALL}, {T.S} SELECT DISTINCT asset_key FROM seg WHERE EXISTS (SELECT 1 FROM recent WHERE recent.det % 3 = 0 AND recent.det * 7 % 4001 = seg.sid)")
def evidence_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that one of a family's detections names: a semi-join on keys."""
    named = T.detections(spark, sf_dir).where("det % 3 = 0").select((F.col("det") * 7 % 4001).alias("sid"))
    return T.segments(spark, sf_dir).join(named, "sid", "left_semi").select("asset_key").distinct()


@BOOK.add("M10_centre_shift", f"WITH {T.ALL} SELECT det, {T.hav('lat', 'lon', '37.9e0', '29.5e0')} > 2 AS shifted FROM recent")
def centre_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the place more than two kilometres from a centre (the warning beside evidence)."""
    return T.detections(spark, sf_dir).select("det", (haversine_km(F.col("lat"), F.col("lon"), F.lit(37.9), F.lit(29.5)) > 2).alias("shifted"))
