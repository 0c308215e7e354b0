"""Queries of sources that are written and read again, exports, asset steps, and how values are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.functions import display, voltage
from emberfold.operators import assets, association, clusters, exports, grid_etl, spatial
from emberfold.operators import detections as dets
from emberfold.plans import impact
from emberfold.plans import tables as T
from emberfold.plans.grid import _lines, FEAT, _features
from emberfold.runtime import settle, shared_folder
from emberfold.sources import feeds, grid, registry, sinks
from emberfold.streaming import detections as streams

BOOK = T.Book()
r6 = lambda c, name: F.round(c, 6).alias(name)
_q6 = lambda x, name: f"round({x}, 6) AS {name}"
_up = lambda x, d: f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"
_clamp = lambda x, a, b: f"least({b}e0, greatest({a}e0, {x}))"
_steps = lambda x, steps, rest: "CASE " + " ".join(f"WHEN {x} >= {a} THEN {b}" for a, b in steps) + f" ELSE {rest} END"

VARIABLE = "CASE det % 3 WHEN 0 THEN 'pm10_wildfires' WHEN 1 THEN 'wildfire_share' ELSE 'other' END"
LEVEL = "CASE det % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'watch' WHEN 4 THEN 'low' ELSE 'x' END"
_rgb = lambda c: "'" + ",".join(map(str, c)) + "'"
_smoke = " ".join(f"WHEN '{k}' THEN {_steps('frp / 4', [(a, _rgb(c)) for a, c in steps], _rgb(rest))}" for k, (steps, rest) in display.SMOKE_COLOURS.items())
_root = "sqrt(greatest(0, frp))"


@BOOK.add(
    "M19_M20_display",
    f"WITH {T.D}, d AS (SELECT *, {VARIABLE} AS variable, {LEVEL} AS level FROM det_) SELECT det, {_steps('frp', [(a, repr(c)) for a, c in display.FRP_COLOURS], repr(display.FRP_REST))} AS colour, CASE variable {_smoke} ELSE {_rgb(display.SMOKE_REST)} END AS smoke, "
    f"round(CASE variable WHEN 'pm10_wildfires' THEN CASE WHEN frp / 4 <= 0 THEN 0 ELSE {_clamp('0.12 + ln(1 + frp / 4) / 4', 0.16, 0.72)} END WHEN 'wildfire_share' THEN CASE WHEN frp / 4 <= 0 THEN 0 ELSE {_clamp('0.1 + frp / 4 / 145', 0.12, 0.68)} END ELSE CASE WHEN frp / 4 <= 0.02 THEN 0 ELSE {_clamp('0.1 + frp / 4 * 0.42', 0.12, 0.58)} END END, 6) AS opacity, "
    f"CASE level {' '.join(f"WHEN '{k}' THEN '{c}'" for k, c in display.RISK_COLOURS.items())} ELSE '#8a9aaa' END AS risk, {_q6(f"CASE family WHEN 'slstr' THEN {_clamp(f'4 + {_root} * 0.8', 4, 14)} WHEN 'mtg' THEN {_clamp(f'4 + {_root} * 0.7', 4, 13)} ELSE {_clamp(f'4 + {_root} * 1.05', 4, 17)} END", 'mark')}, "
    f"{_clamp('6 + det % 12 * 2', 8, 26)} AS confirmed, {_q6(_clamp('7 + (100 - det % 101) * -0.015e0 + det % 40 * 0.25e0', 7, 15), 'risk_mark')} FROM d",
)
def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, frp = F.col("det"), F.col("frp")
    rows = T.detections(spark, sf_dir).withColumns({"variable": F.expr(VARIABLE), "level": F.expr(LEVEL)})
    return rows.select(
        "det", display.frp_colour(frp).alias("colour"), F.array_join(display.smoke_colour(F.col("variable"), frp / 4), ",").alias("smoke"), r6(display.smoke_opacity(F.col("variable"), frp / 4), "opacity"),
        display.risk_colour(F.col("level")).alias("risk"), r6(display.mark_radius(F.col("family"), frp), "mark"), display.confirmed_radius(det % 12).alias("confirmed"), r6(display.risk_radius(det % 101, det % 40), "risk_mark"),
    )


_ti4, _ti5 = "CASE WHEN det % 4 > 0 THEN 290e0 + det % 90 END", "CASE WHEN det % 20 > 0 THEN 280e0 + det % 100 END"
_most = f"greatest(coalesce({_ti4}, 0), coalesce({_ti5}, 0))"
_way, _spd = "CASE WHEN det % 7 > 0 THEN (det % 360) * 1e0 END", "CASE WHEN det % 5 > 0 THEN (det % 70) * 1e0 END"
_dist = f"({_clamp(f'{_spd} * 0.7', 12, 45)} / 6371)"
_dw = f"radians(({_way} + 180) % 360)"
_elat = f"degrees(asin(sin(radians(lat)) * cos({_dist}) + cos(radians(lat)) * sin({_dist}) * cos({_dw})))"


@BOOK.add(
    "M22_M24_M26_marks",
    f"WITH {T.D} SELECT det, CASE WHEN {_most} <= 0 THEN NULL WHEN {_most} > 360 THEN 30e0 WHEN {_most} > 320 THEN 15e0 ELSE 0e0 END AS hue, round(CASE WHEN {_most} > 0 THEN {_clamp(f'55 + ({_most} - 300) * 0.3', 35, 75)} END, 6) AS light, "
    f"{_q6(f'CASE WHEN {_way} IS NOT NULL AND {_spd} IS NOT NULL THEN {_elat} END', 'end_lat')}, {_q6(f'CASE WHEN {_way} IS NOT NULL AND {_spd} IS NOT NULL THEN lon + degrees(atan2(sin({_dw}) * sin({_dist}) * cos(radians(lat)), cos({_dist}) - sin(radians(lat)) * sin(radians({_elat})))) END', 'end_lon')}, "
    f"{_q6(_clamp('sqrt(1000e0 * (600 + det % 100) / greatest(1, det % 50)) * 1.55', 64, 170), 'field')} FROM det_",
)
def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = F.col("det")
    hue, light = display.envelope(F.expr(_ti4), F.expr(_ti5))
    to = display.wind_arrow_end(F.col("lat"), F.col("lon"), F.expr(_way), F.expr(_spd))
    return T.detections(spark, sf_dir).select("det", hue.cast("double").alias("hue"), r6(light, "light"), r6(to[0], "end_lat"), r6(to[1], "end_lon"), r6(display.field_radius(F.lit(1000), 600 + det % 100, det % 50), "field"))


_age_min = "(det % 400) / 4e0"


@BOOK.add(
    "T2_T5_T7_T9_clock",
    f"WITH {T.D} SELECT det, strftime(detected_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, concat('TR:', strftime(detected_at - INTERVAL 24 HOURS, '%Y-%m-%dT%H:%M:%S.%gZ'), ':', strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%gZ')) AS window_key, "
    f"CASE WHEN det % 3 = 0 OR det % 8 = 5 THEN {T.AS_OF_MS} ELSE least(ms, {T.AS_OF_MS} + 900000) END AS reference_ms, date_trunc(CASE WHEN det % 2 = 0 THEN 'minute' ELSE 'hour' END, detected_at + to_hours(CAST(det % 5 - 2 AS INT))) AS snapped, "
    f"CASE WHEN {_age_min} > 60 THEN 'old' WHEN {_age_min} > 25 THEN 'delayed' ELSE 'live' END AS age_name, CASE WHEN {_age_min} < 60 THEN CAST(CAST(floor({_age_min}) AS BIGINT) AS VARCHAR) ELSE concat(CAST(floor({_age_min} / 60) AS BIGINT), ':', lpad(CAST(CAST(floor({_age_min} % 60) AS BIGINT) AS VARCHAR), 2, '0')) END AS age FROM det_",
)
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, at = F.col("det"), F.col("detected_at")
    name, age = display.imagery_age((det % 400) / 4.0)
    chosen = F.when(det % 8 != 5, F.col("ms"))
    return T.detections(spark, sf_dir).select(
        "det", display.iso_utc(at).alias("iso"), display.window_key(F.lit("TR"), at).alias("window_key"), display.time_reference(chosen, det % 3, F.lit(T.AS_OF_MS)).alias("reference_ms"),
        display.snapped(at, (det % 5 - 2).cast("int"), det % 2 == 0).cast("timestamp_ntz").alias("snapped"), name.alias("age_name"), age.alias("age"),
    )


_state = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(display.STATES)) + " WHEN 10 THEN 'odd' END"
_code = "CASE event_id % 5 WHEN 0 THEN ' es ' WHEN 1 THEN 'FR' WHEN 2 THEN 'xx' WHEN 3 THEN 'Gr' END"
_two = lambda x: f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST(CAST(floor(abs({x}) * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR), '.', lpad(CAST(CAST(floor(abs({x}) * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"


@BOOK.add(
    "F18_S51_C5_names",
    f"WITH {T.D}, s AS (SELECT event_id, {_state} AS state, {_code} AS code FROM events) SELECT event_id, CASE WHEN state = 'ok' THEN 'status-ok' WHEN state = 'error' THEN 'status-bad' WHEN state IN ('warn', 'partial', 'stale', 'unavailable') THEN 'status-warn' ELSE 'status-idle' END AS class, "
    f"CASE WHEN state IN {display.STATES} THEN state ELSE 'idle' END AS name, CASE WHEN upper(trim(code)) IN ('TR', 'ES', 'FR', 'GR') THEN upper(trim(code)) ELSE 'TR' END AS country, concat({_two('lat')}, ',', {_two('-lon')}, ';', {_two('lat - 37')}, ',', {_two('lon')}) AS places FROM s JOIN det_ ON det = event_id",
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_state} AS state", f"{_code} AS code", f"{T.LAT} AS lat", f"{T.LON} AS lon")
    at = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    return rows.select("event_id", display.state_class(F.col("state")).alias("class"), display.state_name(F.col("state")).alias("name"), display.known_country(F.col("code"), ("TR", "ES", "FR", "GR")).alias("country"), display.places_key(F.array(at(lat, -lon), at(lat - 37, lon))).alias("places"))


@BOOK.add("P9_threshold", f"WITH {T.D}, d AS (SELECT det, CASE WHEN det % 6 > 0 THEN frp END AS frp FROM det_) SELECT det, frp FROM d WHERE frp >= 30")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.detections(spark, sf_dir).withColumn("frp", F.when(F.col("det") % 6 > 0, F.col("frp")))
    return dets.at_least(rows, 30.0, unknown=False).select("det", "frp")


@BOOK.add("V6_shown_voltage", f"WITH {T.F_}, n AS (SELECT seq, voltage, list_max(list_filter(list_transform(regexp_extract_all(coalesce(voltage, ''), '(?:^|[^\\w.])(-?\\d+(?:[.,]\\d+)?)', 1), lambda t: CAST(replace(t, ',', '.') AS DOUBLE)), lambda v: v > 0)) AS m FROM feat), v AS (SELECT seq, CASE WHEN regexp_full_match(voltage, '\\s*\\d+(\\.\\d+)?\\s*') AND TRY_CAST(voltage AS DOUBLE) > 0 THEN CAST(voltage AS DOUBLE) WHEN m > 10000 THEN m / 1000 ELSE m END AS v FROM n) SELECT seq, CASE WHEN v % 1 = 0 THEN concat(CAST(CAST(v AS BIGINT) AS VARCHAR), ' kV') WHEN v IS NOT NULL THEN concat(format('{{:.2f}}', v), ' kV') END AS shown FROM v")
def shown_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.features(spark, sf_dir).select("seq", voltage.shown_voltage(F.col("voltage")).alias("shown"))


@BOOK.add(
    "F8_F9_F14_keys",
    f"WITH {T.F_} SELECT seq, coalesce(CASE WHEN seq % 4 = 0 THEN concat('asset-', seq) END, concat('line:', coalesce(osm_id, nullif(trim(name), ''), concat('[\"', CAST(seq % 9 * 50e0 AS VARCHAR), '\",\"', seq % 3, '\"]')))) AS asset_key, CASE WHEN seq % 6 = 1 THEN concat('n', seq) ELSE concat_ws('|', osm_version, '', coalesce(name, ''), coalesce(osm_timestamp, ''), CAST(seq % 90 AS VARCHAR), CAST(seq % 180 AS VARCHAR)) END AS detection_id, coalesce(nullif(trim(name), ''), nullif(trim(ref), ''), 'unnamed') AS label FROM feat",
)
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    rows = T.features(spark, sf_dir).withColumn("label", F.lit(None).cast("string"))
    key = assets.asset_key(F.when(seq % 4 == 0, F.concat(F.lit("asset-"), seq)), F.col("osm_id"), F.col("name"), (seq % 9 * 50).cast("double"), (seq % 3).cast("string"))
    own = rows.select("*", key.alias("asset_key"))
    ids = own.select("seq", "asset_key", assets.asset_label().alias("label"), F.when(seq % 6 == 1, F.concat(F.lit("n"), seq)).alias("native_id"), F.col("osm_version").alias("satellite"), F.col("name").alias("product"), F.col("osm_timestamp").alias("detected_at"), (seq % 90).alias("lat"), (seq % 180).alias("lon"))
    return ids.select("seq", "asset_key", assets.detection_id(ids).alias("detection_id"), "label")


@BOOK.add("F12_F13_downloads", "WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS p, s_suppkey % 7 AS f, CASE WHEN s_suppkey % 2 = 0 THEN 'ArcGIS OSM Europe' ELSE 'Overpass API' END AS provider FROM supplier) SELECT CAST(k AS VARCHAR) AS country, CASE WHEN k % 5 > 0 THEN p ELSE k % 4 = 0 END AS partial, CASE WHEN k % 5 > 0 THEN f ELSE 9 END AS failed FROM s WHERE contains(lower(provider), 'arcgis')")
def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("string").alias("country"), F.when(k % 2 == 0, "ArcGIS OSM Europe").otherwise("Overpass API").alias("provider"), F.when(k % 5 > 0, F.struct((k % 3 == 0).alias("partial"), (k % 7).alias("failedRequests"))).alias("diagnostics"), (k % 4 == 0).alias("partial"), F.lit(9).cast("long").alias("failedRequests"))
    return assets.download_state(assets.of_provider(rows, "ARCGIS"))


_pt = lambda dx, dy: f"[lon + {dx}, lat + {dy}]"


@BOOK.add(
    "X4_X6_P16_line_parts",
    f"WITH {T.B}, p AS (SELECT sub, [[{_pt(0, 0)}, {_pt('0.4e0', 0)}], [{_pt(0, 0)}, {_pt(0, 0)}], [{_pt(9, 9)}, {_pt(9, '9.5e0')}]] AS parts FROM sub_), f AS (SELECT sub, unnest(list_filter(CASE WHEN sub % 3 = 0 THEN parts[1:2] ELSE parts END, lambda q: q[1] <> q[2])) AS q, generate_subscripts(list_filter(CASE WHEN sub % 3 = 0 THEN parts[1:2] ELSE parts END, lambda q: q[1] <> q[2]), 1) AS i FROM p), "
    f"g AS (SELECT sub, i, q, count(*) OVER (PARTITION BY sub) AS n FROM f), h AS (SELECT *, q[1][1] AS x1, q[1][2] AS y1, q[2][1] AS x2, q[2][2] AS y2 FROM g) SELECT CASE WHEN n > 1 THEN concat('line-', sub, '-', i) ELSE concat('line-', sub) END AS asset_id, round(x1, 6) AS lon, {T.inside().replace('lat', 'y1').replace('lon', 'x1')} OR {T.inside().replace('lat', 'y2').replace('lon', 'x2')} AS inside FROM h",
)
def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda dx, dy: F.array(F.col("lon") + dx, F.col("lat") + dy)
    parts = F.array(F.array(p(0, 0), p(0.4, 0)), F.array(p(0, 0), p(0, 0)), F.array(p(9, 9), p(9, 9.5)))
    lines = T.substations(spark, sf_dir).select(F.concat(F.lit("line-"), F.col("sub")).alias("asset_id"), F.when(F.col("sub") % 3 == 0, F.slice(parts, 1, 2)).otherwise(parts).alias("parts"))
    return assets.line_parts(lines).select("asset_id", r6(F.get(F.get("points", F.lit(0)), F.lit(0)), "lon"), assets.any_vertex_inside(F.col("points"), T.REGION).alias("inside"))


@BOOK.add("A29_violations", f"WITH {FEAT}, l AS (SELECT CASE WHEN seq % 90 > 0 THEN CAST(seq % 1900 AS VARCHAR) END AS id, seq % 50 = 0 AS es, kv, CASE WHEN kv >= 300 OR seq % 70 = 0 THEN '400' ELSE '154' END AS c, {T.ring(T.REGION[0])} AS inside, seq % 80 = 0 AS odd FROM f WHERE kv >= 50) SELECT count(*) FILTER (id IS NULL) AS nameless, count(id) - count(DISTINCT id) AS repeated, count(*) FILTER (es) AS foreign_rows, count(*) FILTER (NOT coalesce(c = CASE WHEN kv BETWEEN 300 AND 550 THEN '400' WHEN kv < 300 THEN '154' END, false)) AS misclassed, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (odd) AS unlabelled FROM l")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, kv = F.col("seq"), F.col("kv")
    layer = _features(spark, sf_dir).where(kv >= 50).select(F.when(seq % 90 > 0, (seq % 1900).cast("string")).alias("asset_id"), F.when(seq % 50 == 0, "ES").otherwise("TR").alias("country"), F.when((kv >= 300) | (seq % 70 == 0), "400").otherwise("154").alias("grid_class"), "kv", "lat", "lon", F.when(seq % 80 == 0, "odd").otherwise("osm-name").alias("label_source"))
    return assets.violations(layer, "TR", T.REGION[:1]).withColumnRenamed("foreign", "foreign_rows")


# files that are written here and read by the library's own readers


def _stored_archive(spark: SparkSession, sf_dir: str) -> str:
    """The events as the archive's CSV files."""
    at = F.col("detected_at")
    text = {"latitude": F.when(F.col("det") % 40 == 3, "x").otherwise(F.col("lat").cast("string")), "longitude": F.col("lon").cast("string"), "scan": F.lit("0.5"), "track": F.lit("0.4"), "acq_date": F.date_format(at, "yyyy-MM-dd"), "acq_time": F.date_format(at, "HHmm"), "satellite": F.col("satellite"), "instrument": F.lit("VIIRS"), "confidence": F.col("confidence"), "frp": F.col("frp").cast("string"), "daynight": F.lit("D")}
    folder = shared_folder(spark, "archive")
    T.detections(spark, sf_dir).select(*[text.get(c, F.lit("")).alias(c) for c in feeds.ARCHIVE]).write.option("header", True).csv(folder)
    return folder


_minute = "date_trunc('minute', detected_at)"
_arch = f"SELECT lat, lon, frp, coalesce(confidence, '') AS confidence, satellite, {_minute} AS detected_at FROM det_ WHERE det % 40 <> 3 AND {T.inside()}"


@BOOK.add("S1_S12_archive", f"WITH {T.D} SELECT 'P' AS product, 'nasa-firms' AS source_id, a.* FROM ({_arch}) a")
def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.load_archive(spark, _stored_archive(spark, sf_dir), "P", "TR", T.REGION)
    return rows.select("product", "source_id", "lat", "lon", "frp", F.coalesce("confidence", F.lit("")).alias("confidence"), "satellite", "detected_at")


_p4 = lambda c: f"floor({c} * 10000 + 0.5) / 10000e0"


@BOOK.add("S2_S3_S4_products", f"WITH {T.D}, a AS ({_arch}) SELECT product, satellite, detected_at, round({_p4('lat')}, 4) AS lat4, round({_p4('lon')}, 4) AS lon4, max(frp) AS frp FROM a, (VALUES ('{feeds.PRODUCTS[0]}'), ('{feeds.PRODUCTS[1]}')) v(product) GROUP BY ALL")
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_archive(spark, sf_dir)
    load = lambda p: lambda: feeds.load_archive(spark, path, p, "TR", T.REGION)

    def down() -> DataFrame:
        raise OSError("not there")

    out, _, _ = feeds.load_all({p: load(p) for p in feeds.PRODUCTS[:2]} | {feeds.PRODUCTS[2]: down})
    four = lambda c: F.round(F.floor(F.col(c) * 10_000 + 0.5) / 10_000.0, 4)
    return out.select("product", "satellite", "detected_at", four("lat").alias("lat4"), four("lon").alias("lon4"), "frp")


@BOOK.add("U1_A33_load_counts", f"WITH {T.D}, a AS ({_arch}) SELECT 'nasa-firms' AS source_id, count(*) AS valid, count(DISTINCT (satellite, detected_at, {_p4('lat')}, {_p4('lon')})) AS deduplicated FROM a")
def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.load_counts(feeds.load_archive(spark, _stored_archive(spark, sf_dir), "P", "TR", T.REGION))


#: Features of a stored page at most.
PAGE = 20_000


@BOOK.add("S8_S10_S11_fire_power", f"WITH {T.D} SELECT DISTINCT det % 40 AS fid, 'MTG FCI FRP' AS product, 'mtg-fci-frp' AS source_id, round(37.5e0 + det % 40 / 1e2, 6) AS lat, round(29.8e0 + det % 40 / 1e2, 6) AS lon, det % 40 * 2.5e0 AS frp, TIMESTAMP '2024-01-15 10:00:00' + to_minutes(CAST(det % 40 AS INT)) AS detected_at FROM det_ WHERE det % 40 <> 7")
def fire_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of features, in which features repeat and one has no geometry."""
    k = F.col("det") % 40
    at = F.date_format(F.lit("2024-01-15 10:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.struct(F.lit("Point").alias("type"), F.array(29.8 + k / 100.0, 37.5 + k / 100.0).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), k.cast("string").alias("id"), F.when(k != 7, place).alias("geometry"), F.struct((k * 2.5).alias("FRP"), at.alias("time"), F.lit("MTI1").alias("Satellite")).alias("properties"))
    # more detections make more pages, not larger ones
    page = F.col("det") % 8 + 8 * F.floor(F.col("det") / (8 * PAGE))
    pages = T.detections(spark, sf_dir).groupBy(page.alias("page")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(one).alias("features"))).alias("doc"))
    folder = shared_folder(spark, "pages")
    pages.write.partitionBy("page").text(folder)
    rows = feeds.load_fire_power(spark, folder, "mtg-fci-frp", "MTG FCI FRP", "TR", T.REGION)
    return rows.select(F.round(F.col("frp") / 2.5).cast("long").alias("fid"), "product", "source_id", r6(F.col("lat"), "lat"), r6(F.col("lon"), "lon"), "frp", "detected_at")


@BOOK.add(
    "S10_S14_S15_S18_polar",
    f"WITH {T.D} SELECT CASE WHEN det % 2 = 0 THEN 'sentinel3a-slstr' ELSE 'sentinel3b-slstr' END AS source_id, CASE WHEN det % 2 = 0 THEN 'S3A' ELSE 'S3B' END AS satellite, round(lat, 6) AS lat, round(lon, 6) AS lon, frp, date_trunc('second', detected_at) AS detected_at FROM det_ WHERE det % 3 = 1 AND {T.inside()}",
)
def polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages of both polar satellites, each feature in two pages: valid ones once, under their satellite's own source."""
    at = F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    name = F.when(F.col("det") % 2 == 0, "S3A").otherwise("S3B")
    told = F.struct(F.col("frp").alias("FRP"), F.col("lat").alias("Lat"), F.col("lon").alias("Lon"), at.alias("Datetime"), name.alias("Satellite"), (300 + F.col("det") % 90).alias("BT_mir_k"))
    one = F.struct(F.lit("Feature").alias("type"), F.concat(F.lit("f."), F.col("det").cast("string")).alias("id"), place.alias("geometry"), told.alias("properties"))
    rows = T.detections(spark, sf_dir).where("det % 3 = 1").select(one.alias("one"), F.explode(F.array(F.col("det") % 64, (F.col("det") + 1) % 64)).alias("page"))
    pages = rows.groupBy("page").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("one").alias("features"))).alias("doc"))
    folder = shared_folder(spark, "pages")
    pages.write.partitionBy("page").text(folder)
    got = feeds.by_satellite(feeds.load_fire_power(spark, folder, "sentinel3a-slstr", "SLSTR L2P FRP", "TR", T.REGION))
    return got.select("source_id", "satellite", r6(F.col("lat"), "lat"), r6(F.col("lon"), "lon"), "frp", "detected_at")


@BOOK.add("S16_S17_registry", "SELECT mode, source, count(*) AS n FROM (VALUES ('FIRMS_ONLY', 'nasa-firms'), ('MULTI_SOURCE', 'nasa-firms'), ('MULTI_SOURCE', 'mtg-fci-frp')) v(mode, source) JOIN events ON CASE source WHEN 'nasa-firms' THEN event_id % 3 = 0 ELSE event_id % 3 = 2 END GROUP BY ALL")
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = registry.Registry()
    for name, k in (("nasa-firms", 0), ("mtg-fci-frp", 2), ("msg-seviri-frp", 1)):
        every.register(name, lambda name=name, k=k: T.detections(spark, sf_dir).where(F.col("det") % 3 == k).select(F.lit(name).alias("source"), "det"))

    def down() -> DataFrame:
        raise OSError("not there")

    every.register("sentinel3a-slstr", down)
    out = None
    for mode in ("FIRMS_ONLY", "MULTI_SOURCE"):
        got = every.load(mode)[0].groupBy(F.lit(mode).alias("mode"), "source").agg(F.count(F.lit(1)).alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


@BOOK.add("S18_states", "WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'loading' ELSE 'stale' END AS st FROM supplier) SELECT id AS source_id, CASE WHEN k % 5 > 0 AND k % 9 > 3 THEN k % 9 ELSE 3 END AS seq, CASE WHEN k % 5 > 0 AND k % 9 > 3 THEN CASE WHEN k % 2 = 0 AND st <> 'loading' THEN 'stale' WHEN k % 2 = 0 THEN 'error' WHEN k % 4 = 1 THEN 'empty' ELSE 'ok' END ELSE st END AS status FROM s")
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    before = rows.select(k.cast("string").alias("source_id"), F.lit(3).cast("long").alias("seq"), F.when(k % 3 == 0, "ok").when(k % 3 == 1, "loading").otherwise("stale").alias("status"))
    loads = rows.where(k % 5 > 0).select(k.cast("string").alias("source_id"), (k % 9).alias("seq"), (k % 2 == 0).alias("failed"), F.when(k % 4 == 1, 0).otherwise(5).alias("n"))
    return feeds.update_states(before, loads)


_layer = f"CASE WHEN power = 'substation' THEN 'substations' WHEN kv BETWEEN 300 AND 550 THEN '400' ELSE '154' END"


@BOOK.add("K7_S24_S25_A20_layers", f"WITH {FEAT} SELECT {_layer} AS layer, count(*) AS n, max(seq) AS last FROM f WHERE reason = 'accepted' AND seq % 4 > 0 AND {_layer} <> '154' GROUP BY 1")
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of two countries are written; two layers of one are read again."""
    rows = _features(spark, sf_dir).where("reason = 'accepted'").select("seq", F.when(F.col("seq") % 4 > 0, "TR").otherwise("GR").alias("country"), F.expr(_layer).alias("layer"))
    folder = shared_folder(spark, "layers")
    sinks.write_layers(rows, folder)
    got = grid.read_layer(spark, folder, "TR", ("400", "substations"))
    return grid.layer_stats(got).join(got.groupBy("layer").agg(F.max("seq").alias("last")), "layer")


@BOOK.add("S39_S40_boundaries", "WITH p AS (SELECT n_nationkey AS part, CASE n_nationkey % 4 WHEN 0 THEN 'EL' WHEN 1 THEN 'FR' ELSE 'PT' END AS code, n_nationkey - 20e0 AS w, 30e0 + n_nationkey AS s FROM nation) SELECT CASE code WHEN 'EL' THEN 'GR' ELSE code END AS country, part, w, s FROM p WHERE code <> 'PT' OR (w > -10.5 AND s > 35.5)")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    w, s = k - 20.0, 30.0 + k
    p = lambda a, b: F.array(w + a, s + b)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("part"), F.when(k % 4 == 0, "EL").when(k % 4 == 1, "FR").otherwise("PT").alias("code"), F.array(p(1, 1), p(0, 1), p(0, 0), p(1, 0), p(1, 1)).alias("ring"))
    low = lambda i: F.array_min(F.transform("ring", lambda q: F.get(q, F.lit(i))))
    return grid.boundaries(rows).select("country", "part", low(0).alias("w"), low(1).alias("s"))


@BOOK.add("K9_K10_A30_sizes", "SELECT country, 1 AS files, true AS some FROM (VALUES ('TR'), ('GR')) v(country)")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "published")
    for c, k in (("TR", 0), ("GR", 1)):
        T.features(spark, sf_dir).where(F.col("seq") % 2 == k).select("seq", "name").coalesce(1).write.parquet(f"{folder}/{c}")
    return grid.file_sizes(spark, folder).select("country", F.col("files").cast("int").alias("files"), (F.col("bytes") > 0).alias("some"))


# exports


def _country() -> str:
    return "CASE WHEN event % 4 = 0 THEN 'GR' ELSE 'TR' END"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settle(impact.impacts(spark, sf_dir)).withColumn("country", F.expr(_country()))
    rows = T.recent(spark, sf_dir).withColumns({"source": F.col("source_id"), "sensor": F.upper("family")})
    return exports.with_evidence(found, rows, T.segments(spark, sf_dir))


ASSETS = ("concat('line-', CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING)) AS asset_key", "CASE WHEN p_partkey % 3 = 0 THEN 380e0 ELSE 154e0 END AS kv", "p_name AS label")
EVIDENCE = f"""{impact.IMPACT},
    near_ AS (SELECT evi.event, arg_min(lh.near_lat, (lh.km, lh.sid)) AS nlat, arg_min(lh.near_lon, (lh.km, lh.sid)) AS nlon FROM evi JOIN best USING (event) JOIN lh ON lh.det = evi.evidence_det AND lh.asset_key = best.asset_key GROUP BY evi.event),
    told AS (SELECT imp.*, {_country()} AS country, {impact._band} AS level, evidence_det, evidence_km, nlat, nlon, t.source_id AS t_source, t.satellite AS t_satellite, upper(t.family) AS t_sensor, t.product AS t_product, t.detected_at AS t_at, t.frp AS t_frp, t.confidence AS t_confidence, t.lat AS t_lat, t.lon AS t_lon, l.latest
      FROM imp LEFT JOIN evi USING (event) LEFT JOIN near_ USING (event) LEFT JOIN recent t ON t.det = evidence_det LEFT JOIN (SELECT event, max(detected_at) AS latest FROM mem GROUP BY event) l USING (event)),
    ast AS (SELECT asset_key, max(kv) AS kv, min(label) AS label FROM (SELECT {', '.join(ASSETS)} FROM part) GROUP BY asset_key)"""
_has = lambda x: f"CASE WHEN evidence_det IS NOT NULL THEN {x} END"
_line = lambda x: f"CASE WHEN asset_key IS NOT NULL THEN {x} END"
_slow = "direction IS NOT NULL AND speed IS NULL"
_cells = {
    "countryCode": "'TR'", "countryName": "'Country'", "eventId": "event", "latestDetectedAt": "latest", "lat": "round(lat, 6)", "lon": "round(lon, 6)", "hotspotCount": "n", "maxFrp_MW": _up("max_frp", 2), "riskScore": "risk", "riskLevel": "level",
    "nearestGridKm": _line(_up("line_km", 3)), "assetId": "asset_key", "gridClass": _line("grid_class"), "actualVoltageKv": _line("kv"), "displayLabel": _line("label"), "nearestAsset": _line("'line'"), "downwindAlignment": "CASE WHEN direction IS NOT NULL AND aside <= 35 THEN 'yes' ELSE 'no' END",
    "corridorDistanceKm": "CAST(reach AS DOUBLE)", "corridorWindSpeedKmh": "CASE WHEN direction IS NOT NULL THEN coalesce(speed, 15e0) END", "corridorWindSource": f"CASE WHEN {_slow} THEN 'fallback' ELSE 'model' END", "corridorConfidence": f"CASE WHEN {_slow} THEN 'low' ELSE 'normal' END",
    "affectedLines10km": "n_lines", "affectedSubstations10km": "n_subs", "triggerDetectionId": "CAST(evidence_det AS VARCHAR)", "triggerSource": "t_source", "triggerSatellite": "t_satellite", "triggerInstrument": "t_sensor", "triggerProduct": "t_product", "triggerDetectedAt": "t_at", "triggerFrpMw": _has(_up("coalesce(t_frp, 0)", 2)),
    "triggerConfidence": "t_confidence", "triggerLatitude": _has(_up("t_lat", 6)), "triggerLongitude": _has(_up("t_lon", 6)), "triggerDistanceKm": _has(_up("evidence_km", 3)), "nearestLineLatitude": _has(f"round({_up('nlat', 6)}, 4)"), "nearestLineLongitude": _has(f"round({_up('nlon', 6)}, 4)"), "eventCenterLatitude": _has(f"round({_up('lat', 6)}, 4)"), "eventCenterLongitude": _has(f"round({_up('lon', 6)}, 4)"),
    "evidenceCount": _has("CAST(n AS DOUBLE)"), "selectionRule": _has("'nearest_raw_detection'"),
}


def _tables_rounding(df: DataFrame) -> DataFrame:
    """Means and projected points agree with SQL to some decimals only."""
    coarse = {c: F.round(c, 4) for c in ("nearestLineLatitude", "nearestLineLongitude", "eventCenterLatitude", "eventCenterLongitude")}
    return df.withColumns(coarse | {c: F.round(c, 6) for c in ("lat", "lon")} | {"evidenceCount": F.col("evidenceCount").cast("double")})


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*ASSETS).groupBy("asset_key").agg(F.max("kv").alias("kv"), F.min("label").alias("label"))


@BOOK.add("K1_impact_table", f"WITH RECURSIVE {EVIDENCE} SELECT {', '.join(f'{x} AS {c}' for c, x in _cells.items())} FROM told LEFT JOIN ast USING (asset_key) WHERE country = 'TR'")
def impact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forty columns."""
    return _tables_rounding(exports.impact_table(_told(spark, sf_dir), _assets(spark, sf_dir), "TR", "Country"))


@BOOK.add(
    "K3_geojson_features",
    f"WITH RECURSIVE {EVIDENCE} SELECT 'FIRMS_fire_event_cluster' AS kind, 'Point' AS shape, CAST(event AS VARCHAR) AS name, CAST(n AS VARCHAR) AS value FROM ev WHERE {_country()} = 'TR' UNION ALL SELECT 'model_sample', 'Point', 'pm10', CAST(CAST(speed * 10 AS BIGINT) AS VARCHAR) FROM wind_ WHERE speed IS NOT NULL "
    "UNION ALL SELECT 'risky_line_segment', 'LineString', asset_key, CAST(evidence_det AS VARCHAR) FROM told WHERE asset_key IS NOT NULL AND country = 'TR'",
)
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of features, and what is in them when they are read again."""
    told = settle(_told(spark, sf_dir)).where("country = 'TR'")
    events = told.select("lat", "lon", "country", "event", "n", "max_frp", "sum_frp", "latest", "earliest")
    samples = T.wind(spark, sf_dir).select("lat", "lon", F.lit("TR").alias("countryCode"), F.lit("pm10").alias("variable"), F.round(F.col("speed") * 10).alias("value"), F.lit("µg/m³").alias("unit"), F.lit(T.AS_OF).alias("validAt"), F.lit("model").alias("source"), F.lit(10.0).alias("resolutionKm"))
    ends = T.segments(spark, sf_dir).select(F.col("sid").alias("line_sid"), "a_lon", "a_lat", "b_lon", "b_lat")
    got = exports.features(events, samples, told.join(ends, "line_sid"))
    at = lambda p: F.get_json_object("feature", f"$.{p}")
    name = F.coalesce(at("properties.assetId"), at("properties.variable"), at("properties.eventId"))
    value = F.when(F.col("kind") == "risky_line_segment", at("properties.triggerDetectionId")).when(F.col("kind") == "model_sample", at("properties.value").cast("double").cast("long").cast("string")).otherwise(at("properties.hotspotCount"))
    return got.select(at("properties.kind").alias("kind"), at("geometry.type").alias("shape"), name.alias("name"), value.alias("value"))


@BOOK.add("K2_K4_snapshot", f"WITH {T.R}, {T.W} SELECT 'metadata' AS part, 'TR' AS name, 1 AS n UNION ALL SELECT 'fires', product, count(*) FROM recent GROUP BY product UNION ALL SELECT 'wind', 'wind', count(*) FROM wind_")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the whole snapshot, written, read and counted."""
    stamp = F.lit(T.AS_OF).cast("timestamp_ntz")
    meta = exports.provenance("emberfold", "1", "TR", "Country", stamp, stamp, "Europe/Istanbul", (26.0, 36.0, 45.0, 42.0))
    folder = shared_folder(spark, "snapshot")
    exports.snapshot({"fires": T.recent(spark, sf_dir), "wind": T.wind(spark, sf_dir)}, meta).write.partitionBy("part").text(folder)
    at = lambda p: F.get_json_object("value", f"$.{p}")
    return spark.read.text(folder).groupBy("part", F.coalesce(at("countryCode"), at("product"), F.lit("wind")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("J10_evidence_of_lines", f"WITH RECURSIVE {EVIDENCE} SELECT asset_key, event, CAST(evidence_det AS VARCHAR) AS evidence_det, risk FROM told WHERE evidence_det IS NOT NULL AND asset_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_key ORDER BY risk DESC, event) = 1")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every line that has some."""
    return assets.evidence_of_lines(impact.impacts(spark, sf_dir)).select(F.col("line_asset_key").alias("asset_key"), "event", F.col("evidence_det").cast("string").alias("evidence_det"), "risk")


@BOOK.add("O7_shown_corridors", f"WITH RECURSIVE {impact.IMPACT}, ch AS (SELECT event FROM imp WHERE risk >= 35 AND reach IS NOT NULL ORDER BY risk DESC, min_km NULLS LAST, event LIMIT 30), s AS (SELECT event, sec.sid, sec.asset_key, arg_min(km, ({T.off('sec.direction', 'way')}, km)) AS km FROM sec JOIN ch USING (event) WHERE {T.off('sec.direction', 'way')} <= 22 AND km <= reach AND km >= 0.05 GROUP BY ALL), l AS (SELECT event, asset_key, min(km) AS km FROM s GROUP BY ALL) SELECT event, asset_key, round(km, 6) AS km FROM l QUALIFY row_number() OVER (PARTITION BY event ORDER BY km, asset_key) <= 4")
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest lines of the thirty riskiest events."""
    found = settle(impact.impacts(spark, sf_dir))
    lines = spatial.lines_in_sector(found.select("event", "lat", "lon", F.col("downwind").alias("direction"), F.col("corridor_km").alias("reach")), T.segments(spark, sf_dir), 22.0, 30.0)
    return assets.shown_corridors(found, lines).select("event", "asset_key", r6(F.col("km"), "km"))


@BOOK.add("ST4_dedupe", "SELECT DISTINCT user_id AS site, event_id % 3 AS kind FROM events")
def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key once within the watermark; the watermark is wider than the table."""
    folder = shared_folder(spark, "stream")
    stream = streams.read_files(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
    stream = stream.select(F.col("user_id").alias("site"), (F.col("event_id") % 3).alias("kind"), F.to_timestamp("ts").alias("detected_at"))
    streams.replay(streams.dedupe(stream, ["site", "kind"], late="3650 days"), folder)
    return spark.read.parquet(f"{folder}/out").select("site", "kind")


@BOOK.add("P11_A15_confirmed")
def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that two families or more have seen, inside the region."""
    obs = T.detections(spark, sf_dir).withColumn("idx", F.col("det"))
    return association.eligible(association.association_events(association.associate(obs)), T.REGION).select("event", "n_families", r6(F.col("lat"), "lat"), r6(F.col("lon"), "lon"))


_km_of = T.hav("lat", "lon", "37.9e0", "29.5e0")


@BOOK.add(
    "Z6_select_point",
    f"WITH {T.D}, {T.S}, {T.B}, {T.W}, p AS (SELECT 37.9e0 AS lat, 29.5e0 AS lon), l AS (SELECT sid, {T.seg_xy()[0]} AS km FROM p, seg ORDER BY km, sid LIMIT 1), s AS (SELECT sub, {_km_of} AS km FROM sub_ ORDER BY km, sub LIMIT 1), w AS (SELECT sample, {_km_of} AS km FROM wind_ ORDER BY km, sample LIMIT 1), n AS (SELECT count(*) AS n, min({_km_of}) AS km FROM det_ WHERE {_km_of} <= 10) "
    "SELECT CASE WHEN l.km <= 50 THEN CAST(l.sid AS VARCHAR) END AS line, round(CASE WHEN l.km <= 50 THEN l.km END, 6) AS line_km, CASE WHEN s.km <= 50 THEN CAST(s.sub AS VARCHAR) END AS sub, round(CASE WHEN s.km <= 50 THEN s.km END, 6) AS sub_km, sample, round(w.km, 6) AS sample_km, n.n AS fires, round(n.km, 6) AS nearest_fire_km FROM l, s, w, n",
)
def select_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about one chosen place: nearest assets within 50 km, nearest sample, fires within 10 km."""
    p = spark.range(1).select(F.col("id").alias("det"), F.lit(37.9).alias("lat"), F.lit(29.5).alias("lon"))
    line, sub = spatial.nearest_lines(p, T.segments(spark, sf_dir), 50.0), spatial.nearest_places(p, T.substations(spark, sf_dir), 50.0)
    air = spatial.nearest_sample(p, T.wind(spark, sf_dir), "det", ("speed", "direction"))
    fires = spatial.point_hits(p, T.detections(spark, sf_dir).select(F.col("det").alias("sub"), "lat", "lon"), 10.0).groupBy("det", "sub").agg(F.min("km").alias("km")).groupBy("det").agg(F.count(F.lit(1)).alias("fires"), F.min("km").alias("nearest_fire_km"))
    out = p.join(line, "det", "left").join(sub, "det", "left").join(air, "det", "left").join(fires, "det", "left")
    return out.select(F.col("line_sid").cast("string").alias("line"), r6(F.col("line_km"), "line_km"), F.col("sub").cast("string").alias("sub"), r6(F.col("sub_km"), "sub_km"), "sample", r6(F.col("sample_km"), "sample_km"), F.coalesce("fires", F.lit(0)).alias("fires"), r6(F.col("nearest_fire_km"), "nearest_fire_km"))
