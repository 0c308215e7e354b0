"""Queries of the grid pipeline, hourly series, lattices and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberfold.functions.geo import in_region
from emberfold.functions.voltage import kv_of_feature
from emberfold.operators import grid_etl as G
from emberfold.operators import series
from emberfold.plans import tables as T
from emberfold.plans.scalar import KVS
from emberfold.runtime import shared_folder
from emberfold.streaming import detections as streams
from emberfold.streaming.progress import Progress

BOOK = T.Book()
_lines = "('line', 'cable', 'minor_line')"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with voltages, key, and the reason of rejection; the region without its hole is the boundary."""
    rows = T.features(spark, sf_dir).withColumn("kvs", kv_of_feature(F.col("voltage"), F.col("voltage_raw"), F.col("explicit_kv"))).withColumn("kv", F.array_max("kvs"))
    inside = in_region(F.col("lat"), F.col("lon"), T.REGION[:1])
    rows = rows.withColumn("reason", G.reason(F.col("kv"), F.col("seq") % 17 != 0, inside)).withColumn("key", G.feature_key(F.lit("TR")))
    return rows.withColumn("power", G.power())


_pow = "lower(trim(coalesce(power, '')))"
_otype = f"CASE WHEN osm_type IN ('node', 'way', 'relation') THEN osm_type WHEN {_pow} IN {_lines} OR shape IN ('Polygon', 'MultiPolygon', 'LineString', 'MultiLineString') THEN 'way' ELSE 'node' END"
_kvtext = "array_to_string(list_transform(kvs, lambda v: regexp_replace(CAST(v AS VARCHAR), '\\.0$', '')), ';')"
FEAT = f"""{T.F_}, v AS (SELECT *, {KVS} AS kvs FROM feat), f AS (SELECT * REPLACE ({_pow} AS power), list_max(kvs) AS kv,
    CASE WHEN {_pow} NOT IN ('line', 'cable', 'minor_line', 'substation') THEN 'unsupported-power' WHEN seq % 17 = 0 THEN 'invalid-geometry' WHEN {_pow} IN {_lines} AND shape NOT IN ('LineString', 'MultiLineString') THEN 'unsupported-geometry'
      WHEN {_pow} = 'substation' AND shape NOT IN ('Point', 'Polygon', 'MultiPolygon') THEN 'unsupported-geometry' WHEN NOT {T.ring(T.REGION[0])} THEN 'outside-boundary' WHEN list_max(kvs) IS NULL THEN 'missing-voltage' WHEN list_max(kvs) < 50 THEN 'below-50' WHEN list_max(kvs) > 550 THEN 'above-550' ELSE 'accepted' END AS reason,
    CASE WHEN osm_id IS NOT NULL THEN concat_ws(':', 'TR', {_pow}, {_otype}, osm_id) ELSE concat_ws(':', 'TR', {_pow}, 'geometry', substr(sha256(concat_ws('|', geometry, {_kvtext}, coalesce(operator, ''))), 1, 24)) END AS key FROM v)"""


@BOOK.add("P14_P15_A21_rejections", f"WITH {FEAT} SELECT reason, count(*) AS n FROM f GROUP BY reason")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rejections(_features(spark, sf_dir))


_rich = " + ".join(f"(CASE WHEN {c} <> '' THEN 1 ELSE 0 END)" for c in G.RICH)
_ver = "coalesce(TRY_CAST(osm_version AS INT), 0)"
_time = "coalesce(epoch(TRY_CAST(replace(osm_timestamp, 'Z', '') AS TIMESTAMP)), 0)"


@BOOK.add(
    "A5_A7_preferred",
    f"WITH {FEAT}, a AS (SELECT *, {_time} AS t, {_ver} AS ver FROM f WHERE reason = 'accepted'), b AS (SELECT *, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY t DESC, ver DESC, {_rich} DESC, length(geometry) DESC, seq) AS rn FROM a), p AS (SELECT key, t, ver, count(DISTINCT geometry) AS pieces FROM a WHERE shape IN ('LineString', 'MultiLineString') GROUP BY ALL) "
    "SELECT key, seq, kv, copies, coalesce(pieces, 1) AS pieces FROM b LEFT JOIN p USING (key, t, ver) WHERE rn = 1",
)
def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.preferred(_features(spark, sf_dir).where("reason = 'accepted'"), ("seq", "kv"))


_vt = "CASE WHEN kv IS NOT NULL THEN concat(regexp_replace(CAST(kv AS VARCHAR), '\\.0$', ''), ' kV') ELSE 'unknown voltage' END"
_idt = "coalesce(concat('OSM ' || osm_id), 'no OSM id')"


@BOOK.add(
    "F6_F7_labels",
    f"WITH {FEAT} SELECT seq, coalesce(nullif(trim(name), ''), nullif(trim(ref), ''), CASE WHEN \"from\" IS NOT NULL AND \"to\" IS NOT NULL THEN concat(\"from\", ' – ', \"to\") END, concat_ws(' · ', operator, {_vt}, CASE WHEN osm_id IS NULL THEN 'no OSM id' ELSE concat('OSM ', osm_id) END)) AS label, "
    f"CASE WHEN trim(name) <> '' THEN 'osm-name' WHEN trim(ref) <> '' THEN 'osm-ref' WHEN \"from\" IS NOT NULL AND \"to\" IS NOT NULL THEN 'osm-from-to' ELSE 'generated-identifier' END AS label_source, concat_ws('-', 'TR', power, {_otype}, coalesce(regexp_replace(osm_id, '[^A-Za-z0-9_.:-]+', '-', 'g'), substr(sha256(geometry), 1, 12))) AS asset_id FROM f",
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, source = G.label()
    return _features(spark, sf_dir).select("seq", text.alias("label"), source.alias("label_source"), G.asset_id(F.lit("TR"), F.col("power")).alias("asset_id"))


_ratio = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END, 6)"
_ln = f"power IN {_lines}"
#: What is known of each download.
DOWNLOADS = (("mixed", False, 0, True, 0, 2), ("partial", True, 3, True, 1, 0), ("clean", False, 0, True, 0, 0), ("unknown", None, None, True, 0, 0), ("unlisted", False, 0, False, 0, 0), ("gaps", False, 0, True, 4, 0), ("nothing", False, 0, True, 0, 0))
DATASET = "CASE WHEN seq % 8 = 0 THEN 'mixed' WHEN seq % 8 < 3 THEN 'partial' WHEN reason = 'accepted' AND seq < 700 THEN CASE seq % 8 WHEN 3 THEN 'clean' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unlisted' ELSE 'gaps' END END"
#: What a source says of the voltage beside the raw text, for some rows.
TOLD_KV = "CASE WHEN seq % 8 < 3 AND seq % 11 = 0 THEN 66e0 END"


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(_features(spark, sf_dir).withColumn("dataset", F.expr(DATASET)).where("dataset is not null"))


def _described(rows: DataFrame) -> DataFrame:
    """Validity, place, mismatch and the points of lines of features."""
    raw = F.coalesce((F.col("voltage") != "") | (F.col("voltage_raw") != ""), F.lit(False))
    told = F.expr(TOLD_KV)
    mismatch = raw & told.isNotNull() & F.coalesce(F.abs(told - F.col("kv")) > 1e-9, F.lit(True))
    # multi-lines of two parts, that begin at corners of a coarse grid
    lo, la, k = F.col("lon"), F.col("lat"), (F.col("seq") % 3 + 1).cast("double") / 10
    at = lambda x, y: F.array(x, y)
    parts = F.array(F.array(at(F.round(lo, 1), F.round(la, 1)), at(lo, la), at(lo + k, la)), F.array(at(lo + k, la), at(lo + k, la + k)), F.array(at(lo, la)))
    valid = F.col("seq") % 17 != 0
    return rows.withColumns({"valid": valid, "inside": in_region(la, lo, T.REGION[:1]), "mismatch": mismatch, "parts": parts})


def _downloads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOWNLOADS, "dataset string, partial boolean, failed_requests long, failed_listed boolean, gap_tiles long, exceeded_tiles long")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.collection_metrics(_collections(spark, sf_dir), _downloads(spark))


_ends = ", ".join(f"(round({x}, 4), round({y}, 4))" for x, y in (("round(lon, 1)", "round(lat, 1)"), ("lon + k", "lat"), ("lon + k", "lat"), ("lon + k", "lat + k")))
DESCRIBED = f"""seq % 17 <> 0 AS valid, {T.ring(T.REGION[0])} AS inside, (coalesce(voltage, '') <> '' OR coalesce(voltage_raw, '') <> '') AND {TOLD_KV} IS NOT NULL AND (kv IS NULL OR abs({TOLD_KV} - kv) > 1e-9) AS mismatch, (seq % 3 + 1) / 10 AS k"""


def metrics_sql(g: str, downloads: tuple) -> str:
    """Common table expressions up to ``met``; ``g`` has the described rows with their dataset."""
    known = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) if isinstance(x, (int, str)) else str(x) for x in r) + ")" for r in downloads)
    return f"""{FEAT}, {g},
    w AS (SELECT * FROM (VALUES {known}) v(dataset, partial, failed_requests, failed_listed, gap_tiles, exceeded_tiles)),
    c AS (SELECT dataset, count(*) AS raw, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND NOT inside) AS outside, count(*) FILTER (valid AND inside AND len(kvs) = 0) AS parse_failures, count(*) FILTER (valid AND inside AND mismatch) AS mismatches, count(*) FILTER (reason = 'accepted') AS ok FROM g WHERE dataset IS NOT NULL GROUP BY dataset),
    u AS MATERIALIZED (SELECT * FROM g WHERE reason = 'accepted' AND dataset IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, key ORDER BY seq) = 1),
    h AS (SELECT dataset, count(*) AS kept, count(*) FILTER ({_ln}) AS lines, count(*) FILTER (power = 'substation') AS substations, count(*) FILTER ({_ln} AND kv BETWEEN 300 AND 550) AS lines_400, count(*) FILTER ({_ln} AND kv >= 50 AND kv < 300) AS lines_154,
      count(*) FILTER ({_ln} AND name <> '') AS named, count(*) FILTER ({_ln} AND ref <> '') AS referenced, count(*) FILTER ({_ln} AND operator <> '') AS operated, count(*) FILTER (osm_timestamp <> '') AS timed FROM u GROUP BY dataset),
    e AS (SELECT dataset, p, count(*) AS n FROM (SELECT dataset, unnest([{_ends}]) AS p FROM u WHERE {_ln}) GROUP BY ALL),
    d AS (SELECT dataset, count(*) FILTER (n = 1) AS dangling, round(count(*) FILTER (n = 1) / sum(n), 6) AS dangling_ratio FROM e GROUP BY dataset),
    m AS (SELECT dataset, partial, failed_requests, failed_listed, gap_tiles, exceeded_tiles, {', '.join(f"coalesce({x}, 0) AS {x}" for x in 'raw invalid outside parse_failures mismatches lines substations lines_400 lines_154 named referenced operated timed dangling dangling_ratio'.split())}, coalesce(ok - kept, 0) AS duplicates, coalesce(kept, 0) - coalesce(parse_failures, 0) AS parsed FROM w LEFT JOIN c USING (dataset) LEFT JOIN h USING (dataset) LEFT JOIN d USING (dataset)),
    met AS (SELECT * EXCLUDE (parsed, failed_requests), coalesce(failed_requests, 0) AS failed_requests, {_ratio('named', 'lines')} AS named_ratio, {_ratio('referenced', 'lines')} AS referenced_ratio, {_ratio('operated', 'lines')} AS operated_ratio, {_ratio('timed', 'raw')} AS timed_ratio, {_ratio('parsed', 'raw')} AS parse_success_ratio,
      partial IS NOT NULL AND failed_requests IS NOT NULL AND failed_listed AS transparent, coalesce(partial IS NOT NULL AND failed_requests IS NOT NULL AND failed_listed AND NOT partial AND failed_requests = 0 AND outside = 0 AND invalid = 0 AND duplicates = 0 AND mismatches = 0 AND gap_tiles = 0, false) AS gates_passed FROM m)"""


METRICS = metrics_sql(f"g AS (SELECT *, {DATASET} AS dataset, {DESCRIBED} FROM f)", DOWNLOADS)


@BOOK.add("A22_A23_A27_collection", f"WITH {METRICS} SELECT * FROM met")
def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


_every_two = f"""g0 AS (SELECT *, {DATASET} AS dataset, {DESCRIBED} FROM f), a0 AS (SELECT * FROM g0 WHERE reason = 'accepted' AND dataset IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, key ORDER BY seq) = 1), n0 AS (SELECT * FROM (VALUES {", ".join(f"('{d[0]}')" for d in DOWNLOADS)}) v(other)),
    g AS (SELECT * FROM g0 UNION ALL SELECT g0.* REPLACE (other || '>' || dataset AS dataset) FROM g0, n0 UNION ALL SELECT a0.* REPLACE (dataset || '>' || other AS dataset) FROM a0, n0 WHERE (other, key) NOT IN (SELECT dataset, key FROM a0))"""
_unions = tuple((f"{a[0]}>{b[0]}", *b[1:]) for a in DOWNLOADS for b in DOWNLOADS)


@BOOK.add(
    "A28_choose",
    f"WITH {metrics_sql(_every_two, DOWNLOADS + _unions)}, s0 AS (SELECT x.dataset AS existing, y.dataset AS fresh, count(*) AS shared FROM a0 x JOIN a0 y USING (key) GROUP BY ALL), k0 AS (SELECT dataset, count(*) AS n FROM a0 GROUP BY dataset) "
    "SELECT a.dataset AS existing, b.dataset AS fresh, CASE WHEN b.gates_passed THEN 'fresh' WHEN a.gates_passed THEN 'existing' ELSE 'none' END AS selected, CASE WHEN c.gates_passed THEN 'validated-union' ELSE 'none' END AS as_union, coalesce(shared, 0) AS shared, coalesce(kb.n, 0) - coalesce(shared, 0) AS only_fresh, coalesce(ka.n, 0) - coalesce(shared, 0) AS only_existing "
    "FROM n0 na JOIN met a ON a.dataset = na.other CROSS JOIN n0 nb JOIN met b ON b.dataset = nb.other JOIN met c ON c.dataset = a.dataset || '>' || b.dataset LEFT JOIN s0 ON existing = a.dataset AND fresh = b.dataset LEFT JOIN k0 ka ON ka.dataset = a.dataset LEFT JOIN k0 kb ON kb.dataset = b.dataset",
)
def choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two of a handful of downloads, as the existing and the fresh one, and the union of both."""
    return G.compare_downloads(_collections(spark, sf_dir), _downloads(spark))


#: Two providers that share keys. One country has all features, one accepted ones only, and of one the union's download was partial.
COUNTRY = "CASE WHEN reason <> 'accepted' OR seq % 8 < 3 THEN 'AA' WHEN seq % 2 = 0 THEN 'BB' ELSE 'CC' END"
PROVIDER, SHARED_KEY = "CASE WHEN seq % 10 < 6 THEN 'first' ELSE 'second' END", "concat(power, CAST(floor(seq / 10) * 5 + seq % 5 AS STRING))"
_parts = tuple((c, p, c == "CC" and p == "union", 0, True, 0, 0) for c in ("AA", "BB", "CC") for p in ("first", "second", "union"))
_both = f"""g0 AS (SELECT * REPLACE ({SHARED_KEY} AS key), {COUNTRY} AS country, {PROVIDER} AS provider, {DESCRIBED} FROM f), gu AS (SELECT * FROM g0 WHERE provider = 'first' OR (country, key) NOT IN (SELECT country, key FROM g0 WHERE provider = 'first')),
    g AS (SELECT *, country || ':' || provider AS dataset FROM g0 UNION ALL SELECT *, country || ':union' FROM gu)"""


@BOOK.add(
    "A28_source_validation",
    f"WITH {metrics_sql(_both, tuple((f'{r[0]}:{r[1]}', *r[2:]) for r in _parts))}, k AS (SELECT country, key, bool_or(provider = 'first') AS a, bool_or(provider = 'second') AS b FROM g0 WHERE reason = 'accepted' GROUP BY ALL), "
    "ks AS (SELECT country, count(*) FILTER (a AND b) AS shared, count(*) FILTER (NOT b) AS only_first, count(*) FILTER (NOT a) AS only_second, count(*) AS n_union FROM k GROUP BY country), "
    f"sq AS (SELECT country, count(*) AS gap_squares FROM (SELECT country, floor(lon) AS x, floor(lat) AS y, count(*) AS n_new, count(*) FILTER (provider = 'first') AS n_old FROM gu WHERE reason = 'accepted' AND {_ln} GROUP BY ALL) WHERE {G.GAP} GROUP BY country) "
    "SELECT f.dataset[:2] AS country, CASE WHEN u.gates_passed THEN 'validated-union' ELSE 'none' END AS selected, f.raw AS first_raw, s.raw AS second_raw, u.raw AS union_raw, f.lines AS first_lines, u.lines AS union_lines, u.duplicates AS union_duplicates, f.gates_passed AS first_ok, s.gates_passed AS second_ok, u.gates_passed AS union_ok, "
    "coalesce(shared, 0) AS shared, coalesce(only_first, 0) AS only_first, coalesce(only_second, 0) AS only_second, coalesce(n_union, 0) AS n_union, coalesce(gap_squares, 0) AS gap_squares "
    "FROM met f JOIN met s ON s.dataset = f.dataset[:2] || ':second' JOIN met u ON u.dataset = f.dataset[:2] || ':union' LEFT JOIN ks ON ks.country = f.dataset[:2] LEFT JOIN sq ON sq.country = f.dataset[:2] WHERE f.dataset LIKE '%:first'",
)
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers of each country, and whether their union is published."""
    rows = _described(_features(spark, sf_dir)).withColumn("key", F.expr(SHARED_KEY.replace("floor(seq / 10)", "seq div 10"))).withColumn("country", F.expr(COUNTRY)).withColumn("provider", F.expr(PROVIDER))
    known = spark.createDataFrame(_parts, "country string, part string, partial boolean, failed_requests long, failed_listed boolean, gap_tiles long, exceeded_tiles long")
    got = G.source_validation(rows, known)
    return got.select("country", "selected", "first_raw", "second_raw", "union_raw", "first_lines", "union_lines", "union_duplicates", *[F.col(f"{p}_gates_passed").alias(f"{p}_ok") for p in ("first", "second", "union")], "shared", "only_first", "only_second", "n_union", "gap_squares")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.segments(spark, sf_dir).select(F.array(F.array(F.array("a_lon", "a_lat"), F.array("b_lon", "b_lat"))).alias("parts"))


@BOOK.add(
    "A24_X7_endpoints",
    f"WITH {T.S}, p AS (SELECT round(a_lon, 4) AS x, round(a_lat, 4) AS y FROM seg UNION ALL SELECT round(b_lon, 4), round(b_lat, 4) FROM seg), e AS (SELECT x, y, count(*) AS n FROM p GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_ends, count(*) FILTER (n = 1) AS dangling, round(count(*) FILTER (n = 1) / sum(n), 6) AS share FROM e",
)
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.endpoints(_paths(spark, sf_dir))


def _two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = T.features(spark, sf_dir).selectExpr("seq", "lon", "lat", "CAST(seq % 1500 AS STRING) AS key", "seq % 3 AS part")
    return rows.where("part = 0").drop("part"), rows.where("part > 0").drop("part")


_sets = f"{T.F_}, s AS (SELECT seq, lon, lat, CAST(seq % 1500 AS VARCHAR) AS key, seq % 3 AS part FROM feat)"


@BOOK.add(
    "A25_A26_gap_candidates",
    f"WITH {_sets}, o AS (SELECT floor(lon) AS x, floor(lat) AS y, count(*) AS n_old FROM s WHERE part = 0 GROUP BY ALL), n AS (SELECT floor(lon) AS x, floor(lat) AS y, count(*) AS n_new FROM s WHERE part > 0 GROUP BY ALL), b AS (SELECT x, y, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new FROM o FULL JOIN n USING (x, y)) "
    "SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, n_old, n_new, n_new - n_old AS delta FROM b WHERE n_new >= 5 AND (n_old = 0 OR (n_new >= n_old + 10 AND n_new >= 1.5 * n_old)) ORDER BY delta DESC, x, y LIMIT 20",
)
def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest gaps."""
    return G.gap_candidates(*_two_sets(spark, sf_dir))


@BOOK.add("J14_U2_validated_union", f"WITH {_sets} SELECT key, seq, CAST(NULL AS VARCHAR) AS fallback FROM s WHERE part > 0 UNION ALL SELECT key, seq, 'legacy-validated' FROM s WHERE part = 0 AND seq % 2 = 0 AND key NOT IN (SELECT key FROM s WHERE part > 0)")
def validated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_sets(spark, sf_dir)
    return G.validated_union(old, new, old.where("seq % 2 = 0").select("key").distinct()).where("fallback is null or seq % 2 = 0").select("key", "seq", "fallback")


@BOOK.add("J15_U3_key_sets", f"WITH {_sets}, a AS (SELECT DISTINCT key FROM s WHERE part = 0), b AS (SELECT DISTINCT key FROM s WHERE part > 0) SELECT (SELECT count(*) FROM a JOIN b USING (key)) AS shared, (SELECT count(*) FROM b ANTI JOIN a USING (key)) AS only_new, (SELECT count(*) FROM a ANTI JOIN b USING (key)) AS only_old")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.key_sets(*_two_sets(spark, sf_dir))


def _box(df: DataFrame) -> tuple[float, float, float, float]:
    return tuple(df.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first())


@BOOK.add(
    "S30_S31_tiles",
    f"WITH {T.B}, b AS (SELECT floor(min(lon) / 0.5) AS w, floor(max(lon) / 0.5) AS e, floor(min(lat) / 0.5) AS s, floor(max(lat) / 0.5) AS n FROM sub_), xs AS (SELECT unnest(range(CAST(w AS BIGINT), CAST(e AS BIGINT) + 1)) AS x FROM b), ys AS (SELECT unnest(range(CAST(s AS BIGINT), CAST(n AS BIGINT) + 1)) AS y FROM b), "
    "q AS (SELECT floor(lon / 0.25) AS qx, floor(lat / 0.25) AS qy, count(*) AS n FROM sub_ GROUP BY ALL) SELECT x, y, c AS child, (x * 2 + c % 2) * 0.25e0 AS w, (y * 2 + c // 2) * 0.25e0 AS s, (x * 2 + c % 2) * 0.25e0 + 0.25e0 AS e, (y * 2 + c // 2) * 0.25e0 + 0.25e0 AS n, coalesce(q.n, 0) AS found FROM xs CROSS JOIN ys CROSS JOIN range(4) r(c) LEFT JOIN q ON qx = x * 2 + c % 2 AND qy = y * 2 + c // 2",
)
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned tiles that cover all substations, each in four, with what is in them."""
    places = T.substations(spark, sf_dir)
    kids = G.split_tiles(G.tiles(spark, *_box(places), 0.5)).withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")})
    there = places.groupBy((F.floor(F.col("lon") / 0.25) * 0.25).alias("w"), (F.floor(F.col("lat") / 0.25) * 0.25).alias("s")).agg(F.count(F.lit(1)).alias("found"))
    return kids.join(there, ["w", "s"], "left").select("x", "y", "child", "w", "s", "e", "n", F.coalesce("found", F.lit(0)).alias("found"))


#: Downloads by tile of half a degree: some line tiles came back empty, some tiles lie mostly outside.
TILES = ("x", "y", "CASE WHEN seq % 5 = 0 THEN 'point' ELSE 'line' END AS kind", "CASE WHEN seq % 40 = 1 THEN 1 ELSE 0 END AS depth", "CASE WHEN (x * 7 + y * 5) % 6 = 0 THEN 0 ELSE 1 END AS found")
_tiles = f"t AS (SELECT kind, depth, x, y, CAST(sum(found) AS BIGINT) AS n, ((x + y) % 7) / 10e0 AS inside, x * 0.5e0 AS w, y * 0.5e0 AS s, x * 0.5e0 + 0.5e0 AS e, y * 0.5e0 + 0.5e0 AS nn FROM (SELECT {', '.join(TILES)} FROM (SELECT *, CAST(floor(lon / 0.5) AS BIGINT) AS x, CAST(floor(lat / 0.5) AS BIGINT) AS y FROM feat)) GROUP BY ALL), l AS (SELECT * FROM t WHERE kind = 'line' AND depth = 0)"
_near = lambda a, b: f"abs({a} - {b}) <= 1e-8"


@BOOK.add(
    "J16_suspicious_tiles",
    f"WITH {T.F_}, {_tiles}, p AS (SELECT a.x, a.y, b.n FROM l a JOIN l b ON (({_near('a.e', 'b.w')} OR {_near('b.e', 'a.w')}) AND least(a.nn, b.nn) - greatest(a.s, b.s) > 1e-8) OR (({_near('a.nn', 'b.s')} OR {_near('b.nn', 'a.s')}) AND least(a.e, b.e) - greatest(a.w, b.w) > 1e-8) WHERE a.n = 0 AND NOT a.inside < 0.1) "
    "SELECT x, y, count(*) FILTER (n > 0) AS busy, CAST(sum(n) AS BIGINT) AS total FROM p GROUP BY ALL HAVING count(*) FILTER (n > 0) >= 2 AND sum(n) >= 20",
)
def suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = T.features(spark, sf_dir).withColumns({"x": F.floor(F.col("lon") / 0.5), "y": F.floor(F.col("lat") / 0.5)})
    found = at.selectExpr(*TILES).groupBy("kind", "depth", "x", "y").agg(F.sum("found").alias("n"))
    return G.suspicious_empty(found.withColumn("inside", F.expr("((x + y) % 7) / 10e0")))


@BOOK.add("J17_coverage", f"WITH {FEAT}, r AS (SELECT * FROM (VALUES ('west', 28.5, 36.9, 29.2, 38.9), ('north', 28.5, 38.2, 30.5, 38.9), ('sea', 10.0, 10.0, 11.0, 11.0)) v(region, w, s, e, n)) SELECT region, count(*) FILTER (power IN {_lines}) AS lines, count(*) FILTER (power = 'substation') AS substations FROM r LEFT JOIN f ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY region")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.createDataFrame([("west", 28.5, 36.9, 29.2, 38.9), ("north", 28.5, 38.2, 30.5, 38.9), ("sea", 10.0, 10.0, 11.0, 11.0)], "region string, w double, s double, e double, n double")
    return G.coverage(_features(spark, sf_dir).selectExpr("power", "lon AS w", "lat AS s", "lon AS e", "lat AS n"), regions)


@BOOK.add("J18_refined_tiles", f"WITH {T.B}, t AS (SELECT CAST(floor(lon / 0.25) AS BIGINT) AS x, CAST(floor(lat / 0.25) AS BIGINT) AS y, count(*) AS n FROM sub_ GROUP BY ALL) SELECT x // 2 AS px, y // 2 AS py, CAST(sum(n) AS BIGINT) AS n, count(*) AS children FROM t GROUP BY ALL")
def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.substations(spark, sf_dir).groupBy(F.floor(F.col("lon") / 0.25).alias("x"), F.floor(F.col("lat") / 0.25).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy(F.floor(F.col("x") / 2).alias("px"), F.floor(F.col("y") / 2).alias("py")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("children"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with 48 hourly values each, as arrays."""
    hours = F.sequence(F.lit(0), F.lit(47))
    time = F.transform(hours, lambda h: F.date_format(F.expr("timestamp_ntz'2024-01-14 00:00:00'") + F.make_dt_interval(F.lit(0), h), "yyyy-MM-dd'T'HH:mm"))
    value = lambda a, b: F.transform(hours, lambda h: ((F.col("sub") * a + h * b) % 97).cast("double") - 5)
    return T.substations(spark, sf_dir).select(F.col("sub").alias("sample"), time.alias("time"), value(7, 3).alias("pm10_wildfires"), value(11, 5).alias("pm10"))


_hours = f"{T.B}, h AS (SELECT sub AS sample, h, TIMESTAMP '2024-01-14 00:00:00' + to_hours(CAST(h AS INT)) AS time, CAST((sub * 7 + h * 3) % 97 - 5 AS DOUBLE) AS pm10_wildfires, CAST((sub * 11 + h * 5) % 97 - 5 AS DOUBLE) AS pm10 FROM sub_, range(48) r(h))"


@BOOK.add("S19_S22_J7_nearest_hour", f"WITH {_hours} SELECT sample, time, CASE WHEN pm10_wildfires >= 0 THEN pm10_wildfires END AS pm10_wildfires FROM h QUALIFY row_number() OVER (PARTITION BY sample ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-15 12:30:00')), h) = 1")
def nearest_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.hours(_points(spark, sf_dir), "time", ("pm10_wildfires",))
    got = series.nearest_hour(rows, F.expr("timestamp_ntz'2024-01-15 12:30:00'"), ("pm10_wildfires",))
    return got.select("sample", "time", series.clean(F.col("pm10_wildfires")).alias("pm10_wildfires"))


@BOOK.add("S20_M25_shares", f"WITH {_hours} SELECT sample, time, round(CASE WHEN pm10 > 0 THEN least(100.0, greatest(0.0, 100 * pm10_wildfires / pm10)) END, 6) AS share FROM h WHERE time BETWEEN TIMESTAMP '2024-01-14 06:00:00' AND TIMESTAMP '2024-01-15 18:00:00'")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.shares(series.hours(_points(spark, sf_dir), "time", ("pm10_wildfires", "pm10")))
    return rows.where("time BETWEEN timestamp_ntz'2024-01-14 06:00:00' AND timestamp_ntz'2024-01-15 18:00:00'").select("sample", "time", F.round("share", 6).alias("share"))


@BOOK.add("S47_batches", f"WITH {T.B} SELECT CAST(floor(sub / 45) AS BIGINT) AS batch, count(*) AS n FROM sub_ GROUP BY ALL")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.batches(T.substations(spark, sf_dir), "sub").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    "X8_lattice",
    f"WITH {T.B}, b AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM sub_), p AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, s + (n - s) * r / 14 AS lat, w + (e - w) * c / 13 AS lon FROM b, range(15) x(r), range(14) y(c)) SELECT r, c, round(lat, 6) AS lat, round(lon, 6) AS lon, {T.inside()} AS inside FROM p",
)
def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice over the box of all substations."""
    at = series.lattice(spark, *_box(T.substations(spark, sf_dir)), 15, 14)
    return at.select("r", "c", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), in_region(F.col("lat"), F.col("lon"), T.REGION).alias("inside"))


#: Events arrive in three parts: up to the middle of the month, from there on, and every twenty-fifth event after all others.
LATE = "event_id % 25 = 0"
_HALF = "TIMESTAMP '2024-01-16 00:00:00'"
_DELAY = 48
_WATERMARK = f"wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {_DELAY} HOURS AS w FROM events WHERE NOT ({LATE}))"
_PRODUCT = "CASE event_id % 3 WHEN 0 THEN 'VIIRS_NOAA20_NRT' WHEN 1 THEN 'SLSTR L2P FRP' ELSE 'MTG FCI FRP' END"


def arrived(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """What a stream gives out of the events as they arrive in three parts; what is too late is dropped."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    early = F.col("ts") < F.expr(_HALF)
    late = F.expr(LATE)
    ahead = spark.range(1).select(*[(F.expr("timestamp'2100-01-01 00:00:00'") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    return streams.arrivals([events.where(~late & early), events.where(~late & ~early), events.where(late)], shared_folder(spark, "stream"), make, ahead)


def _detected(stream: DataFrame) -> DataFrame:
    return stream.selectExpr(f"{_PRODUCT} AS product", "user_id AS site", "ts AS detected_at", "value AS frp")


def _plain_times(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz"))


@BOOK.add(
    "ST1_tumbling",
    f"WITH {_WATERMARK}, e AS (SELECT {LATE} AS late, {_PRODUCT} AS product, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS start, value FROM events) "
    "SELECT product, start, start + INTERVAL 4 HOURS AS stop, count(*) AS n, max(value) AS max_frp FROM e, wm WHERE NOT late OR start + INTERVAL 4 HOURS > w GROUP BY ALL",
)
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = arrived(spark, sf_dir, lambda s: streams.windowed(_detected(s), "4 hours", by=("product",), late=f"{_DELAY} hours"))
    return _plain_times(got).select("product", "start", "stop", "n", "max_frp")


@BOOK.add(
    "ST2_sliding",
    f"WITH {_WATERMARK}, s AS (SELECT {LATE} AS late, time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(3 * k AS INT)) AS start, value FROM events, range(8) r(k)) "
    "SELECT start, start + INTERVAL 24 HOURS AS stop, count(*) AS n, max(value) AS max_frp FROM s, wm WHERE NOT late OR start + INTERVAL 24 HOURS > w GROUP BY start",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = arrived(spark, sf_dir, lambda s: streams.windowed(_detected(s), "24 hours", "3 hours", late=f"{_DELAY} hours"))
    return _plain_times(got).select("start", "stop", "n", "max_frp")


_runs = lambda rows: f"SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM {rows})"
_told = "SELECT user_id AS site, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS stop, count(*) AS n, max(value) AS max_frp FROM {} GROUP BY user_id, k"


@BOOK.add(
    "ST3_sessions",
    f"WITH {_WATERMARK}, a AS ({_runs(f'(SELECT user_id, ts, value FROM events WHERE NOT ({LATE}))')}), m AS (SELECT *, max(ts) OVER (PARTITION BY user_id, k) + INTERVAL 6 HOURS AS stop FROM a), "
    f"o AS (SELECT user_id, ts, value FROM m, wm WHERE stop > w UNION ALL SELECT user_id, ts, value FROM events, wm WHERE {LATE} AND ts + INTERVAL 6 HOURS > w), b AS ({_runs('o')}) "
    f"{_told.format('(SELECT m.* FROM m, wm WHERE stop <= w)')} UNION ALL {_told.format('b')}",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites' runs of detections; a late one opens a run of its own if the run that it belongs to has been given out."""
    got = arrived(spark, sf_dir, lambda s: streams.sessions(_detected(s), "6 hours", "site", late=f"{_DELAY} hours"))
    return _plain_times(got).select("site", "start", "stop", "n", "max_frp")


@BOOK.add(
    "ST5_progress",
    f"WITH {_WATERMARK}, e AS (SELECT {LATE} AS late, ts, event_id % 3 AS kind, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 4 HOURS AS stop FROM events) "
    f"SELECT part, CAST(n AS BIGINT) AS n, CAST(dropped AS BIGINT) AS dropped FROM (SELECT 0 AS part, count(*) FILTER (NOT late AND ts < {_HALF}) AS n, 0 AS dropped FROM e UNION ALL SELECT 1, count(*) FILTER (NOT late AND ts >= {_HALF}), 0 FROM e "
    "UNION ALL SELECT 2, count(*) FILTER (late), count(DISTINCT (kind, stop)) FILTER (late AND stop <= w) FROM e, wm)",
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came with each part, and the late groups (window and product) that the watermark turned away, by a listener."""
    with Progress(spark) as told:
        arrived(spark, sf_dir, lambda s: streams.windowed(_detected(s), "4 hours", by=("product",), late=f"{_DELAY} hours"))
    rows = told.table().where("rows_in > 0")
    part = F.row_number().over(Window.partitionBy("query").orderBy("batch")) - 1
    return rows.select(part.alias("part"), F.col("rows_in").alias("n"), "dropped").where("part < 3")
