"""Cleaning, choosing and comparing open grid features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.numbers import str_or_null
from emberfold.functions.text import id_suffix
from emberfold.functions.voltage import kv_text, voltage_class
from emberfold.runtime import settle

LINES = ("line", "cable", "minor_line")
LINE_SHAPES, PLACE_SHAPES = ("LineString", "MultiLineString"), ("Point", "Polygon", "MultiPolygon")
#: The properties whose presence makes a feature richer.
RICH = ("name", "ref", "operator", "voltage", "osm_timestamp", "frequency", "cables", "wires")
#: Months by name, for two old spellings of times.
OLD_TIMES = ("MMM d yyyy h:mma", "MMM  d yyyy h:mma")


def power() -> Column:
    return F.lower(F.trim(F.coalesce("power", F.lit(""))))


def reason(kv: Column, valid: Column, inside: Column) -> Column:
    """Why a feature is rejected, or ``accepted``; the order of the steps decides which counter a row is in."""
    is_line, is_place = power().isin(*LINES), power() == "substation"
    return (
        F.when(~(is_line | is_place), "unsupported-power")
        .when(~F.coalesce(valid, F.lit(False)), "invalid-geometry")
        .when((is_line & ~F.col("shape").isin(*LINE_SHAPES)) | (is_place & ~F.col("shape").isin(*PLACE_SHAPES)), "unsupported-geometry")
        .when(~F.coalesce(inside, F.lit(False)), "outside-boundary")
        .when(kv.isNull(), "missing-voltage")
        .when(kv < 50, "below-50")
        .when(kv > 550, "above-550")
        .otherwise("accepted")
    )


def osm_id() -> Column:
    return F.coalesce(*[str_or_null(F.col(c)) for c in ("osm_id2", "osm_id", "osmId")])


def osm_type() -> Column:
    given = F.lower(F.trim(F.coalesce("osm_type", F.lit(""))))
    way = power().isin(*LINES) | F.col("shape").isin("Polygon", "MultiPolygon", *LINE_SHAPES)
    return F.when(given.isin("node", "way", "relation"), given).when(way, "way").otherwise("node")


def feature_key(country: Column) -> Column:
    """Country, power, type and id; without an id a digest of geometry, voltages and operator."""
    text = F.concat_ws("|", F.col("geometry"), F.array_join(F.transform("kvs", lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")), ";"), F.coalesce("operator", F.lit("")))
    digest = F.substring(F.sha2(text, 256), 1, 24)
    return F.when(osm_id().isNotNull(), F.concat_ws(":", country, power(), osm_type(), osm_id())).otherwise(F.concat_ws(":", country, power(), F.lit("geometry"), digest))


def completeness() -> Column:
    out = F.lit(0)
    for c in RICH:
        out = out + F.coalesce((F.col(c).cast("string") != "").cast("int"), F.lit(0))
    return out


def revision_time(x: Column) -> Column:
    """Seconds since 1970 of an ISO time or one of two old spellings; 0 if there is none."""
    iso = F.regexp_replace(F.trim(x), "Z$", "").try_cast("timestamp_ntz")
    old = [F.try_to_timestamp(F.regexp_replace(F.trim(x), " +", " "), F.lit("MMM d yyyy h:mma")).cast("timestamp_ntz")]
    ts = F.coalesce(iso, *old)
    return F.coalesce(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts), F.lit(0))


def preferred(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One feature of each key: the newest, then highest version, then richest, then most detailed, then first by seq.

    Lines of the same revision whose geometry differs are kept as the pieces of one feature (``pieces``).
    """
    revised, version = revision_time(F.col("osm_timestamp")), F.coalesce(F.col("osm_version").try_cast("int"), F.lit(0))
    rows = features.withColumns({"_t": revised, "_v": version})
    rank = F.struct(F.col("_t"), F.col("_v"), completeness(), F.length("geometry"), -F.col("seq"))
    best = rows.groupBy("key").agg(F.max_by(F.struct("_t", "_v", *columns), rank).alias("r"), F.count(F.lit(1)).alias("copies"))
    best = best.select("key", "r.*", "copies")
    # lines only, and only where the revision is the chosen one
    lines = rows.where(F.col("shape").isin(*LINE_SHAPES)).select("key", "_t", "_v", "geometry").distinct()
    pieces = lines.groupBy("key", "_t", "_v").agg(F.count(F.lit(1)).alias("pieces"))
    return best.join(pieces, ["key", "_t", "_v"], "left").select("key", *columns, "copies", F.coalesce("pieces", F.lit(1)).alias("pieces"))


def label() -> tuple[Column, Column]:
    """(label, its source) of an asset: name, reference, both ends, or one made of operator, voltage and id."""
    name, ref, start, end, operator = (str_or_null(F.col(c)) for c in ("name", "ref", "from", "to", "operator"))
    volts, known = kv_text(F.col("kv")), F.coalesce(F.concat(F.lit("OSM "), osm_id()), F.lit("no OSM id"))
    both = F.when(start.isNotNull() & end.isNotNull(), F.concat_ws(" – ", start, end))
    text = F.coalesce(name, ref, both, F.concat_ws(" · ", operator, volts, known))
    source = F.when(name.isNotNull(), "osm-name").when(ref.isNotNull(), "osm-ref").when(both.isNotNull(), "osm-from-to").otherwise("generated-identifier")
    return text, source


def asset_id(country: Column, kind: Column) -> Column:
    return F.concat_ws("-", country, kind, osm_type(), id_suffix(F.coalesce(osm_id(), F.substring(F.sha2(F.col("geometry"), 256), 1, 12))))


def rejections(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def endpoints(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each ``by``): end points of every part (to four decimals), those that occur once, and their share.

    ``lines`` has ``parts``: arrays of points (lon, lat), one of a line and several of a multi-line.
    """
    at = lambda i: F.array(*[F.round(F.get(F.element_at("part", i), F.lit(k)), 4) for k in (0, 1)])
    ends = lines.select(*by, F.explode("parts").alias("part")).where("size(part) >= 2").select(*by, F.explode(F.array(at(1), at(-1))).alias("p"))
    each = ends.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"))
    got = each.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_ends"), F.count_if(F.col("n") == 1).alias("dangling"))
    return got.withColumn("share", F.round(F.when(F.col("n_ends") > 0, F.col("dangling") / F.col("n_ends")).otherwise(0.0), 6))


def density(lines: DataFrame) -> DataFrame:
    """(x, y, n): lines by square of one degree."""
    return lines.groupBy(F.floor("lon").alias("x"), F.floor("lat").alias("y")).agg(F.count(F.lit(1)).alias("n"))


#: Many more lines than before: in a square of one degree.
GAP = "n_new >= 5 and (n_old = 0 or (n_new >= n_old + 10 and 2 * n_new >= 3 * n_old))"


def gap_candidates(old: DataFrame, new: DataFrame, top: int = 20) -> DataFrame:
    """Squares where the new set has many more lines than the old one, the largest differences first."""
    both = density(old).withColumnRenamed("n", "n_old").join(density(new).withColumnRenamed("n", "n_new"), ["x", "y"], "full_outer").fillna(0, ["n_old", "n_new"])
    found = both.where(GAP).withColumn("delta", F.col("n_new") - F.col("n_old"))
    return found.orderBy(F.desc("delta"), "x", "y").limit(top)


def validated_union(old: DataFrame, new: DataFrame, verified: DataFrame) -> DataFrame:
    """The new set, and rows of the old one whose key is verified and missing in the new one."""
    add = old.join(verified, "key", "left_semi").join(new.select("key"), "key", "left_anti")
    return new.withColumn("fallback", F.lit(None).cast("string")).unionByName(add.withColumn("fallback", F.lit("legacy-validated")))


def key_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: keys in both, only in the new set, only in the old one."""
    a, b = old.select("key").distinct().withColumn("o", F.lit(1)), new.select("key").distinct().withColumn("f", F.lit(1))
    both = a.join(b, "key", "full_outer")
    return both.agg(F.count_if(F.expr("o = 1 and f = 1")).alias("shared"), F.count_if(F.expr("o is null")).alias("only_new"), F.count_if(F.expr("f is null")).alias("only_old"))


def collection_metrics(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of counts, ratios and gates_passed for each dataset of ``diagnostics``.

    ``rows`` has (dataset, seq, valid, inside, reason, key, power, kv, kvs, mismatch, name, ref, operator, osm_timestamp,
    parts), ``diagnostics`` what is known of the download: (dataset, partial, failed_requests, failed_listed, gap_tiles,
    exceeded_tiles). Of features that share a key the first counts. A download of which it is not known whether it is
    partial or had failures, or whose failed tiles are not listed, passes no gates.
    """
    # three aggregations read the rows, whose keys, voltages and reasons cost many patterns
    rows = settle(rows.select("dataset", "seq", "valid", "inside", "reason", "key", "power", "kv", "kvs", "mismatch", "name", "ref", "operator", "osm_timestamp", "parts"))
    valid, inside = F.coalesce("valid", F.lit(False)), F.coalesce("inside", F.lit(False))
    seen = valid & inside
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    every = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(~valid).alias("invalid"), F.count_if(valid & ~inside).alias("outside"),
        F.count_if(seen & (F.size("kvs") == 0)).alias("parse_failures"), F.count_if(seen & F.coalesce("mismatch", F.lit(False))).alias("mismatches"), F.count_if(F.col("reason") == "accepted").alias("_ok"),
    )
    kept = rows.where("reason = 'accepted'").groupBy("dataset", "key").agg(F.min_by(F.struct("power", "kv", "name", "ref", "operator", "osm_timestamp", "parts"), "seq").alias("r")).select("dataset", "r.*")
    line = F.col("power").isin(*LINES)
    firsts = kept.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_kept"), F.count_if(line).alias("lines"), F.count_if(F.col("power") == "substation").alias("substations"),
        F.count_if(line & (voltage_class(F.col("kv")) == "400")).alias("lines_400"), F.count_if(line & (voltage_class(F.col("kv")) == "154")).alias("lines_154"),
        F.count_if(line & full("name")).alias("named"), F.count_if(line & full("ref")).alias("referenced"), F.count_if(line & full("operator")).alias("operated"), F.count_if(full("osm_timestamp")).alias("timed"),
    )
    ends = endpoints(kept.where(line), ("dataset",)).select("dataset", "dangling", F.col("share").alias("dangling_ratio"))
    told = diagnostics.withColumn("failures_known", F.col("failed_requests").isNotNull())
    out = told.join(every, "dataset", "left").join(firsts, "dataset", "left").join(ends, "dataset", "left").fillna(0)
    out = out.withColumns({"duplicates": F.col("_ok") - F.col("_kept"), "_parsed": F.col("_kept") - F.col("parse_failures")})
    out = out.withColumns({f"{c}_ratio": ratio(c, "lines") for c in ("named", "referenced", "operated")} | {"timed_ratio": ratio("timed", "raw"), "parse_success_ratio": ratio("_parsed", "raw")})
    known = F.expr("partial is not null and failures_known and failed_listed")
    return out.withColumn("transparent", known).withColumn("gates_passed", F.expr("transparent and not partial and failed_requests = 0 and outside = 0 and invalid = 0 and duplicates = 0 and mismatches = 0 and gap_tiles = 0")).drop("_ok", "_kept", "_parsed", "failures_known")


def choose(old: Column, new: Column) -> Column:
    """Which of two gated sets is published: the fresh one if it passes its gates, else the existing one if that does, or none."""
    return F.when(F.coalesce(new, F.lit(False)), "fresh").when(F.coalesce(old, F.lit(False)), "existing").otherwise("none")


def choose_union(union: Column) -> Column:
    """Where two providers complete one another, their union is published if it passes its gates."""
    return F.when(F.coalesce(union, F.lit(False)), "validated-union").otherwise("none")


def compare_downloads(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row for every two downloads, as the existing and the fresh one: which of them is published, and whether their union passes.

    ``rows`` and ``diagnostics`` are those of ``collection_metrics``. The union has all of the fresh set and, of the existing
    one, the first accepted feature of each key that no accepted feature of the fresh set has. It is built, and has metrics
    and gates of its own, with what is known of the fresh download. Beside it: accepted keys in both and in either alone.
    Downloads are a handful: each row takes part in the unions with all of them.
    """
    rows = settle(rows.select("dataset", "seq", "valid", "inside", "reason", "key", "power", "kv", "kvs", "mismatch", "name", "ref", "operator", "osm_timestamp", "parts"))
    rest = [c for c in rows.columns if c not in ("dataset", "key")]
    firsts = settle(rows.where("reason = 'accepted'").groupBy("dataset", "key").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("dataset", "key", "r.*"))
    named = lambda c: F.broadcast(diagnostics.select(F.col("dataset").alias(c)))
    pair = lambda old, new: F.to_json(F.array(old, new))
    keys = lambda c: firsts.select(F.col("dataset").alias(c), "key")
    fresh = rows.crossJoin(named("existing")).withColumn("dataset", pair("existing", "dataset"))
    added = firsts.crossJoin(named("fresh")).join(keys("fresh"), ["fresh", "key"], "left_anti").withColumn("dataset", pair("dataset", "fresh"))
    union = fresh.select(rows.columns).unionByName(added.select(rows.columns))
    told = diagnostics.crossJoin(named("existing")).withColumn("dataset", pair("existing", "dataset")).drop("existing")
    passed = lambda met, key, c: met.select(F.col("dataset").alias(key), F.col("gates_passed").alias(c))
    own, unions = settle(collection_metrics(rows, diagnostics)), settle(collection_metrics(union, told))
    shared = keys("existing").join(keys("fresh"), "key").groupBy("existing", "fresh").agg(F.count(F.lit(1)).alias("shared"))
    n = lambda c: keys(c).groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    out = passed(own, "existing", "old").crossJoin(F.broadcast(passed(own, "fresh", "new"))).withColumn("pair", pair("existing", "fresh")).join(passed(unions, "pair", "both"), "pair")
    out = out.join(shared, ["existing", "fresh"], "left").join(n("existing"), "existing", "left").join(n("fresh"), "fresh", "left").fillna(0, ["shared", "n_existing", "n_fresh"])
    sets = ["shared", (F.col("n_fresh") - F.col("shared")).alias("only_fresh"), (F.col("n_existing") - F.col("shared")).alias("only_existing")]
    return out.select("existing", "fresh", choose(F.col("old"), F.col("new")).alias("selected"), choose_union(F.col("both")).alias("as_union"), *sets)


def provider_union(rows: DataFrame, by: str = "country") -> DataFrame:
    """Of ``rows`` (by, provider first or second, key, ...), all of the first provider, and those of the second one whose key the first one lacks."""
    first = rows.where("provider = 'first'")
    return first.unionByName(rows.where("provider = 'second'").join(first.select(by, "key").distinct(), [by, "key"], "left_anti"))


def source_validation(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row for each country of ``diagnostics``: is the union of two providers published.

    ``rows`` are those of ``collection_metrics`` with country and provider (first, second) in place of a dataset, and lon
    and lat; ``diagnostics`` too, with part (first, second, union). The union has metrics and gates of its own, and they
    alone decide. Beside it: accepted keys of both providers, of either alone and of the union, and the squares of one
    degree in which the union has many more lines than the first provider.
    """
    union = settle(provider_union(rows))
    named = lambda df, part: df.withColumn("dataset", F.concat_ws(":", "country", F.lit(part)))
    three = named(rows.where("provider = 'first'"), "first").unionByName(named(rows.where("provider = 'second'"), "second")).unionByName(named(union, "union"))
    met = collection_metrics(three, diagnostics.withColumn("dataset", F.concat_ws(":", "country", "part")).drop("country", "part"))
    met = met.withColumn("country", F.substring_index("dataset", ":", 1)).withColumn("part", F.substring_index("dataset", ":", -1))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{part}_{c}")
    wide = met.groupBy("country").agg(*[of(p, c) for p in ("first", "second", "union") for c in ("raw", "lines", "substations", "duplicates", "gates_passed")])
    ok = rows.where("reason = 'accepted'").groupBy("country", "key").agg(F.bool_or(F.col("provider") == "first").alias("a"), F.bool_or(F.col("provider") == "second").alias("b"))
    sets = ok.groupBy("country").agg(F.count_if(F.expr("a and b")).alias("shared"), F.count_if(F.expr("not b")).alias("only_first"), F.count_if(F.expr("not a")).alias("only_second"), F.count(F.lit(1)).alias("n_union"))
    lines = union.where("reason = 'accepted'").where(F.col("power").isin(*LINES)).groupBy("country", F.floor("lon").alias("x"), F.floor("lat").alias("y"))
    squares = lines.agg(F.count(F.lit(1)).alias("n_new"), F.count_if(F.col("provider") == "first").alias("n_old")).where(GAP).groupBy("country").agg(F.count(F.lit(1)).alias("gap_squares"))
    out = wide.join(sets, "country", "left").join(squares, "country", "left").fillna(0)
    return out.withColumn("selected", choose_union(F.col("union_gates_passed")))


def tiles(spark, west: float, south: float, east: float, north: float, step: float) -> DataFrame:
    """(x, y, w, s, e, n): tiles of an aligned grid that cover a box."""
    lo = lambda v: int(v // step)
    xs, ys = F.sequence(F.lit(lo(west)), F.lit(lo(east))), F.sequence(F.lit(lo(south)), F.lit(lo(north)))
    grid = spark.range(1).select(F.explode(xs).alias("x")).withColumn("y", F.explode(ys))
    return grid.select("x", "y", (F.col("x") * step).alias("w"), (F.col("y") * step).alias("s"), ((F.col("x") + 1) * step).alias("e"), ((F.col("y") + 1) * step).alias("n"))


def split_tiles(df: DataFrame) -> DataFrame:
    """Four children of each tile (w, s, e, n), with their number."""
    mx, my = (F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2
    part = lambda w, s, e, n: F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))
    kids = F.array(part(F.col("w"), F.col("s"), mx, my), part(mx, F.col("s"), F.col("e"), my), part(F.col("w"), my, mx, F.col("n")), part(mx, my, F.col("e"), F.col("n")))
    rest = [c for c in df.columns if c not in ("w", "s", "e", "n")]
    return df.select(*rest, F.posexplode(kids).alias("child", "k")).select(*rest, "child", "k.*")


def suspicious_empty(results: DataFrame, share: float = 0.1, busy: int = 2, total: int = 20) -> DataFrame:
    """Empty line tiles that their neighbours make doubtful: (x, y, busy, total).

    ``results`` has the tiles of one aligned grid: kind, depth, x, y, n (what was found) and inside (the share of the tile
    within the boundary, null without a boundary). Line tiles of depth 0 count alone. An empty one is doubtful if at least
    ``busy`` of those that share an edge with it found something, ``total`` together, and ``share`` of it lies inside.
    """
    line = results.where("kind = 'line' and depth = 0")
    beside = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("t")
    near = line.where("n > 0").select("n", beside).select(F.col("t.x").alias("x"), F.col("t.y").alias("y"), "n")
    empty = line.where("n = 0").where(F.coalesce(F.col("inside") >= share, F.lit(True))).select("x", "y")
    found = empty.join(near, ["x", "y"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("busy"), F.sum("n").alias("total"))
    return found.where((F.col("busy") >= busy) & (F.col("total") >= total))


def coverage(features: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, lines, substations) of features (power, w, s, e, n) whose box meets the box of a bounded table of regions."""
    r = F.broadcast(regions.select("region", *[F.col(c).alias(f"r_{c}") for c in "wsen"]))
    hit = r.join(features, (F.col("w") <= F.col("r_e")) & (F.col("e") >= F.col("r_w")) & (F.col("s") <= F.col("r_n")) & (F.col("n") >= F.col("r_s")), "left")
    return hit.groupBy("region").agg(F.count_if(F.col("power").isin(*LINES)).alias("lines"), F.count_if(F.col("power") == "substation").alias("substations"))


def voltage_layer(group: Column) -> Column:
    """The layer of a line by its voltage group; groups that are not known, or null, are ``unknown``."""
    return F.when(group.isin("300-500kV", ">500kV"), "400").when(group == "66-300kV", "154").when(group.isin("20-66kV", "<20kV"), "33").otherwise("unknown")


def country_layers(features: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """``features`` (kind, voltage_group, points: array of [lon, lat]) that belong to a box, with ``layer`` and points of five decimals.

    Lines belong to it if their boxes overlap or touch, and go by voltage; a substation is the middle of its own box, which
    must lie inside. Other kinds, and features without points, are left out.
    """
    lon, lat = F.transform("points", lambda p: F.get(p, F.lit(0))), F.transform("points", lambda p: F.get(p, F.lit(1)))
    ends = {"w": F.array_min(lon), "e": F.array_max(lon), "s": F.array_min(lat), "n": F.array_max(lat)}
    rows = features.where("kind in ('line', 'minor_line', 'substation') and size(points) > 0").withColumns({f"box_{k}": v for k, v in ends.items()})
    rows = rows.where((F.col("box_e") >= west) & (F.col("box_w") <= east) & (F.col("box_n") >= south) & (F.col("box_s") <= north))
    station = F.col("kind") == "substation"
    mid = [(F.col("box_w") + F.col("box_e")) / 2, (F.col("box_s") + F.col("box_n")) / 2]
    rows = rows.where(~station | (mid[0].between(west, east) & mid[1].between(south, north)))
    points = F.transform(F.when(station, F.array(F.array(*mid))).otherwise(F.col("points")), lambda p: F.transform(p, lambda x: F.round(x, 5)))
    layer = F.when(station, "substations").otherwise(voltage_layer(F.coalesce("voltage_group", F.lit("unknown"))))
    return rows.withColumns({"layer": layer, "points": points}).drop(*[f"box_{k}" for k in ends])
