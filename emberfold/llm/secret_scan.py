"""Secrets in texts, and weak candidates confirmed by the complementary parts beside them.

Three kinds are reported wherever they stand: assignments of secret names (assign), access identifiers (access) and long
hexadecimal runs (hex). A credential often has several parts, and some of them look harmless alone: login names (ident),
opaque tokens and values of vaguer names (opaque, weak), and addresses of services (endpoint). Parts are joined by
interval: two parts are in one scope if at most SCOPE characters lie between them in one text. A secret-like weak part
is reported if an identifier is in its scope, an identifier if a secret is, an endpoint if both are.

Parts meet in buckets of BUCKET characters of one text. Spans of a kind do not overlap and have a least length, so that
a bucket holds a bounded number of them, however long the text is or however often it is repeated: repeated texts are
known by their digest and joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.columns import let
from emberfold.llm.common import settle, small

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20{0,9}[:=]\x20{0,9}["']?[A-Za-z0-9+/_.@-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{32,}={0,2}"
WEAK = r"""(?i)(?:pwd|pass|auth|credentials?|private_?key)["']?\x20{0,9}[:=]\x20{0,9}["']?[^\x00-\x20"']{4,}"""
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?i:host|endpoint|server)["']?\x20{0,9}[:=]\x20{0,9}["']?[A-Za-z0-9.-]{3,}"""
#: In the order in which kinds are listed, with the role of each.
BASE = ("assign", "access", "hex")
ADDED = ("ident", "opaque", "weak", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "opaque": "secret", "weak": "secret", "endpoint": "endpoint"}
SCOPE, BUCKET = 200, 256
#: Matches whose places are added up one after the other; pieces of so many are then moved by what lies before them.
PIECE = 256
HIDDEN = "[REDACTED]"

SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _spans(text: Column, pattern: str, rank: int, good=None, group: int = 0) -> Column:
    """(start, rank, stop) of the matches of ``pattern``, in code points; ``good`` says of a group's text whether it counts."""

    def places(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["gap"])
            stop = start + F.length(x["match"])
            found = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop")))
            out = F.concat(a["out"], found) if good is None else F.when(good(x["part"]), F.concat(a["out"], found)).otherwise(a["out"])
            return F.struct(stop.alias("at"), out.alias("out"))

        part = m if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        # the gap after the last match has no match, and is left out
        zipped = F.slice(F.arrays_zip(gaps.alias("gap"), m.alias("match"), part.alias("part")), F.lit(1), F.size(m))

        def pieces(z: Column) -> Column:
            last = F.floor((F.size(z) - 1) / PIECE).cast("int")
            return F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(z, i * PIECE + 1, F.lit(PIECE)), begin, step))

        def moved(p: Column) -> Column:
            ends = F.aggregate(p, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
            by = lambda e, i, s: F.struct((s["start"] + F.get(e, i)).alias("start"), s["rank"].alias("rank"), (s["stop"] + F.get(e, i)).alias("stop"))
            return let(ends, lambda e: F.flatten(F.transform(p, lambda x, i: F.transform(x["out"], lambda s: by(e, i, s)))))

        return let(zipped, lambda z: let(pieces(z), moved))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)).otherwise(F.array().cast(SPAN))


def _mixed(x: Column) -> Column:
    return x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, key (digest of the text), base and spans (sorted arrays of start, kind's rank and stop) for each row of ``docs``.

    ``base`` has the three kinds that always count, ``spans`` these and the weak parts that are confirmed. A null text
    is empty and has none. Rows that repeat each have their own result; null ids and other columns change nothing; an
    empty table gives an empty table.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rank = {k: i for i, k in enumerate(BASE + ADDED)}
    base = F.sort_array(F.concat(_spans(t, ASSIGN, 0, lambda v: F.length(v) >= 6, 2), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    added = F.concat(_spans(t, IDENT, rank["ident"]), _spans(t, OPAQUE, rank["opaque"], _mixed), _spans(t, WEAK, rank["weak"]), _spans(t, ENDPOINT, rank["endpoint"]))
    rows = settle(docs.select("doc_id", F.unhex(F.md5(t.cast("binary"))).alias("key"), base.alias("base"), added.alias("added")))

    live = rows.where(F.size("added") > 0).select("key", "base", "added").dropDuplicates(["key"])
    role = F.create_map(*[F.lit(x) for k in BASE + ADDED for x in (rank[k], ROLE[k])])
    parts = live.select("key", F.explode(F.concat("base", "added")).alias("s")).select("key", "s.*", role[F.col("s.rank")].alias("role"))
    parts = settle(parts)
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET))).alias("bucket")
    asked = parts.where(F.col("rank") >= len(BASE)).select("*", bucket(F.greatest(F.lit(0), F.col("start") - scope), F.col("stop") + scope))
    there = parts.select("key", F.col("start").alias("from"), F.col("stop").alias("to"), F.col("role").alias("other"), bucket(F.col("start"), F.col("stop")))
    # one part can be found as several kinds: a span complements another only where they don't overlap
    beside = "other <> role and ((`from` >= stop and `from` - stop <= {0}) or (`to` <= start and start - `to` <= {0}))".format(scope)
    met = asked.join(there, ["key", "bucket"]).where(beside)
    met = met.groupBy("key", "start", "rank", "stop", "role").agg(F.bool_or(F.col("other") == "identifier").alias("id"), F.bool_or(F.col("other") == "secret").alias("secret"))
    sure = met.where("(role = 'secret' and id) or (role = 'identifier' and secret) or (role = 'endpoint' and id and secret)")
    sure = settle(sure.groupBy("key").agg(F.collect_list(F.struct("start", "rank", "stop")).alias("more")))
    out = rows.join(small(sure, weigh=F.size("more") * 32 + 64), "key", "left")
    more = F.coalesce("more", F.array().cast(SPAN))
    return out.select("doc_id", "key", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*map(F.lit, BASE + ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by HIDDEN (spans that touch or overlap as one), and n_chars brought up to date.

    The caller's columns travel as one struct, whatever their names.
    """
    spans = settle(scan(docs, scope).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"]))
    text = F.col("row.text")
    rows = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(small(spans, weigh=F.size("spans") * 32 + 64), "key", "left")

    def merge(a: Column, s: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        wide = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(a) > 0) & (s["start"] <= last["stop"]), wide).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))

    def hide(m: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["stop"], F.lit(0))
        kept = F.transform(m, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit(HIDDEN)))
        return F.concat(F.array_join(kept, ""), F.substring(text, before(F.size(m)) + 1, F.length(text)))

    merged = F.aggregate("spans", F.array().cast("array<struct<start:int,stop:int>>"), merge)
    found = F.col("spans").isNotNull()
    out = rows.select("row", found.alias("found"), F.when(found, let(merged, hide)).otherwise(text).alias("text"))
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("found"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return out.select(*[x.alias(c) for c, x in kept.items()])


def oracle() -> str:
    """DuckDB SQL of the query's columns."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "opaque": OPAQUE, "weak": WEAK, "endpoint": ENDPOINT}
    good = {"assign": "length(g2) >= 6", "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"}
    one = []
    for rank, (kind, p) in enumerate(patterns.items()):
        second = f"unnest(regexp_extract_all(t, {quote(p)}, 2))" if kind == "assign" else "''"
        rows = f"SELECT rid, unnest(regexp_split_to_array(t, {quote(p)})[:len(regexp_extract_all(t, {quote(p)}))]) AS gap, unnest(regexp_extract_all(t, {quote(p)})) AS m, {second} AS g2, unnest(range(1, len(regexp_extract_all(t, {quote(p)})) + 1)) AS i FROM d WHERE regexp_matches(t, {quote(p)})"
        ends = f"SELECT rid, m, g2, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM ({rows})"
        one.append(f"SELECT rid, {rank} AS rank, '{kind}' AS kind, '{ROLE[kind]}' AS role, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM ({ends}) WHERE {good.get(kind, 'true')}")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    s AS MATERIALIZED ({' UNION ALL '.join(one)}),
    met AS (SELECT a.rid, a.start, a.rank, a.stop, a.kind, a.role, bool_or(b.role = 'identifier') AS id, bool_or(b.role = 'secret') AS secret FROM s a JOIN s b ON a.rid = b.rid AND a.role <> b.role
      AND ((b.start >= a.stop AND b.start - a.stop <= {SCOPE}) OR (b.stop <= a.start AND a.start - b.stop <= {SCOPE})) WHERE a.rank >= {len(BASE)} GROUP BY ALL),
    al AS (SELECT rid, start, rank, stop, kind FROM s WHERE rank < {len(BASE)} UNION ALL SELECT rid, start, rank, stop, kind FROM met WHERE (role = 'secret' AND id) OR (role = 'identifier' AND secret) OR (role = 'endpoint' AND id AND secret)),
    g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM al GROUP BY rid)
    SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
