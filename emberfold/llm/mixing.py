"""Mixing sources to target weights by a low-discrepancy schedule of blocks.

Slot ``i`` of a schedule is the point ``frac((i + 1) * golden ratio)`` on a line on which every source owns a stretch
as long as its target share. Slots are ranked within their source. The source's documents, shuffled by a hash, are one
stream of words (unrolled up to three times) that is cut into blocks of one size, and slot ``k`` of a source takes its
block ``k``. So the schedule alone says how many words a source gives, and in what order the mix takes them; low
discrepancy brings the words near the target.

Sources of like targets share a schedule and the size of a block (256 words, 64, 16, 4 or 1), so that the target of each
source is FINE blocks at least, or else counted by words. The schedules run beside each other, each from the start to the
end of the mix. There are as many slots as targets of small sources have words, and one for 256 words of the others.

Nothing is ordered or summed over a whole source in one task: ranks and offsets come from totals of about
``sqrt(rows)`` chunks per source, and a window inside a chunk. Only the table of sources (one slim row per source) is
ordered as a whole, by one task that can spill.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfold.llm.common import WORD, settle, small

getcontext().prec = 40
GOLDEN = (Decimal(5).sqrt() - 1) / 2
#: A slot number is split at this power of two, so that the point keeps ten decimals at any slot number.
SPLIT = 1 << 20
#: A line is cut into this many cells at least, and STRETCHES for each source.
CELLS, STRETCHES = 1 << 12, 4
#: A block has at most BLOCK words, and FINE of them at least go into a source's target, or it has one word.
BLOCK, FINE = 256, 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, sid, source_size, weight, target) of a table (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size, and what is above is shared again by weight: sources fill up in the order of
    size by weight, so the level at which the rest stops follows from running sums.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = total.withColumn("sid", F.row_number().over(by_name) - 1)
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", turn).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - before) / after
    open_at = F.when(F.col("cap") / F.col("weight") >= level, level)
    stop = F.max("open_at").over(everything)
    filled = named.withColumn("open_at", open_at).withColumn("stop", stop)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("stop") * F.col("weight"), F.lit(0.0)))
    return filled.select("source", "sid", "source_size", "weight", target.cast("double").alias("target"))


def _points(spark, n: int) -> DataFrame:
    """(slot, u): the golden-ratio sequence in [0, 1)."""
    low, high = float(GOLDEN), float(GOLDEN * SPLIT % 1)
    i = F.col("id") + 1
    u = F.pmod(F.floor(i / SPLIT) * F.lit(high) + F.pmod(i, F.lit(SPLIT)) * F.lit(low), F.lit(1.0))
    return spark.range(n).select(F.col("id").alias("slot"), u.alias("u"))


def _ranked(rows: DataFrame, chunk: str, order: list, value: str | None = None) -> DataFrame:
    """Adds ``rank``: rows (or the sum of ``value``) of the same sid that come before, in the order (chunk, *order)."""
    add = F.count(F.lit(1)) if value is None else F.sum(value)
    sums = rows.groupBy("sid", chunk).agg(add.alias("n"))
    ahead = Window.partitionBy("sid").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", chunk, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", chunk).orderBy(*order)
    if value is None:
        within = F.row_number().over(inside) - 1
    else:
        within = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(small(base), ["sid", chunk]).withColumn("rank", F.col("base") + F.col("within")).drop("within", "base")


def block_words(target: Column, most: int = BLOCK) -> Column:
    """Words in a block of a source: ``most``, or a quarter, a sixteenth ... of it, so that FINE blocks go into the target."""
    sizes = [most >> k for k in range(0, most.bit_length(), 2) if most >> k > 1]
    return reduce(lambda col, b: col.when(target >= b * FINE, b), sizes, F.when(F.lit(False), 1)).otherwise(1).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, sid, rank): which source each slot takes from, by its place in the mix in words, and how many slots of the source come before.

    ``sources`` has (sid, target, block). A source with a target that no point reaches has as many slots as its target is
    blocks, after all others.
    """
    spark = sources.sparkSession
    line = Window.partitionBy("block")
    share = sources.where("target >= 1").select("sid", "block", "target").withColumn("hi", F.sum("target").over(line.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
    share = share.withColumn("all", F.max("hi").over(line))
    ends = settle(share.select("sid", "block", "target", "all", ((F.col("hi") - F.col("target")) / F.col("all")).alias("lo"), F.when(F.col("hi") == F.col("all"), 1.0).otherwise(F.col("hi") / F.col("all")).alias("hi")))
    # one row for each size of a block
    lines = ends.groupBy("block").agg(F.round(F.max("all")).cast("long").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    whole = sum(r["words"] for r in lines)
    hit = None
    for r in sorted(lines, key=lambda r: r["block"]):
        block, n = r["block"], -(-r["words"] // r["block"])
        cells = max(CELLS, 1 << (STRETCHES * r["n"]).bit_length())
        own = ends.where(F.col("block") == block)
        stretch = own.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
        points = _points(spark, n).withColumn("cell", F.floor(F.col("u") * cells))
        met = points.join(small(stretch), "cell").where("u >= lo and u < hi")
        chunk = max(1024, math.isqrt(n))
        place = F.floor(F.col("slot") * F.lit(block * whole / r["words"])).cast("long")
        met = met.select("sid", "slot", place.alias("place"), F.floor(F.col("slot") / chunk).alias("chunk"))
        hit = met if hit is None else hit.unionByName(met)
    if hit is None:
        return ends.select(F.col("sid").cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    hit = settle(_ranked(hit, "chunk", ["slot"]).select(F.col("place").alias("slot"), "sid", F.col("rank").cast("long").alias("rank")))
    blocks = F.greatest(F.lit(1), F.round(F.col("target") / F.col("block"))).cast("long")
    late = ends.join(hit, "sid", "left_anti").select((F.lit(whole) + F.col("sid")).cast("long").alias("slot"), "sid", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("rank"))
    return hit.unionByName(late)


def _key() -> Column:
    """The shuffle: documents of a source stand in the order of this digest."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).cast("binary"))


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` (of doc_id and source), size, source_size, target, taken, n_slots (blocks that took words of the document), first_slot (the first of
    them by its place in the mix, in words; null if none) and key (the digest it is shuffled by).

    Size is the number of words (null text: 0). A source gives a block (of ``block`` words at most, see ``block_words``) for each
    of its slots, up to ``most`` times its size, and so does no document give more than ``most`` times its size.
    An empty table gives an empty table, rows that repeat are documents of their own, null ids are kept, a null source is
    one of the sources, columns beside doc_id, text and source are ignored. Without any word, nothing is taken.
    """
    slim = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _key().alias("key"))
    slim = settle(slim.withColumn("rid", F.monotonically_increasing_id()))
    sources = settle(targets(slim, weights, most).withColumn("block", block_words(F.col("target"), block)))
    rows = slim.count()
    slots = settle(schedule(sources))
    plan = sources.join(small(slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))), "sid", "left")
    # words of the source's unrolled stream that lie in blocks with a slot
    plan = settle(plan.withColumn("stop", F.least(F.coalesce("n", F.lit(0)) * F.col("block"), F.col("source_size") * most)))

    chunks = max(1, math.isqrt(rows))
    owned = slim.join(small(plan), slim["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    # digests of one chunk stand together in the order of all
    owned = owned.withColumn("chunk", F.expr(f"(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * {chunks}L) div 4294967296L"))
    stream = _ranked(owned, "chunk", ["key", "size", "rid"], "size")
    copies = stream.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("x", F.col("copy") * F.col("source_size") + F.col("rank")).withColumn("y", F.least(F.col("x") + F.col("size"), F.col("stop"))).where("x < y")
    pieces = copies.withColumn("k", F.explode(F.sequence(F.expr("x div block"), F.expr("(y - 1) div block"))))
    words = F.least(F.col("y"), (F.col("k") + 1) * F.col("block")) - F.greatest(F.col("x"), F.col("k") * F.col("block"))
    pieces = pieces.select("rid", "sid", F.col("k").cast("long").alias("rank"), words.alias("words"))
    taken = pieces.join(slots, ["sid", "rank"]).groupBy("rid").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_slots"), F.min("slot").alias("first_slot"))
    out = owned.select("rid", *keep, "key", "size", "source_size", "target").join(taken, "rid", "left")
    zero = F.lit(0).cast("long")
    return out.select(*keep, "size", "source_size", "target", F.coalesce("taken", zero).cast("long").alias("taken"), F.coalesce("n_slots", zero).alias("n_slots"), "first_slot", "key")


def mixed_rows(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of ``docs`` with their own columns, and taken and first_slot of ``mix`` (in place of columns so named).

    Rows of one doc_id, source and text are alike, and share out what ``mix`` takes of them among themselves. The caller's
    columns travel as one struct, whatever their names.
    """
    alike = ["source", "key"]
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("source")
    theirs = docs.select(source, _key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = settle(mix(docs.select("doc_id", "text", "source"), block, weights, most, keep=("source",)).select(source, "key", "taken", "first_slot"))
    again = settle(own.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*alike))
    nth = Window.partitionBy(*alike)
    some = lambda df, order: df.join(small(again), alike, "left_semi").withColumn("nth", F.row_number().over(nth.orderBy(*order)))
    once = theirs.join(small(again), alike, "left_anti").join(own, alike)
    rest = some(theirs, alike).join(some(own, ["first_slot", "taken"]), [*alike, "nth"]).drop("nth")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("taken", "first_slot")]
    return once.unionByName(rest).select(*kept, "taken", "first_slot")


def oracle() -> str:
    """DuckDB SQL of doc_id, size, source_size, target, taken, n_slots and first_slot (-1 if none): blocks are looked up in one stream per source."""
    low, high = float(GOLDEN), float(GOLDEN * SPLIT % 1)
    blocks = " ".join(f"WHEN target >= {b * FINE} THEN {b}" for b in (256, 64, 16, 4))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS key FROM documents),
    a AS (SELECT *, CAST([1, 2, 3][CAST(sid % 3 + 1 AS INT)] AS BIGINT) AS weight, 3 * source_size AS cap FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source)),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a),
    t AS MATERIALIZED (SELECT source, sid, source_size, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN cap / weight >= level THEN level END) OVER () * weight, 0)) AS target FROM l),
    b AS MATERIALIZED (SELECT *, CAST(CASE {blocks} ELSE 1 END AS BIGINT) AS block FROM t),
    c AS (SELECT sid, block, target, sum(target) OVER (PARTITION BY block ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM b WHERE target >= 1),
    e AS MATERIALIZED (SELECT sid, block, target, lead, (hi - target) / lead AS lo, CASE WHEN hi = lead THEN 1 ELSE hi / lead END AS hi FROM (SELECT *, max(hi) OVER (PARTITION BY block) AS lead FROM c)),
    n AS MATERIALIZED (SELECT *, (words + block - 1) // block AS n, CAST(sum(words) OVER () AS BIGINT) AS whole FROM (SELECT block, CAST(round(max(lead)) AS BIGINT) AS words FROM e GROUP BY block)),
    p AS (SELECT block, i AS slot, CAST(floor(i * (CAST(block * whole AS DOUBLE) / words)) AS BIGINT) AS place, (CAST((i + 1) // {SPLIT} AS DOUBLE) * CAST({high!r} AS DOUBLE) + CAST((i + 1) % {SPLIT} AS DOUBLE) * CAST({low!r} AS DOUBLE)) % 1 AS u FROM (SELECT *, unnest(range(n)) AS i FROM n)),
    h AS (SELECT place AS slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM p JOIN e ON p.block = e.block AND u >= lo AND u < hi),
    s AS MATERIALIZED (SELECT * FROM h UNION ALL SELECT whole + sid, sid, unnest(range(greatest(1, CAST(round(target / e.block) AS BIGINT)))) FROM e JOIN n ON n.block = e.block WHERE sid NOT IN (SELECT sid FROM h)),
    m AS (SELECT sid, count(*) AS slots FROM s GROUP BY sid),
    o AS (SELECT d.*, sid, source_size, target, least(coalesce(slots, 0) * block, 3 * source_size) AS stop, block, sum(size) OVER (PARTITION BY sid ORDER BY key, size, rid) - size AS place FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN m USING (sid)),
    q AS (SELECT rid, sid, block, x, least(x + size, stop) AS y FROM (SELECT *, place + r * source_size AS x FROM (SELECT *, unnest([0, 1, 2]) AS r FROM o WHERE size > 0)) WHERE x < stop),
    k AS (SELECT rid, sid, x, y, block, unnest(range(CAST(x // block AS BIGINT), CAST((y - 1) // block + 1 AS BIGINT))) AS rank FROM q),
    g AS (SELECT rid, sum(least(y, (rank + 1) * block) - greatest(x, rank * block)) AS taken, count(*) AS n_slots, min(slot) AS first_slot FROM k JOIN s USING (sid, rank) GROUP BY rid)
    SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots, CAST(coalesce(first_slot, -1) AS BIGINT) AS first_slot FROM o LEFT JOIN g USING (rid)"""
