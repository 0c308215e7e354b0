"""Near-duplicates by MinHash: universal hash minima, bands, verification, and connected components.

Documents with the same set of shingles form a class that its smallest doc_id stands for, and only these take part in
what follows. A band bucket is never paired out. Its members are first compared with its smallest member alone (a star),
and the stars' links are merged into components. A bucket is looked at again only if it still holds several of them. Of
the documents in such buckets, only pairs of different components are made that meet in the prefixes of their sets, the
items ordered by how rare they are there, with bounds on sizes and positions: edits of a text are rarer than what its
copies share, so that a large group of near copies makes few pairs. Every link is confirmed on the whole sets.

With 48 bands of 6 minima a pair of similarity 0.8 shares no band with a probability of 5e-7, one of 0.85 of 2e-11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import LOWER, SPACE, UPPER, among, settle, small
from emberfold.llm.textbits import BYTES, mix, piece_hash, prefix_sums, whole
from emberfold.operators.graph import components

BANDS, ROWS = 48, 6
MINIMA = BANDS * ROWS
_rng = np.random.default_rng(20240607)
MULTIPLY = (_rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1))[:, None]
ADD = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``n``-word shingles (ASCII letters lower-cased).

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    raw = [t.encode().lower() for t in texts]
    none = np.zeros(0, np.uint64)
    out = [none] * len(raw)
    for group in whole(raw):
        buf = np.frombuffer(b" ".join(raw[i] for i in group) + b" ", np.uint8)
        space = SPACES[buf]
        before = np.concatenate(([True], space[:-1]))
        start, stop = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        if not len(start):
            continue
        word = piece_hash(prefix_sums(BYTES[buf]), start, stop)
        ends = np.cumsum([len(raw[i]) + 1 for i in group])
        cuts = np.concatenate(([0], np.searchsorted(start, ends)))
        full = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for j in range(n):
            full = mix(full + word[j : len(word) - n + 1 + j]) if len(full) else full
        for g, i in enumerate(group):
            a, b = cuts[g], cuts[g + 1]
            if b - a >= n:
                out[i] = np.unique(full[a : b - n + 1])
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in word[a:b]:
                    h = mix(h + w)
                out[i] = h
    return out


def minima(items: np.ndarray) -> np.ndarray:
    """MINIMA minima of a * x + b over the items, modulo 2**32."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, (MULTIPLY * x[at : at + 2048] + ADD).min(1))
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of (documents, MINIMA) minima."""
    parts = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), parts.shape[:2])
    for j in range(ROWS):
        key = mix(key + parts[:, :, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set), bands and signature (a byte of each minimum) of each row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                sets = shingle_sets(part["text"].tolist(), n)
                low = np.vstack([minima(s) for s in sets])
                keys = band_keys(low)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].values,
                    "n_shingles": [len(s) for s in sets],
                    "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "bands": [keys[i] if len(s) else None for i, s in enumerate(sets)],
                    "signature": [r.astype(np.uint8).tobytes() for r in low],
                })

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return asked.mapInPandas(rows, "doc_id long, n_shingles long, key binary, bands array<long>, signature binary")


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, items) of the documents in ``ids``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                sets = shingle_sets(part["text"].tolist(), n)
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "items": [s.view(np.int64) for s in sets]})

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return among(asked, ids, "doc_id").mapInPandas(rows, "doc_id long, items array<long>")


def _similar(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(u, v, both, either): sizes of intersection and union of the whole sets of each pair."""
    ids = settle(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    sets = _sets(docs, ids, n)
    u = sets.select(F.col("doc_id").alias("u"), F.col("items").alias("a"))
    v = sets.select(F.col("doc_id").alias("v"), F.col("items").alias("b"))
    # pairs are slim, and many can share their v, so that sets come to them there; what has grown wide is dealt out by u
    out = pairs.join(v, "v").join(u, "u").select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), F.size("a").alias("na"), F.size("b").alias("nb"))
    return out.select("u", "v", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"))


def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of minima whose bytes agree, less what agrees by chance."""
    x = [np.frombuffer(s, np.uint8) == np.frombuffer(t, np.uint8) for s, t in zip(a, b, strict=True)]
    return pd.Series([(float(e.mean()) - 1 / 256) / (1 - 1 / 256) for e in x], index=a.index)


def _prefix_pairs(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(u, v) of different labels, one of them odd, that can be similar by the prefixes of their sets in order of rarity.

    ``members`` has (doc_id, label, odd). Two sets of n <= m items that are similar share at least p (n + m) / (100 + p)
    of them, so that they meet within the first n - 2 p n / (100 + p) + 1 items of the one and the first
    m - p m / 100 + 1 of the other, and as many are left from where they first meet. Rows of a document that have one set
    count once, so that positions are those of distinct items.
    """
    full = sets.withColumn("sid", F.xxhash64("items")).dropDuplicates(["doc_id", "sid"]).select("doc_id", "sid", F.size("items").alias("n"), F.explode("items").alias("item"))
    full = settle(full)
    often = settle(full.groupBy("item").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    ranked = full.join(small(often), "item", "left").groupBy("doc_id", "sid", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "item"))).alias("items"))
    wide = F.expr(f"n - (({percent}L * n + 99) div 100) + 1").cast("int")
    narrow = F.expr(f"n - ((2L * {percent} * n + {99 + percent}) div {100 + percent}) + 1").cast("int")
    rows = ranked.select("doc_id", "n", narrow.alias("narrow"), F.posexplode(F.slice("items", F.lit(1), wide)).alias("at", "x")).select("doc_id", "n", "narrow", "at", F.col("x.item").alias("item"))
    rows = settle(rows.join(small(members), "doc_id"))
    left = rows.where("odd").drop("odd")
    right = rows.select("item", *[F.col(c).alias(f"{c}_v") for c in ("doc_id", "n", "narrow", "at", "label")])
    fits = f"100L * least(n, n_v) >= {percent}L * greatest(n, n_v) and {100 + percent}L * least(n - at, n_v - at_v) >= {percent}L * (n + n_v)"
    near = "(n <= n_v and at < narrow) or (n_v <= n and at_v < narrow_v)"
    pairs = left.join(right, "item").where(f"label <> label_v and ({fits}) and ({near})")
    return pairs.select(F.least("doc_id", "doc_id_v").alias("u"), F.greatest("doc_id", "doc_id_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Texts are linked if 100 * intersection >= percent * union of their sets of ``n``-word shingles; component_id is the
    smallest doc_id that links reach. A text that is null or has no word is linked with nothing. Rows that share a doc_id
    are one document: each has its own n_shingles, links of any of them are links of the document. A null doc_id is a
    document of its own that is kept and has a null component. An empty table gives an empty table.
    """
    rows = settle(sketches(docs, n))
    live = rows.where("n_shingles > 0 and doc_id is not null")
    first = live.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    first = settle(first)
    member = live.select("key", "doc_id").join(first.where("rep < last"), "key").where("doc_id <> rep").select("doc_id", "rep").distinct()
    member = settle(member)
    # documents of several rows can belong to several classes
    doubled = live.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id")
    bridges = member.join(doubled, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    reps = live.join(first.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi")
    spread = reps.select("doc_id", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").select("band", "centre")
    crowd = settle(spread.join(buckets, "band"))
    stars = settle(crowd.where("doc_id <> centre").select(F.col("doc_id").alias("u"), F.col("centre").alias("v")).distinct())
    known = settle(_similar(docs, stars, n))
    linked = F.expr(f"100L * both >= {percent}L * either")
    links = settle(known.where(linked).select("u", "v").union(bridges))
    found = settle(components(links).dropDuplicates(["node"]))

    # buckets that still hold several components: those of their members that lie outside the most common one
    told = crowd.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    votes = told.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    mixed = told.join(votes.where("labels > 1").select("band", F.col("main.label").alias("main")), "band")
    mixed = settle(mixed.groupBy("doc_id", "label").agg(F.max(F.col("label") != F.col("main")).alias("odd")))
    if mixed.head(1):
        rest = settle(_prefix_pairs(_sets(docs, mixed.select("doc_id"), n), mixed, percent))
        # a document of several sets has several signatures, and any two of a pair may agree
        sign = reps.select("doc_id", "key", "signature").dropDuplicates(["doc_id", "key"]).drop("key")
        both = rest.join(sign.select(F.col("doc_id").alias("u"), F.col("signature").alias("a")), "u").join(sign.select(F.col("doc_id").alias("v"), F.col("signature").alias("b")), "v")
        # six standard deviations of the estimate below the threshold
        agree = F.pandas_udf(_agree, "double")
        rest = settle(both.where(agree("a", "b") >= percent / 100 - 6 * (0.25 / MINIMA) ** 0.5).select("u", "v").distinct())
        more = settle(_similar(docs, rest, n).where(linked).select("u", "v"))
        if more.head(1):
            found = settle(components(links.union(more)).dropDuplicates(["node"]))

    node = F.coalesce("rep", "doc_id")
    belongs = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = rows.select("doc_id", "n_shingles").join(belongs, "doc_id", "left").withColumn("node", node)
    out = out.join(found, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their own columns, of the smallest doc_id of each group of near-duplicates."""
    gone = settle(near_duplicates(docs, n, percent).where("not kept").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def oracle(n: int = 2, percent: int = 80) -> str:
    """DuckDB SQL of the query's columns: all shared shingles are counted, and links are followed to their end."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({low}, '{SPACE}'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: {run}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * k >= {percent} * (x.n + y.n - k)),
    b AS (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e),
    reach(a, b) AS (SELECT doc_id, doc_id FROM c UNION SELECT r.a, b.b FROM reach r JOIN b ON r.b = b.a),
    m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""
