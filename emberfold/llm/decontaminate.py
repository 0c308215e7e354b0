"""Benchmark decontamination by a prefix-filtered set join.

A window of a benchmark item (ten words, or the whole of a shorter item) is a set of overlapping word shingles, and a
document contains it only if it has all of them: containment 1, for which one shingle is a sufficient prefix. Shingles
are ordered by how rare they are in the documents, and each window is looked for at its rarest one alone. The position
of that shingle says where the window would have to begin, which must lie inside the document, and the words there are
then compared with the window's.

Of the documents' shingles only those of the benchmark go on, by a broadcast, or by a sieve of bits and a join of what it leaves.

Copies of a text are looked up once: until the last join, documents are known by the digest of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.columns import covered, let, shingle_hashes
from emberfold.llm.common import among, ascii_lower, settle, small

APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 4


def item_words(text: Column) -> Column:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII; none for null."""
    low = F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART, -1)
    return F.filter(low, lambda w: w != "")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, window, length): the distinct windows of each item, words joined by blanks."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    long = F.least(F.size("w"), F.lit(window)).alias("length")
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.least(F.size("w"), F.lit(window)) + 1)).alias("at")
    return items.select("item_id", "w", long, starts).select("item_id", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("window"), "length").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (digest of the text), n_words, n_hit, items (sorted ids as strings) and contaminated, for each row of ``docs``.

    Null or empty texts have no words and are hit by nothing; an item without words hits nothing; items that repeat, or
    share windows, each count by item_id (a null one is not listed). Rows that repeat each have their own result. An
    empty table of documents gives an empty table. ``benchmark`` is broadcast up to a size that is checked.
    """
    owned = settle(windows(benchmark, window))
    wanted = owned.select("window", "length").distinct()
    grams = wanted.select("window", "length", F.posexplode(let(F.split("window", " "), lambda w: F.when(F.size(w) >= shingle, shingle_hashes(w, shingle)).otherwise(F.array(F.xxhash64(w))))).alias("offset", "gram"))
    grams = settle(grams)
    sizes = [r[0] for r in grams.select(F.least("length", F.lit(shingle)).alias("k")).distinct().collect()]
    asked = settle(grams.select("gram").distinct())

    def hashed(words: Column) -> Column:
        """Position and hash of the shingles of every size that windows have."""
        return F.flatten(F.array(*[F.transform(shingle_hashes(words, k), lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))) for k in sorted(sizes)]))

    seen = None
    if sizes:
        each = docs.select(_key(F.col("text")).alias("key"), let(item_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), hashed(w).alias("grams"))).alias("s"))
        seen = among(each.select("key", F.col("s.n").alias("n"), F.inline("s.grams")), asked, "gram")
    if seen is None:
        none = docs.select("doc_id", _key(F.col("text")).alias("key"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
        return none.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "contaminated": F.lit(False)})
    seen = settle(seen.groupBy("key", "n", "pos", "gram").agg(F.count(F.lit(1)).alias("copies")))

    common = seen.groupBy("gram").agg(F.sum("copies").alias("copies"))
    ranked = grams.join(small(common), "gram", "left")
    rarest = ranked.groupBy("window", "length").agg(F.min(F.struct(F.coalesce("copies", F.lit(0)).alias("copies"), "gram", "offset")).alias("first"))
    prefix = settle(rarest.where("first.copies > 0").select("window", "length", "first.gram", "first.offset"))
    start = F.col("pos") - F.col("offset")
    near = seen.join(small(prefix), "gram").withColumn("start", start).where("start >= 0 and start + length <= n")
    near = near.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop"), "window")).alias("near"))
    near = settle(near)

    # only texts with candidates move, and each of them once; what is found comes to the documents by the texts' digests
    texts = among(docs.select(_key(F.col("text")).alias("key"), "text"), near.select("key"), "key").dropDuplicates(["key"])
    size = F.aggregate("near", F.lit(64), lambda a, x: a + F.octet_length(x["window"]) + 48)
    sure = lambda w: F.filter(F.sort_array("near"), lambda c: F.array_join(F.slice(w, c["start"] + 1, c["stop"] - c["start"]), " ") == c["window"])
    told = let(item_words(F.col("text")), lambda w: let(sure(w), lambda s: F.struct(covered(s).alias("n_hit"), F.array_distinct(F.transform(s, lambda x: x["window"])).alias("windows"))))
    hits = settle(texts.join(small(near, weigh=size), "key").select("key", told.alias("t")).select("key", "t.n_hit", "t.windows").where("n_hit > 0"))
    items = hits.select("key", "n_hit", F.explode("windows").alias("window")).join(small(owned), "window")
    items = items.select("key", "n_hit", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key", "n_hit").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = docs.select("doc_id", _key(F.col("text")).alias("key"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(small(settle(items), weigh=F.octet_length(F.array_join("items", ",")) + F.size("items") * 24 + 64), "key", "left")
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose text holds no window of ``benchmark``."""
    hit = settle(contamination(docs, benchmark).where("contaminated").select("key").distinct())
    rows = docs.select(_key(F.col("text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(small(hit), "key", "left_anti").select("row.*")


def oracle() -> str:
    """DuckDB SQL of the query's columns: every window of every document is looked up as it is."""
    w = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {w} AS w FROM documents),
    b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {w} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
    dw AS (SELECT rid, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
    m AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
    h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM m)) GROUP BY rid),
    it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)"""
