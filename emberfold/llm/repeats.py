"""Removal of repeated passages by longest previous factors in suffix order.

The longest previous factor of a position is the longest string there that also starts in a document with a smaller doc_id.
In suffix order it is the longer of the common prefixes with the previous and the next position of a smaller document. A
position whose factor reaches ``least`` bytes starts a repeat, and its ``least`` bytes go; the first document keeps them.

Suffixes with a common prefix of ``least`` bytes meet in much smaller places than the order of the whole corpus. Every window
of ``least`` bytes has an anchor, the smallest hash of the grams of GRAM bytes in it, which only depends on the window.
Windows of one document in a row with one anchor form a run, and runs are dealt out by their anchor. As in the order of all
suffixes, equal strings need no place of their own each: of equal texts, and of equal runs of an anchor, the smallest
document's stands for all, and the others are repeats as a whole. What is left are the anchors that stand in several different
runs. The windows of their runs are read from the texts, and ``previous_factors`` sorts them as suffixes, takes the common
prefixes of neighbours, and finds the previous and next place of a smaller document and so the factor of each.

Where a common passage begins or ends, its anchor has a different run in every document. Anchors with many runs, as found
in a share of the texts, are split: their runs are dealt out by the run's hash, and those left by their windows' hashes,
after each task has put aside the windows with a factor among its own. The share only decides what is split; the result is
the same for any. At most MOST_SPLIT anchors are split, those with the most runs, so that any other anchor has fewer than the
corpus's runs by MOST_SPLIT.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.llm.common import settle, small
from emberfold.llm.textbits import grouped, mix, piece_hash, prefix_sums

LEAST, GRAM = 50, 16
SPAN = LEAST - GRAM + 1  # grams in a window
#: Bytes of text in a task whose runs are compared before they are dealt out, and bytes that are turned into arrays at a time.
AHEAD, AT_ONCE = 4 << 20, 1 << 18
#: Bytes of rows that Spark hands to Python at a time (10,000 texts otherwise).
BATCH = 8 << 20
#: Runs of an anchor go to one of so many parts for each shuffle partition (and LEAST_PARTS at least), which Spark deals out.
#: A task settles a few parts at a time.
SHARE, LEAST_PARTS = 16, 1 << 10
#: Runs for which a task takes parts together, runs of one part that it holds before equal ones are put together, and windows that it sorts at once.
TOGETHER, HELD, SORTED = 50_000, 400_000, 100_000
LAST = (1 << 63) - 1
#: Anchors with about so many runs are split; they are counted in one of SAMPLE texts.
CROWD, SAMPLE, MOST_SPLIT = 4_000, 8, 1 << 18
ANCHOR = np.uint64((1 << 56) - 1)


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; ``buf`` has 8 bytes more than positions."""
    return np.ndarray((len(buf) - 8,), "<u8", buf.tobytes(), 0, (1,))


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, run hash) of every run of each whole text.

    The run hash covers the windows' bytes and where the anchor is among them.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for group in grouped(texts, LEAST - 1, AT_ONCE):
        buf = np.frombuffer(b"".join(p for _, _, p in group) + bytes(GRAM + 8), np.uint8)
        lens = np.array([len(p) for _, _, p in group])
        stops = np.cumsum(lens)
        w = _words(buf)
        n = len(buf) - GRAM - 8 - LEAST + 1
        if n <= 0:
            continue
        gram = mix(w[: n + SPAN - 1] * np.uint64(0x9E3779B97F4A7C15) ^ mix(w[8 : 8 + n + SPAN - 1]))
        place = np.arange(len(gram), dtype=np.uint64)
        # the hash's upper bits and the position, so that the first of equal grams wins
        low = (gram >> np.uint64(28) << np.uint64(28)) | place
        reach = 1
        while reach * 2 <= SPAN:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - reach)], low[SPAN - reach :])
        anchor = (low[:n] & np.uint64((1 << 28) - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(group)), lens)[:n]
        good = np.arange(n) + LEAST <= stops[owner]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new & good)
        if not len(first):
            continue
        cuts = np.flatnonzero(new | ~good)
        nxt = np.searchsorted(cuts, first, "right")
        stop = np.where(nxt < len(cuts), cuts[np.minimum(nxt, len(cuts) - 1)], n)
        sums = prefix_sums(mix(w[: len(w)]))
        # the hash of 8-byte words reads past the end, so the last 7 bytes count by the words before
        run = piece_hash(sums, first, stop + LEAST - 1 - 7)
        at = anchor[first]
        run = mix(run + ((stop - first) * 64 + (at - first)).astype(np.uint64))
        base = np.array([a for _, a, _ in group]) - (stops - lens)
        own = owner[first]
        for part, values in zip(out, (np.array([i for i, _, _ in group])[own], first + base[own], stop - first, gram[at], run), strict=True):
            part.append(values)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(p).astype(k) if p else np.zeros(0, k) for p, k in zip(out, kinds, strict=True))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each number, byte by byte, which compresses better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return full.reshape(-1).view("<u8")


WIDTHS = {"anchor": 7, "run": 6, "doc": 8, "twin": 8, "first": 6, "n": 1}
DEALT = "part int, size int, " + ", ".join(f"{k} binary" for k in WIDTHS)
SPANS = "doc long, twin long, anchor long, first long, n int"


def _merged(doc: np.ndarray, twin: np.ndarray, first: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Removed windows, runs in a row as one; marked by a null anchor."""
    if not len(doc):
        return pd.DataFrame({"doc": doc, "twin": twin, "anchor": pd.array([], "Int64"), "first": first, "n": n})
    order = np.lexsort((first, twin, doc))
    doc, twin, first, n = doc[order], twin[order], first[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (first[1:] > first[:-1] + n[:-1])
    at = np.flatnonzero(new)
    last = np.maximum.reduceat(first + n, at)
    return pd.DataFrame({"doc": doc[at], "twin": twin[at], "anchor": pd.array([None] * len(at), "Int64"), "first": first[at], "n": (last - first[at])})


def _leaders(key: list[np.ndarray], doc: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In ``order`` (by key, then doc): where groups of equal key begin, and the group's first doc for each row."""
    new = np.ones(len(order), bool)
    for k in key:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    at = np.flatnonzero(new)
    return new, doc[order][at][np.cumsum(new) - 1]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors that several runs of a task's texts have in common, and how many."""

    def flush(texts: list[bytes]) -> pd.DataFrame:
        anchor, n = np.unique(runs(texts)[3] & ANCHOR, return_counts=True)
        return pd.DataFrame({"anchor": anchor[n > 1].astype(np.int64), "n": n[n > 1]})

    held: list[bytes] = []
    size = 0
    for b in batches:
        for text in b["text"]:
            held.append(text.encode())
            size += len(held[-1])
            if size >= AHEAD:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _crowded(fresh: DataFrame) -> np.ndarray:
    """Sorted anchors to be split; at most MOST_SPLIT of 8 bytes each, those with the most runs."""
    share = fresh.where(F.pmod(F.xxhash64("doc", "twin", F.octet_length("text")), F.lit(SAMPLE)) == 0).select("text")
    counts = share.mapInPandas(_count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") * SAMPLE >= CROWD).orderBy(F.desc("n"), "anchor").limit(MOST_SPLIT)
    return np.sort(np.array([r[0] for r in most.select("anchor").collect()], np.int64))


def _deal(batches: Iterator[pd.DataFrame], bits: int, crowded: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Runs of many documents, in parts by their anchor (and run, if the anchor is crowded); those already seen in a smaller document only as removed."""
    split = np.zeros(0, np.int64) if crowded is None else crowded

    def flush(docs: list[tuple[int, int, bytes]]) -> Iterator[pd.DataFrame]:
        own, first, n, anchor, run = runs([t for _, _, t in docs])
        if not len(own):
            return
        doc = np.array([d for d, _, _ in docs], np.int64)[own]
        twin = np.array([t for _, t, _ in docs], np.int64)[own]
        order = np.lexsort((doc, run, anchor))
        _, leader = _leaders([anchor, run], doc, order)
        seen = np.zeros(len(doc), bool)
        seen[order] = doc[order] > leader
        keep = order[~seen[order]]
        # anchors are the smallest hashes, whose upper bits are alike
        dealt = mix(np.where(np.isin((anchor[keep] & ANCHOR).astype(np.int64), split), anchor[keep] ^ run[keep], anchor[keep]))
        part = (dealt >> np.uint64(64 - bits)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        keep, part = keep[by_part], part[by_part]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            at = keep[a:b]
            values = {"anchor": anchor[at], "run": run[at], "doc": doc[at].astype(np.uint64), "twin": twin[at], "first": first[at], "n": n[at]}
            rows.append({"part": int(part[a]), "size": b - a} | {k: _planes(v.astype(np.uint64), WIDTHS[k]) for k, v in values.items()})
        gone = _merged(doc[seen], twin[seen], first[seen], n[seen])
        if len(gone):
            values = {"doc": gone["doc"].to_numpy().astype(np.uint64), "twin": gone["twin"].to_numpy(), "first": gone["first"].to_numpy()}
            # lengths of merged runs take the place of anchors, and the part is none
            rows.append({"part": -1 - int(doc[0] % (1 << bits)), "size": len(gone), "run": b"", "n": b"", "anchor": _planes(gone["n"].to_numpy().astype(np.uint64), 7)} | {k: _planes(v.astype(np.uint64), WIDTHS[k]) for k, v in values.items()})
        yield pd.DataFrame(rows)[["part", "size", *WIDTHS]]

    held: list[tuple[int, int, bytes]] = []
    size = 0
    for b in batches:
        for d, t, text in zip(b["doc"], b["twin"], b["text"], strict=True):
            held.append((d, t, text.encode()))
            size += len(held[-1][2])
            if size >= AHEAD:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def _equal_runs(held: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray]:
    """Of the columns of whole parts in the order of WIDTHS: runs that a smaller document has as well, as removed; the others, sorted by anchor, run and doc; where an anchor's next run begins."""
    anchor, run, doc, twin, first, n = held
    order = np.lexsort((doc, run, anchor))
    new, leader = _leaders([anchor, run], doc, order)
    later = doc[order] > leader
    gone = order[later]
    return _merged(doc[gone], twin[gone], first[gone], n[gone]), [x[order[~later]] for x in held], new[~later]


def _settle_runs(batches: Iterator[pd.DataFrame], crowded: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Of rows in the order of parts: removed runs (null anchor), and runs that must be looked at (with their anchor).

    Parts are settled when they are whole; of the equal runs of a large one, only those of the smallest document so far are held.
    """
    # what a crowded anchor has elsewhere isn't known here
    split = np.zeros(0, np.int64) if crowded is None else crowded
    held: list[list[np.ndarray]] = []
    part, size, most = -1, 0, HELD

    def together() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    def flush() -> Iterator[pd.DataFrame]:
        gone, (anchor, _, doc, twin, first, n), new = _equal_runs(together())
        yield gone
        # anchors with several different runs, in more than one document
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        kinds = np.add.reduceat(new.astype(np.int64), starts)
        spread = np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts)
        sizes = np.diff(np.concatenate((starts, [len(anchor)])))
        look = np.flatnonzero(np.repeat(((kinds > 1) & spread) | np.isin(anchor[starts].astype(np.int64), split), sizes))
        for at in np.array_split(look, len(look) // 50_000 + 1):
            yield pd.DataFrame({"doc": doc[at], "twin": twin[at], "anchor": pd.array(anchor[at].astype(np.int64), "Int64"), "first": first[at], "n": n[at]})

    for b in batches:
        for r in b.itertuples(index=False):
            if r.part < 0:
                n = _unplanes(r.anchor, r.size, 7).astype(np.int64)
                cols = [_unplanes(getattr(r, k), r.size, WIDTHS[k]).astype(np.int64) for k in ("doc", "twin", "first")]
                yield pd.DataFrame({"doc": cols[0], "twin": cols[1], "anchor": pd.array([None] * r.size, "Int64"), "first": cols[2], "n": n})
                continue
            if r.part != part and size >= TOGETHER:
                yield from flush()
                held, size, most = [], 0, HELD
            part = r.part
            cols = {k: _unplanes(getattr(r, k), r.size, w) for k, w in WIDTHS.items()}
            # equal runs of one anchor have one part, which sets apart more runs than 6 bytes do
            cols["run"] |= np.uint64((int(part) & 0xFFFF) << 48)
            held.append([x if k in ("anchor", "run") else x.astype(np.int64) for k, x in cols.items()])
            size += r.size
            if size >= most:
                gone, left, _ = _equal_runs(together())
                yield gone
                held, size = [left], len(left[0])
                most = max(HELD, 2 * size)
    if held:
        yield from flush()


CONTEXTS = "spot long, doc long, twin long, first long, n int, bytes binary"


def _contexts(batches: Iterator[pd.DataFrame], crowded: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The bytes of the runs that must be looked at, to meet at their anchor, or window by window at the window's hash.

    Windows that are already removed here have no bytes.
    """
    split = frozenset(() if crowded is None else crowded.tolist())
    names = ["spot", "doc", "twin", "first", "n", "bytes"]

    def windows(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        part = pd.DataFrame(rows, columns=names)
        n = part["n"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(part)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, twin, first = part["doc"].to_numpy()[row], part["twin"].to_numpy()[row], part["first"].to_numpy()[row] + offset
        bad = previous_factors(part["bytes"].tolist(), n, part["doc"].to_numpy()) >= LEAST
        gone = _merged(doc[bad], twin[bad], first[bad], np.ones(int(bad.sum()), np.int64))
        yield gone.assign(spot=gone["first"] ^ gone["doc"], bytes=None)[names]
        left = np.flatnonzero(~bad)
        for at in np.array_split(left, len(left) // 50_000 + 1):
            own = [rows[r][5][o : o + LEAST] for r, o in zip(row[at], offset[at], strict=True)]
            spot = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True) for w in own]
            yield pd.DataFrame({"spot": np.array(spot, np.int64), "doc": doc[at], "twin": twin[at], "first": first[at], "n": 1, "bytes": own})

    crowd: list[tuple] = []
    size = 0
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            text = r.text.encode()
            for s in r.look:
                one = (s["anchor"], r.doc, r.twin, s["first"], s["n"], text[s["first"] : s["first"] + s["n"] - 1 + LEAST])
                if s["anchor"] in split:
                    crowd.append(one)
                    size += s["n"]
                else:
                    rows.append(one)
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
            if size >= SORTED:
                yield from windows(crowd)
                crowd, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)
    if crowd:
        yield from windows(crowd)


def _bytes_alike(x: np.ndarray) -> np.ndarray:
    """Leading bytes of zero of each number."""
    return 8 - np.searchsorted(np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64), x, "right")


def _with_smaller(doc: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For places in suffix order: the common prefix with the nearest place before that has a smaller document, 0 if none.

    ``shared`` is each place's common prefix with the place before. All places look back at once: one that meets a document
    that isn't smaller goes on where that one has got to, as everything between is not smaller either.
    """
    d = np.concatenate(([np.iinfo(np.int64).min], doc))
    least = np.concatenate(([0], shared)).astype(np.int64)
    at = np.maximum(np.arange(-1, len(doc)), 0)
    on = np.flatnonzero((d[at] >= d) & (least > 0))
    while len(on):
        via = at[on]
        least[on], at[on] = np.minimum(least[on], least[via]), at[via]
        on = on[(d[at[on]] >= d[on]) & (least[on] > 0)]
    return least[1:]


def previous_factors(texts: list[bytes], windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The longest previous factor, up to LEAST bytes, at each window (of ``windows[i]`` in a row at the start of text i).

    Previous is what a smaller of the documents ``doc`` has; the windows are all the positions that there are.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    start = np.repeat(np.cumsum(lens) - lens, windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    owner = np.repeat(doc, windows)
    word = np.ndarray((len(buf) - 8,), ">u8", buf.tobytes(), 0, (1,))
    offsets = (*range(0, LEAST - 7, 8), LEAST - 8)
    keys = [word[start + at].astype(np.uint64) for at in offsets]
    order = np.lexsort(keys[::-1])
    shared = np.full(len(order), LEAST)
    shared[:1] = 0
    for at, key in zip(offsets[::-1], keys[::-1], strict=True):
        apart = key[order][1:] ^ key[order][:-1]
        shared[1:] = np.where(apart > 0, at + _bytes_alike(apart), shared[1:])
    before = _with_smaller(owner[order], shared)
    after = _with_smaller(owner[order][::-1], np.concatenate(([0], shared[:0:-1])))[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of partitions that hold all runs of their anchors, or all windows of their hashes: removed windows."""

    def flush(part: pd.DataFrame) -> pd.DataFrame:
        n = part["n"].to_numpy().astype(np.int64)
        bad = previous_factors(part["bytes"].tolist(), n, part["doc"].to_numpy()) >= LEAST
        at = np.flatnonzero(bad)
        row = np.repeat(np.arange(len(part)), n)[at]
        offset = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[at]
        return _merged(part["doc"].to_numpy()[row], part["twin"].to_numpy()[row], part["first"].to_numpy()[row] + offset, np.ones(len(at), np.int64))

    # rows come in the order of spots
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        done = b[b["bytes"].isna()]
        if len(done):
            yield _merged(*(done[k].to_numpy().astype(np.int64) for k in ("doc", "twin", "first", "n")))
            b = b[b["bytes"].notna()]
        if not len(b):
            continue
        held.append(b)
        size += int(b["n"].sum())
        if size >= SORTED:
            whole = pd.concat(held, ignore_index=True)
            last = whole["spot"].iloc[-1]
            done = whole[whole["spot"] != last]
            held = [whole[whole["spot"] == last]]
            size = int(held[0]["n"].sum())
            if len(done):
                yield flush(done)
    if held:
        yield flush(pd.concat(held, ignore_index=True))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """For what runs meanwhile, rows reach Python in batches of about BATCH bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def drop_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, as bytes) for each row of ``docs``.

    A null text is an empty one. A null doc_id is larger than any other. Rows that share a doc_id never remove from each
    other, as none of them is smaller. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    ids = settle(base.select("doc", "digest"))
    firsts = settle(ids.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("digest", "least"))
    copies = settle(ids.join(small(firsts), "digest").where("doc > least").select("doc", "digest").distinct())
    many = ids.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc")
    twins = ids.join(small(settle(many)), "doc", "left_semi").distinct()
    # numbers of rows, which the checkpoint fixes: texts of one doc_id can be as many as the table's rows
    twins = settle(twins.withColumn("twin", F.monotonically_increasing_id() + 1))
    base = base.join(small(twins), ["doc", "digest"], "left").withColumn("twin", F.coalesce("twin", F.lit(0).cast("long")))
    fresh = base.join(small(copies), ["doc", "digest"], "left_anti").select("doc", "twin", "text")

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(30, (max(LEAST_PARTS, SHARE * parts) - 1).bit_length())
    with _small_batches(spark):
        crowded = _crowded(fresh)
        dealt = fresh.mapInPandas(partial(_deal, bits=bits, crowded=crowded), DEALT).repartition(parts, "part").sortWithinPartitions("part")
        found = settle(dealt.mapInPandas(partial(_settle_runs, crowded=crowded), SPANS))
        look = found.where("anchor is not null").groupBy("doc", "twin").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("look"))
        contexts = fresh.join(look, ["doc", "twin"]).mapInPandas(partial(_contexts, crowded=crowded), CONTEXTS)
        looked = settle(contexts.repartition(parts, "spot").sortWithinPartitions("spot").mapInPandas(_look, SPANS))
    gone = found.where("anchor is null").union(looked).groupBy("doc", "twin").agg(F.collect_list(F.struct("first", "n")).alias("gone")).select("doc", "twin", "gone.first", "gone.n")

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, first, n in zip(texts, firsts, counts, strict=True):
            raw = text.encode()
            if first is None or not len(first):
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw if with_text else None))
                continue
            mark = np.zeros(len(raw) + 1, np.int32)
            np.add.at(mark, first, 1)
            np.add.at(mark, first + n + LEAST - 1, -1)
            bad = np.cumsum(mark)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~bad].tobytes()
            spans_n = int(bad[0]) + int((bad[1:] & ~bad[:-1]).sum())
            rows.append((len(raw), int(bad.sum()), spans_n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    copied = base.join(small(copies), ["doc", "digest"], "left_semi")
    size = F.octet_length("text").cast("long")
    long = size >= LEAST
    zero = F.lit(0).cast("long")
    kept = F.when(long, F.lit("")).otherwise(F.col("text"))
    whole = copied.select("doc_id", size.alias("n_bytes"), F.when(long, size).otherwise(zero).alias("n_removed"), long.cast("long").alias("n_spans"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"), kept.cast("binary").alias("kept_text"))
    rest = base.join(small(copies), ["doc", "digest"], "left_anti").join(gone, ["doc", "twin"], "left")
    rest = rest.withColumn("c", cut("text", "first", "n")).select("doc_id", "c.*")
    out = rest.unionByName(whole)
    return out if with_text else out.drop("kept_text")


def oracle() -> str:
    """DuckDB SQL of the query's columns: every window of LEAST bytes, by a 64-bit hash, with its smallest document."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    c AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2 * (256 + {LEAST - 1})) AS c FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 256)) AS j FROM d)),
    w AS (SELECT doc_id, j + k AS i, hash(substr(c, 2 * k - 1, {2 * LEAST})) AS s FROM (SELECT doc_id, j, c, unnest(range(1, least(256, len(c) // 2 - {LEAST - 1}) + 1)) AS k FROM c)),
    f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
    bad AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{LEAST}) + {LEAST} AS new FROM w JOIN f USING (s) WHERE doc_id > least),
    g AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM bad),
    r AS (SELECT doc_id, k, min(i) AS a, max(i) + {LEAST} AS b FROM g GROUP BY ALL),
    t AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 1) AS z FROM r),
    x AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS stop, string_agg(substr(h, 2 * z - 1, 2 * (a - z)), '' ORDER BY k) AS kept FROM t JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * stop - 1), h))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)"""
