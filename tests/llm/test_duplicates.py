"""Near-duplicates and repeated passages against plain Python."""

import hashlib
import random
import tracemalloc
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from emberfold.llm import near_dup, repeats
from tests.llm.conftest import SCHEMA, awkward_rows, by_id, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(rows, n):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    own = {d: [shingles(r[1], n) for r in rows if r[0] == d] for d in ids}
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(ids, 2):
        if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in own[a] for t in own[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def near_copies():
    """A hot group of copies with up to a quarter of the words changed, and smaller groups."""
    rng = random.Random(11)
    rows = []
    for g, size in enumerate((120, 12, 6, 2, 2)):
        words = prose(rng, 90).split()
        for _ in range(size):
            w = list(words)
            for _ in range(rng.randrange(0, 22)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) * 3, " ".join(w), "en", f"g{g}", 1))
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_components(spark, n):
    rows = near_copies()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), n).collect()
    want = plain_components(rows, n)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(dict((x[0], x[1]) for x in rows)[r["doc_id"]], n)) for r in got)


def test_prefixes_of_repeated_rows(spark):
    shared = list(range(1000, 1018))
    rows = [(1, [1, 2, *shared]), (2, [3, 4, *shared]), (2, [3, 4, *shared])]
    members = spark.createDataFrame([(1, 1, True), (2, 2, True)], "doc_id long, label long, odd boolean")
    got = near_dup._prefix_pairs(spark.createDataFrame(rows, "doc_id long, items array<long>"), members, 80).collect()
    assert [(r["u"], r["v"]) for r in got] == [(1, 2)]


@pytest.mark.parametrize("shape", ["repeated", "two texts"])
def test_components_of_repeated_doc_ids(spark, shape):
    rows = near_copies()
    if shape == "repeated":
        rows += rows[1::2] * 2
    else:
        rng = random.Random(2)
        rows += [(r[0], prose(rng, 60, 10**6), *r[2:]) for r in rows]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(rows, 2)


def test_awkward_components(awkward, nothing):
    got = near_dup.near_duplicates(awkward, 2).collect()
    want = plain_components(awkward_rows(), 2)
    assert Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got) == Counter((r[0], want.get(r[0]), len(shingles(r[1], 2))) for r in awkward_rows())
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert near_dup.near_duplicates(nothing, 2).count() == 0


def test_keep_one(awkward):
    out = near_dup.keep_one(awkward)
    want = plain_components(awkward_rows(), 5)
    assert out.columns == awkward.columns
    assert by_id(out, "doc_id") == sorted(f"({r[0]},)" for r in awkward_rows() if r[0] is None or want[r[0]] == r[0])


def plain_repeats(rows, least=50):
    last = 1 << 62
    first = {}
    raw = [((last if d is None else d), (t or "").encode()) for d, t, *_ in rows]
    for d, b in raw:
        for i in range(len(b) - least + 1):
            s = b[i : i + least]
            first[s] = min(first.get(s, last + 1), d)
    out = []
    for (d, b), r in zip(raw, rows, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < d:
                gone[i : i + least] = b"\x01" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages():
    rng = random.Random(3)
    shared = [prose(rng, k) for k in (9, 14, 30, 200)]
    low = "ab" * 200
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(1, 40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(len(parts)), s[a : a + rng.randrange(20, len(s))])
        if i % 9 == 0:
            parts.append(low[: rng.randrange(30, 300)])
        if i % 11 == 0:
            parts.append("é日😀" * rng.randrange(3, 20))
        rows.append((rng.randrange(10**6) if i % 17 else i, " ".join(parts), "en", "a", 1))
    return rows


def test_repeated_passages(spark):
    rows = passages()
    got = repeats.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_repeats(rows)


def test_awkward_passages(awkward, nothing):
    rows = awkward_rows()
    got = repeats.drop_repeats(awkward).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_repeats(rows)
    assert repeats.drop_repeats(nothing).count() == 0


def plain_factors(texts, windows, doc, least=50):
    """The longest common prefix with a position of a smaller document, all compared with all."""
    places = [(d, t[i:]) for t, n, d in zip(texts, windows, doc, strict=True) for i in range(n)]

    def alike(s, t):
        return next((k for k in range(least) if s[k] != t[k]), least)

    return [max([0, *(alike(s, t) for e, t in places if e < d)]) for d, s in places]


def test_previous_factors():
    rng = random.Random(21)
    shared = [bytes(rng.choice(b"abc") for _ in range(90)) for _ in range(3)]
    texts = []
    for _ in range(40):
        s = rng.choice(shared)
        a = rng.randrange(40)
        texts.append(bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) + s[a : a + rng.randrange(20, 60)] + bytes(rng.choice(b"\x00\xffz") for _ in range(rng.randrange(60))))
    texts = [t for t in texts if len(t) >= 50] + [b"z" * 70, b"z" * 61, bytes(80)]
    windows = np.array([len(t) - 49 for t in texts])
    for doc in (np.arange(len(texts)), np.arange(len(texts))[::-1], np.array([rng.randrange(6) for _ in texts]), np.zeros(len(texts), np.int64)):
        got = repeats.previous_factors(texts, windows, doc).tolist()
        assert got == plain_factors(texts, windows, doc)
    assert not len(repeats.previous_factors([], np.zeros(0, np.int64), np.zeros(0, np.int64)))


@pytest.mark.parametrize("held", [1, 40])
def test_parts_in_pieces(spark, monkeypatch, held):
    """The result is the same however few runs of a part, and windows of a spot, a task holds."""
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "TOGETHER", held)
    monkeypatch.setattr(repeats, "SORTED", held)
    monkeypatch.setattr(repeats, "AHEAD", 3000)
    docs = passages()
    frames = [pd.DataFrame({"doc": [r[0] for r in docs], "twin": 0, "text": [r[1] for r in docs]})]
    parts = pd.concat(repeats._deal(iter(frames), bits=3)).sort_values("part", kind="stable")
    found = pd.concat(repeats._settle_runs(iter([parts.iloc[i : i + 5] for i in range(0, len(parts), 5)])))
    gone = found[found["anchor"].isna()]
    monkeypatch.undo()
    whole = pd.concat(repeats._settle_runs(iter([pd.concat(repeats._deal(iter(frames), bits=3)).sort_values("part", kind="stable")])))
    apart = whole[whole["anchor"].isna()]
    windows = lambda x: {(d, i) for d, f, n in zip(x["doc"], x["first"], x["n"], strict=True) for i in range(f, f + n)}
    assert windows(gone) == windows(apart) and gone["n"].sum() >= apart["n"].sum() > 0
    key = ["anchor", "doc", "first", "n"]
    look = lambda x: set(map(tuple, x[x["anchor"].notna()][key].astype("int64").to_numpy().tolist()))
    assert look(found) == look(whole)


@pytest.mark.parametrize("crowd", [1, 60])
def test_crowded_anchors(spark, monkeypatch, crowd):
    """The result is the same however many anchors are split."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    rows = passages()
    got = repeats.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_repeats(rows)


def test_crowded_anchors_are_dealt_out(spark):
    """A common line between different texts: its runs go to many parts, and its windows to many spots, once a task."""
    rng = random.Random(8)
    line = prose(rng, 20)
    texts = [f"{prose(rng, 8, 10**6)} {line} {prose(rng, 8, 10**6)}" for _ in range(300)]
    docs = pd.DataFrame({"doc": range(300), "twin": 0, "text": texts})
    anchor, n = np.unique(repeats.runs([t.encode() for t in texts])[3] & repeats.ANCHOR, return_counts=True)
    split = np.sort(anchor[n >= 300].astype(np.int64))
    parts = pd.concat(repeats._deal(iter([docs]), bits=10, crowded=split))
    found = pd.concat(repeats._settle_runs(iter([parts]), crowded=split))
    look = found[found["anchor"].notna()]
    most = look["anchor"].value_counts()
    assert most.iloc[0] > 250
    by_doc = {d: g[["anchor", "first", "n"]].to_dict("records") for d, g in look.groupby("doc")}
    asked = docs[docs["doc"].isin(by_doc)].assign(look=lambda x: x["doc"].map(by_doc))
    out = pd.concat(repeats._contexts(iter([asked]), crowded=split))
    sent = out[out["bytes"].notna()]
    assert sent[sent["n"] == 1]["spot"].value_counts().max() < 20 and not set(sent["spot"]) & set(split.tolist())


def test_many_texts_of_one_doc_id():
    """Which text of a doc_id a span belongs to survives the way through the parts, however many texts there are."""
    twins = [3, 3 + (1 << 16), (5 << 33) + 3]
    text = prose(random.Random(4), 40)
    docs = pd.DataFrame({"doc": [1] + [repeats.LAST] * 3, "twin": [0, *twins], "text": [text, *[f"{k} {text}" for k in "abc"]]})
    parts = pd.concat(repeats._deal(iter([docs]), bits=10))
    found = pd.concat(repeats._settle_runs(iter([parts])))
    assert set(found.loc[found["doc"] == repeats.LAST, "twin"]) == set(twins)


def test_kept_text(spark):
    rows = passages()[:30]
    got = repeats.drop_repeats(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()
    assert all(hashlib.sha256(bytes(r["kept_text"])).hexdigest() == r["kept_sha256"] for r in got)
    sizes = defaultdict(list)
    for r in got:
        sizes[r["doc_id"]].append(r["n_bytes"] - r["n_removed"] == len(r["kept_text"]))
    assert all(all(v) for v in sizes.values())


def test_repeats_take_little_memory_in_a_task(spark):
    """Dealing 12 MB of texts out takes a fraction of what pieces of 1 MB and flushes of 8 MB took, and parts are alike in size."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**8):x}" for _ in range(50_000)]
    docs = pd.DataFrame({"doc": range(3000), "twin": 0, "text": [" ".join(rng.choices(words, k=520)) for _ in range(3000)]})
    assert docs["text"].str.len().sum() > 12e6
    sizes = Counter()
    list(repeats._deal(iter([docs[:100]]), bits=6))
    tracemalloc.start()
    try:
        for x in repeats._deal((docs[i : i + 1000] for i in range(0, 3000, 1000)), bits=6):
            for part, size in zip(x["part"], x["size"], strict=True):
                sizes[part] += size
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6
    sizes = [n for part, n in sizes.items() if part >= 0]
    assert len(sizes) == 64 and max(sizes) < 1.5 * sum(sizes) / 64
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with repeats._small_batches(spark):
        assert int(spark.conf.get(key)) == repeats.BATCH
    assert spark.conf.get(key) == before
