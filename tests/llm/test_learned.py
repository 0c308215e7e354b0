"""Mixing, language, toxicity and quality: contracts, held-out accuracy and awkward tables."""

import bisect
import hashlib
import itertools
import random
import re
import zlib

import pytest

from emberfold.llm import language, mixing, quality_knn, toxicity
from emberfold.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import SCHEMA, awkward_rows, by_id

SYLLABLES = {"aa": "ka lo mi tu se ra".split(), "bb": "sch ung keit lich ver ein".split(), "cc": "eau oui que ment tion par".split()}


def corpus(n=900):
    """Three made-up languages; quality by symbols, toxicity by insults that are gapped or have characters put in."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.4
        if bad:
            words = [w + rng.choice(("###", "$$", "%%&")) for w in words]
        if toxic:
            w = rng.choice(("grobian", "halunke", "schurke"))
            form = rng.choice((w, w[:3] + "x" + w[3:], w[:4] + "." + w[4:], w[:2] + "_" + w[2:]))
            words.insert(rng.randrange(len(words)), form)
        docs.append((i, " ".join(words), lang, f"s{i % 5}", 1))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def remainder(i, of):
    return zlib.crc32(str(i).encode()) % of


def test_language(learned):
    docs, _ = learned
    got = {r["doc_id"]: r for r in language.held_out_languages(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert held == [i for i in got if remainder(i, 4) == 2]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity(learned):
    docs, labels = learned
    got = {r["doc_id"]: r for r in toxicity.held_out_toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert held == [i for i in got if remainder(i, 3) == 1]
    assert sum(got[i]["predicted"] == truth[i] for i in held) > 0.9 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_quality(learned):
    docs, labels = learned
    got = {r["doc_id"]: r for r in quality_knn.held_out_quality(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert held == [i for i in got if remainder(i, 5) == 0]
    assert sum(got[i]["predicted"] == truth[i] for i in held) > 0.95 * len(held)


def plain_mix(rows, most=3, fine=256, largest=256, points=None):
    """Block by block: what the slots of the golden-ratio schedule take of each row's text, as (doc_id, taken, n_slots, first_slot)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    key = [hashlib.md5(f"{'null' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest() for r in rows]
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in order}
    want, left, open_ = {}, float(sum(size)), list(order)
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > most * own[s]]
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        want |= {s: float(most * own[s]) for s in over}
        left -= sum(want[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    block = {s: next((b for b in (256, 64, 16, 4) if want[s] >= b * fine and b <= largest), 1) for s in order}
    slots = {s: [] for s in order}
    lines = {b: [s for s in order if want[s] >= 1 and block[s] == b] for b in set(block.values())}
    words = {b: round(sum(want[s] for s in line)) for b, line in lines.items()}
    for b, line in lines.items():
        ends = list(itertools.accumulate(want[s] for s in line))
        for i in range(-(-words[b] // b)):
            u = points(i) if points else (i + 1) * ((5**0.5 - 1) / 2) % 1
            s = line[min(bisect.bisect_right(ends, u * ends[-1]), len(line) - 1)]
            slots[s].append(int(i * (b * sum(words.values()) / words[b])))
        for s in line:
            slots[s] = slots[s] or [sum(words.values()) + order.index(s)] * max(1, round(want[s] / b))
    taken, hits = [0] * len(rows), [[] for _ in rows]
    for s in order:
        stream = [i for i in sorted(range(len(rows)), key=lambda i: (key[i], size[i], i)) if rows[i][3] == s for _ in range(size[i])]
        for k, slot in enumerate(slots[s]):
            for p in range(k * block[s], min((k + 1) * block[s], most * len(stream))):
                i = stream[p % len(stream)]
                taken[i] += 1
                # a document that is reached again in one slot, a round later, is a piece of its own
                piece = (slot, k, p // len(stream))
                if not hits[i] or hits[i][-1] != piece:
                    hits[i].append(piece)
    return want, own, [(r[0], n, t, len(h), h[0][0] if h else None) for r, n, t, h in zip(rows, size, taken, hits, strict=True)]


def some_sources():
    rng = random.Random(4)
    return [(i, "w " * rng.randrange(0, 400), None, rng.choice(["a", "b", "c", "c", "c", None, "é"]), 1) for i in range(700)] + [(1000 + i, "x y z", None, "small", 1) for i in range(2)] + [(2000, "", None, "none", 1)]


def told(df):
    return sorted([tuple(r[c] for c in ("doc_id", "size", "taken", "n_slots", "first_slot")) for r in df.collect()], key=str)


def test_mixing(spark):
    rows = some_sources()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    want, own, plain = plain_mix(rows)
    assert told(got) == sorted(plain, key=str)
    out = got.collect()
    source = {r[0]: r[3] for r in rows}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    for s in want:
        mine = [r for r in out if source[r["doc_id"]] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == own[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 0.01 * want[s]
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert told(again) == told(got)


def test_many_small_sources(spark):
    """Hundreds of sources of a hundred words beside a large one: all come near their targets, and no more is taken than there is."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(80, 120), None, f"host{i:03d}", 1) for i in range(500)] + [(1000 + i, "big " * 3000, None, "hot", 1) for i in range(60)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), keep=("source",)).collect()
    assert told(mixing.mix(spark.createDataFrame(rows, SCHEMA))) == sorted(plain_mix(rows)[2], key=str)
    target = {r["source"]: r["target"] for r in out}
    taken = {s: sum(r["taken"] for r in out if r["source"] == s) for s in target}
    off = [abs(taken[s] - target[s]) / target[s] for s in target]
    assert max(off) < 0.06 and sum(off) / len(off) < 0.015
    assert abs(sum(taken.values()) - sum(target.values())) < 0.005 * sum(target.values())


def test_another_sequence_mixes_otherwise(spark, monkeypatch):
    rows = some_sources()
    df = spark.createDataFrame(rows, SCHEMA)
    before = told(mixing.mix(df))
    monkeypatch.setattr(mixing, "_points", lambda s, n: s.range(n).selectExpr("id AS slot", f"pow((id + 0.5D) / {n}, 3) AS u"))
    assert told(mixing.mix(df)) != before


def test_awkward_mix(awkward, nothing):
    _, _, plain = plain_mix(awkward_rows())
    assert told(mixing.mix(awkward)) == sorted(plain, key=str)
    assert mixing.mix(nothing).count() == 0 == mixing.mixed_rows(nothing).count()
    out = mixing.mixed_rows(awkward)
    assert out.columns == [*awkward.columns, "taken", "first_slot"]
    assert by_id(out, *awkward.columns) == by_id(awkward, *awkward.columns)
    assert sorted(str((r["doc_id"], r["taken"], r["first_slot"])) for r in out.collect()) == sorted(str((p[0], p[2], p[4])) for p in plain)


def test_awkward(awkward, labels, nothing):
    n = len(awkward_rows())
    got = language.held_out_languages(awkward)
    assert got.count() == n
    assert {r["lang_pred"] for r in got.where("doc_id in (4, 5, 6)").collect()} == {"und"}
    for run in (toxicity.held_out_toxicity, quality_knn.held_out_quality):
        assert by_id(run(awkward, labels), "doc_id") == by_id(awkward, "doc_id")
        assert run(awkward, labels.limit(0)).where("score between 0 and 1").count() == n
        assert run(nothing, labels).count() == 0
    assert language.held_out_languages(nothing).count() == 0
    assert quality_knn.keep_good(awkward, labels).columns == awkward.columns


def test_registered_queries():
    assert [q.split("_")[0] for q in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)
