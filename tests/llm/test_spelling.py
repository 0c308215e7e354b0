"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberfold.llm import spelling
from tests.llm.conftest import SCHEMA, awkward_rows, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """At distance one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 3}


def plain_near(words):
    return {w: [v for v in words if near(w, v)] for w in words}


def plain_variants(rows):
    words = plain_vocabulary(rows)
    form, n_near = {}, {}
    for w, others in plain_near(words).items():
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def invented(rng, n, letters="abé", most=9):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, most))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_walk_of_one_part(seed):
    rng = random.Random(seed)
    words = invented(rng, [0, 1, 60, 700][seed], "ab" if seed % 2 else "abcé")
    n = {w: rng.randrange(3, 9) for w in words}
    got = spelling.near_in_parts(words, np.array([n[w] for w in words], np.int64), np.zeros(len(words), np.int64))
    want = {w: (len(o), n[b := min(o, key=lambda v: (-n[v], v))], b) for w, o in plain_near(words).items() if o}
    assert {r.word: (r.n_near, r.form_n, r.form) for r in got.itertuples()} == want


@pytest.mark.parametrize("most", [1, 3, 40, 10_000])
def test_parts_of_any_size(spark, most, monkeypatch):
    """Edits inside and below prefixes, words that are prefixes of others, and a long shared prefix."""
    rng = random.Random(most)
    words = sorted({*invented(rng, 250), *("abab" * 20 + w for w in invented(rng, 60)), "a" * 300, "a" * 301, "a" * 299 + "b"})
    n = {w: rng.randrange(3, 9) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most).collect()
    want = {w: (len(o), n[b := min(o, key=lambda v: (-n[v], v))], b) for w, o in plain_near(words).items() if o}
    assert {r["word"]: (r["n_near"], r["form_n"], r["form"]) for r in got} == want


def texts():
    rng = random.Random(3)
    base = invented(rng, 90, "abcdeé", 8) + ["Ärger", "ärger", "argerx", "thirteen", "thirten", "thirteens"]
    rows = [(i, " ".join(rng.choice(base[: 1 + len(base) // (1 + i % 5)]) for _ in range(400)).replace("ab", "AB", i % 3), None, None, None) for i in range(30)]
    # a chain: each word twice as common as the last
    rows += [(100 + i, " ".join([w] * k), None, None, None) for i, (w, k) in enumerate([("chainaaa", 4), ("chainaab", 9), ("chainabb", 20), ("chainbbb", 41), ("tiesxa", 5), ("tiesxb", 10), ("tiesxc", 10)])]
    return rows + awkward_rows()


def test_variants(spark):
    rows = texts()
    got = spelling.variants(spark.createDataFrame([r[:5] for r in rows], SCHEMA).selectExpr("*", "'mine' AS word", "1 AS n", "2 AS j", "'h' AS h", "'r' AS run"), most=20)
    want = plain_variants(rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want
    assert ("chainaaa", "chainaab", "chainbbb") in {r[:3] for r in want} and ("tiesxa", "tiesxb") in {r[:2] for r in want}


def test_very_long_and_repeated(spark, nothing):
    assert spelling.variants(nothing).count() == 0
    long = "q" * 3000
    rows = [(i, f"{long} {long}x {'same ' * 50} {prose(random.Random(1), 50)}", None, None, None) for i in range(4)]
    got = {r["word"]: tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got.values()) == plain_variants(rows)
