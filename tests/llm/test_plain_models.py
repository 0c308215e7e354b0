"""Scores of the learned operators against plain versions of their methods, document by document."""

import math
import re
from itertools import combinations

import numpy as np
import pytest

from emberfold.llm import language, quality_knn, toxicity
from tests.llm.conftest import SCHEMA, awkward_rows
from tests.llm.test_learned import corpus, remainder


def grams(data: bytes, n: int, bins: int) -> dict[int, int]:
    """How often each hashed gram is there, one after the other."""
    out: dict[int, int] = {}
    for i in range(len(data) - n + 1):
        code = 0
        for b in data[i : i + n]:
            code = (code * 257 + b) % 2**32
        code = code * 2654435761 % 2**32
        code = (code ^ code >> 15) % bins
        out[code] = out.get(code, 0) + 1
    return out


def cosine(a: dict[int, float], b: np.ndarray) -> float:
    norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(float(v) ** 2 for v in b))
    return sum(v * float(b[i]) for i, v in a.items()) / norm if norm else 0.0


@pytest.fixture(scope="module")
def mixed(spark):
    docs, labels = corpus(240)
    docs = [(1000 + r[0], *r[1:]) for r in docs] + awkward_rows()
    labels = [(1000 + i, q, t) for i, q, t in labels]
    return docs, labels, spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_language_is_the_nearest_centroid(mixed):
    rows, _, docs, _ = mixed
    model = language.fit(docs.where("doc_id >= 1000").select("doc_id", "text", "lang"))
    centroids = model.centroids.astype(float)
    asked = [r for r in rows if r[0] is None or r[0] < 1000] + rows[:25]
    ids = {(r[0], r[1]) for r in asked}
    got = {(r["doc_id"], r["text"]): r for r in language.identify(docs, model, reject=False, keep=("doc_id", "text")).collect() if (r["doc_id"], r["text"]) in ids}
    assert set(got) == ids
    for (_, text), r in got.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        bare = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
        vector = {g: math.log1p(n) * float(model.idf[g]) for g, n in grams(bare.encode(), 3, language.BINS).items()}
        sims = [cosine(vector, c) for c in centroids]
        assert abs(r["score"] - max(0.0, max(sims))) < 1e-3
        # the first of equally near ones, as far as the numbers tell
        assert max(s for s, name in zip(sims, model.langs, strict=True) if name == r["lang_pred"]) > max(sims) - 1e-4


def subsequences(word: str) -> dict[tuple, float]:
    """Weights of all subsequences of four letters that skip two at most, by their letters."""
    w = f"^{word}$"
    out: dict[tuple, float] = {}
    for i in range(len(w)):
        for rest in combinations(range(1, 6), 3):
            if i + rest[-1] < len(w):
                key = (w[i], *[w[i + k] for k in rest])
                out[key] = out.get(key, 0.0) + 0.5 ** (rest[-1] - 3)
    return out


def kernel(a: str, b: str) -> float:
    x, y = subsequences(a), subsequences(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / norm if norm else 0.0


WORDS = "grobian gro.bian gr_obian grobxian halunke halxunke schurke schxurke wolke himmel regen baum stein fluss a bb ccc überall straße".split()


def test_kernel_is_the_sum_over_shared_subsequences():
    words = sorted({w for x in WORDS for w in toxicity.tokens(x)})
    got = toxicity._vectors(words) @ toxicity._vectors(words).T
    want = np.array([[kernel(a, b) for b in words] for a in words])
    # a few subsequences share one of the 2 ** 17 hashes
    off = np.abs(got - want)
    assert (off < 1e-4).mean() > 0.97 and off.max() < 0.05


def test_folded_table_is_the_machine_over_landmarks():
    bad, fine = ["grobian", "grobxian", "halunke", "halxunke", "schurke"], ["wolke", "himmel", "regen", "baum", "stein", "fluss"]
    y, weight = np.array([1.0] * len(bad) + [-1.0] * len(fine)), np.ones(len(bad) + len(fine))
    marks = ["grobian", "halunke", "schurke", "wolke", "himmel", "regen"]
    machine = toxicity._train(bad + fine, y, weight, marks)
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    half = vectors / np.sqrt(values)
    cross = np.array([[kernel(a, b) for b in marks] for a in bad + fine])
    coef, bias = toxicity._svm(cross @ half, y, weight)
    asked = ["gropian", "halunkxe", "schurken", "bäume", "steine", "x"]
    want = [float(np.array([kernel(w, m) for m in marks]) @ half @ coef + bias) for w in asked]
    assert np.abs(machine.words(asked) - want).max() < 0.05


def test_toxicity_is_the_worst_word(mixed):
    rows, _, docs, labels = mixed
    model = toxicity.fit(docs.where("doc_id >= 1000"), labels.select("doc_id", "toxic"))
    got = {(r["doc_id"], r["text"]): r for r in toxicity.score(docs, model, keep=("doc_id", "text")).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    for r in rows:
        words = sorted(toxicity.tokens(r[1] or ""))
        best = max([-3.0, *(float(model.words([w])[0]) for w in words)]) if len(words) < 300 else float(model.words(words).max())
        best = 1 + 0.02 * (min(best, 3) - 1) if best > 1 else max(best, -3)
        want = 1 / (1 + math.exp(-(model.slope * best + model.shift)))
        assert abs(got[r[0], r[1]]["score"] - want) < 1e-5
        assert got[r[0], r[1]]["predicted"] == int(got[r[0], r[1]]["score"] >= 0.7)


def plain_terms(text: str) -> list[float]:
    data = bytes(int(quality_knn.SHAPES[b]) for b in text.encode())
    counts = grams(data, 4, quality_knn.GRAMS)
    size = max(1, sum(counts.values()))
    out = [0.0] * quality_knn.TERMS
    for g, n in counts.items():
        out[g] = math.log1p(n / size * 200)
    for j, v in enumerate(quality_knn._descriptors(text)):
        at = v * (quality_knn.STEPS - 1)
        out[quality_knn.GRAMS + j * quality_knn.STEPS + int(at)] += 3 * (1 - (at - int(at)))
        if int(at) + 1 < quality_knn.STEPS:
            out[quality_knn.GRAMS + j * quality_knn.STEPS + int(at) + 1] += 3 * (at - int(at))
    return out


def test_quality_is_the_vote_of_the_nearest(mixed):
    rows, _, docs, labels = mixed
    model = quality_knn.fit(docs.where("doc_id >= 1000"), labels.select("doc_id", "quality"), sample=120)
    got = {(r["doc_id"], r["text"]): r for r in quality_knn.score(docs, model, keep=("doc_id", "text")).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    project, vectors = model.project.astype(float), model.vectors.astype(float)
    for r in rows:
        x = np.array(plain_terms(r[1] or "")) @ project
        x = x / max(np.linalg.norm(x), 1e-9)
        sims = sorted(((float(x @ v), float(q)) for v, q in zip(vectors, model.labels, strict=True)), reverse=True)
        k = min(model.k, len(sims))
        weight = [max(s, 1e-6) ** 8 for s, _ in sims[:k]]
        want = sum(w * q for w, (_, q) in zip(weight, sims, strict=False)) / sum(weight)
        # where the last neighbour and the next are equally near, either may vote
        slack = weight[-1] / sum(weight) * 2 if k < len(sims) and sims[k - 1][0] - sims[k][0] < 1e-5 else 0
        assert abs(got[r[0], r[1]]["score"] - want) < 2e-3 + slack
        assert got[r[0], r[1]]["predicted"] == int(got[r[0], r[1]]["score"] >= 0.3)


def test_repeated_rows_and_nulls_have_one_score_each(mixed, labels, awkward):
    """Equal texts have equal scores, null and empty ones the same, whatever the other columns say."""
    for run in (lambda: toxicity.held_out_toxicity(awkward, labels), lambda: quality_knn.held_out_quality(awkward, labels)):
        rows = run().join(awkward.select("doc_id", "text"), "doc_id").where("doc_id in (1, 2, 4, 5, 13)").collect()
        by_text: dict = {}
        for r in rows:
            by_text.setdefault(r["text"] or "", set()).add(round(r["score"], 5))
        assert len(by_text) == 2 and all(len(v) == 1 for v in by_text.values())
    got = language.held_out_languages(awkward).collect()
    assert sorted(r["held_out"] for r in got if r["doc_id"] is not None) == sorted(remainder(r["doc_id"], 4) == 2 for r in got if r["doc_id"] is not None)
