"""Toxicity by a subsequence string kernel and a support vector machine over Nystroem landmarks.

Two words are alike by the subsequences of ``P`` letters that they share; a subsequence may skip up to ``SKIP`` letters
and each skipped letter multiplies its weight by ``DECAY``, so that inserted letters cost little. Punctuation and
digits inside words are removed, and letters that stand alone in a row are joined, before words are compared.

The machine is trained on labelled sentences (the words of a document, a bag with one label) as multiple instances: a
toxic bag is represented by its highest-scoring words, a clean one by all. With the landmarks' weights ``w`` the decision
``w . K(landmarks, word)`` is a weighted sum over the word's own subsequences, so the landmarks fold into one table of
weights per subsequence, and scoring a word is one lookup for each of its subsequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import remainder, settle, small
from emberfold.llm.textbits import mix

P, SKIP, DECAY = 4, 2, 0.5
BITS = 17
LONGEST = 28  # letters of a word that are compared at once; longer words are cut into overlapping parts
INSIDE = re.compile(r"[^\w\s]+|[\d_]+")
LONE = re.compile(r"\b(?:\w ){3,}\w\b")


def _offsets() -> list[tuple[tuple[int, ...], float]]:
    """The first letter of a subsequence and P - 1 of the letters that follow, with its weight."""
    out = []
    for rest in combinations(range(1, P + SKIP), P - 1):
        out.append(((0, *rest), DECAY ** (rest[-1] - (P - 1))))
    return out


OFFSETS = _offsets()


def tokens(text: str) -> set[str]:
    """Distinct words of a text, as they are compared."""
    clean = INSIDE.sub("", text.lower())
    clean = LONE.sub(lambda m: m.group().replace(" ", ""), clean)
    out: set[str] = set()
    for w in set(clean.split()):
        if len(w) <= LONGEST:
            out.add(w)
        else:
            out.update(w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return out


def subsequences(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length at a time: their positions in ``batch``, hashed subsequences and weights.

    A word is read with a mark before and after it.
    """
    lens = np.array([len(w) for w in batch])
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        raw = np.frombuffer("".join(f"^{batch[i]}$" for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n + 2)
        raw = raw.astype(np.uint64)
        codes, weights = [], []
        for offs, weight in OFFSETS:
            m = n + 2 - offs[-1]
            if m <= 0:
                continue
            code = np.zeros((len(at), m), np.uint64)
            for o in offs:
                code = code * np.uint64(1099511628211) + raw[:, o : o + m]
            codes.append(code)
            weights.append(np.full(m, weight, np.float32))
        if codes:
            code = (mix(np.hstack(codes)) >> np.uint64(64 - BITS)).astype(np.int64)
            yield at, code, np.hstack(weights)


def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of K(word, word): weights of equal subsequences add up before they are squared."""
    order = np.argsort(code, axis=1, kind="stable")
    c, w = np.take_along_axis(code, order, 1), weight[order].astype(np.float64)
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, w.ravel())
    rows = np.repeat(np.arange(len(c)), c.shape[1])[new.ravel()]
    return np.sqrt(np.bincount(rows, sums**2, minlength=len(c)))


class Machine:
    """The folded table of weights, the bias, and the logistic curve from a document's best word to a probability."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift

    def words(self, batch: list[str]) -> np.ndarray:
        out = np.full(len(batch), self.bias)
        step = 20_000
        for begin in range(0, len(batch), step):
            for at, code, weight in subsequences(batch[begin : begin + step]):
                out[begin + at] += (self.table[code] * weight).sum(1) / np.maximum(norms(code, weight), 1e-9)
        return out

    def bags(self, bags: list[set[str]]) -> np.ndarray:
        """The highest word of each bag; the floor of -3 for one without words."""
        ids: dict[str, int] = {}
        flat = [ids.setdefault(w, len(ids)) for bag in bags for w in bag]
        best = np.full(len(bags), -3.0)
        if flat:
            value = self.words(list(ids))[flat]
            lens = np.array([len(b) for b in bags])
            starts = np.cumsum(lens) - lens
            full = lens > 0
            best[full] = np.maximum.reduceat(value, starts[full])
        # beyond the margin a word is toxic for certain; more adds little
        return np.where(best > 1, 1 + 0.02 * (np.minimum(best, 3) - 1), np.maximum(best, -3))

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.slope * self.bags([tokens(t) for t in texts]) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _vectors(batch: list[str]) -> np.ndarray:
    """Dense unit vectors of few words, over all hashed subsequences."""
    out = np.zeros((len(batch), 1 << BITS), np.float32)
    for at, code, weight in subsequences(batch):
        np.add.at(out, (np.repeat(at, code.shape[1]), code.ravel()), np.tile(weight, len(at)))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the violating rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = np.eye(x1.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(25):
        bad = y * (x1 @ w) < 1
        xb, wb = x1[bad], weight[bad][:, None]
        new = np.linalg.solve(reg + 2 * c * xb.T @ (wb * xb), 2 * c * xb.T @ (wb[:, 0] * y[bad]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _train(words: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str]) -> Machine:
    """Nystroem map of ``words`` on ``landmarks``, the machine, and both folded into one table."""
    basis = _vectors(landmarks)
    k = basis @ basis.T
    values, vectors = np.linalg.eigh(k.astype(float))
    good = values > 1e-6
    half = vectors[:, good] / np.sqrt(values[good])
    cross = np.zeros((len(words), len(landmarks)), np.float32)
    for at, code, w in subsequences(words):
        n = np.maximum(norms(code, w), 1e-9)
        for j in range(len(landmarks)):
            cross[at, j] = (basis[j][code] * w).sum(1) / n
    coef, bias = _svm(cross @ half, y, weight)
    return Machine((basis.T @ (half @ coef)).astype(np.float32), bias, 2.0, 0.0)


def _top(bags: list[list[str]], by: dict[str, float], good, most: int = 3) -> list[str]:
    """Up to ``most`` words of each bag, the highest first: the first one always, others if they are ``good``."""
    out = []
    for bag in bags:
        order = sorted(bag, key=lambda w: (-by[w], w))[:most]
        out += order[:1] + [w for w in order[1:] if good(w, by[order[0]])]
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | x), lightly regularised."""
    a = np.zeros(2)
    d = np.column_stack([x, np.ones_like(x)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ a, -30, 30)))
        h = d.T @ (d * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        a = a + np.linalg.solve(h, d.T @ (y - p) - 1e-2 * a)
    return float(max(a[0], 0.1)), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, longest: int = 20_000, landmarks: int = 240, clean_words: int = 3000, seed: int = 7) -> Machine | float:
    """Fit on about ``sample`` toxic and as many clean texts of ``docs`` that ``labels`` (doc_id, toxic) marks.

    Ids are drawn from ``labels`` first, so that texts are never shuffled. ``sample`` texts a class of at most
    ``longest`` characters bound what the driver holds, ``clean_words`` drawn words of clean texts what the machine starts
    from. Returns the share of toxic rows instead, if one of the classes
    is missing.
    """
    good = labels.where(F.col("toxic").isin(0, 1))
    count = {r["toxic"]: r["n"] for r in good.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return float(max(count, default=0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, min(1.0, sample / count[1])).otherwise(min(1.0, sample / count[0]))
    picked = settle(good.where(draw < share))
    drawn = docs.select("doc_id", "text").where(F.length("text") <= longest).join(small(picked), "doc_id")
    # a text that repeats is one example
    rows = sorted((r["text"], r["toxic"]) for r in drawn.groupBy("text").agg(F.max("toxic").alias("toxic")).collect())
    bags, label = [sorted(tokens(t)) for t, _ in rows], np.array([x for _, x in rows])
    del rows
    if len(set(label)) < 2:
        return float(label[0]) if len(label) else 0.0

    seen: dict[str, list[int]] = {}
    for bag, x in zip(bags, label, strict=True):
        for w in bag:
            seen.setdefault(w, [0, 0])[x] += 1
    ratio = (label == 0).sum() / (label == 1).sum()
    contrast = {w: (t * ratio + 0.1) / (c + 1.0) for w, (c, t) in seen.items()}
    rng = np.random.default_rng(seed)
    clean = sorted(w for w, (c, _) in seen.items() if c)
    clean = [clean[i] for i in rng.choice(len(clean), min(clean_words, len(clean)), replace=False)] if clean else []
    toxic_bags = [b for b, x in zip(bags, label, strict=True) if x == 1 and b]
    clean_bags = [b for b, x in zip(bags, label, strict=True) if x == 0 and b]
    if not toxic_bags:
        return 0.0
    witness = _top(toxic_bags, contrast, lambda w, best: contrast[w] > 3 and contrast[w] > best / 4)
    hard: set[str] = set()
    machine = None
    for _ in range(4):
        votes = pd.Series(witness).value_counts()
        positive = sorted(set(votes.index) - hard)
        negative = sorted((set(clean) | hard) - set(positive))
        if not positive or not negative:
            return float(label.mean())
        half = landmarks // 2
        top = sorted(positive, key=lambda w: (-votes[w], w))[:half]
        marks = top + [negative[i] for i in rng.choice(len(negative), min(half, len(negative)), replace=False)]
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weight = np.array([1 + np.log(votes[w]) for w in positive] + [1.0] * len(negative))
        machine = _train(positive + negative, y, weight, marks)
        words = list(seen)
        value = dict(zip(words, machine.words(words), strict=True))
        witness = _top(toxic_bags, value, lambda w, best: contrast[w] > 3 and value[w] > best / 2)
        # clean documents' best words are negatives, unless they are seen in many more toxic ones
        worst = {max(b, key=lambda w: (value[w], w)) for b in clean_bags}
        hard |= {w for w in worst if value[w] > -0.5 and contrast[w] < 5}
    best = machine.bags([set(b) for b in bags])
    machine.slope, machine.shift = _logistic(best, label.astype(float))
    return machine


def score(docs: DataFrame, model: Machine | float, threshold: float = 0.7, keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 if score >= threshold) for each row of ``docs``.

    Null and empty texts have the score of a text without words; rows are scored one by one, so repeats, ties and other
    columns change nothing.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        m = broadcast.value
        if isinstance(m, float):
            return pd.Series(m, index=texts.index)
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 2000):
            out[at : at + 2000] = m.score([t or "" for t in texts.iloc[at : at + 2000]])
        return pd.Series(out, index=texts.index)

    out = docs.select(*keep, predict(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled ids whose crc32 by 3 is not 1, score every row."""
    out = remainder("doc_id", 3) == 1
    learn = labels.where(~out & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(docs, learn)
    return score(docs, model, keep=("doc_id", out.alias("held_out")))
