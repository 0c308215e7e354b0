"""Quality by voting of the nearest labelled documents in a latent-semantic space.

The terms of a document are hashed 4-grams of its characters' shapes (letters by case, digits, each symbol itself) and
a few descriptors in steps: repeated words, repeated lines, words alike in a row, length. TF-IDF of these terms is
projected on the leading singular vectors of a bounded labelled sample; the sample's vectors are broadcast, each
document's cosine with every one of them is computed in blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import remainder, settle, small
from emberfold.llm.textbits import gram_counts

GRAMS, STEPS, DESCRIPTORS = 1024, 8, 6
TERMS = GRAMS + STEPS * DESCRIPTORS


def _shapes() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[ord("a") : ord("z") + 1] = ord("a")
    lut[ord("A") : ord("Z") + 1] = ord("A")
    lut[ord("0") : ord("9") + 1] = ord("0")
    # two-byte letters: the lead byte goes with lower case, of the second byte 0x80-0x9E are capitals in Latin-1
    lut[0xA0:] = ord("a")
    lut[0x80:0x9F] = ord("A")
    return lut


SHAPES = _shapes()


def _descriptors(text: str) -> list[float]:
    """Six shares in [0, 1]."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        1 - len(set(words)) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        same / n if n else 0.0,
        sum(map(str.isupper, words)) / n if n else 0.0,
        min(1.0, np.log1p(n) / 10),
        min(1.0, sum(map(text.count, "#*$%&|<>")) / (n or 1)),
    ]


def term_counts(texts: list[str]) -> np.ndarray:
    """(texts, TERMS): log counts of grams by their share, and each descriptor's step as a term of its own."""
    raw = [t.encode() for t in texts]
    grams = gram_counts(raw, 4, GRAMS, SHAPES)
    size = np.maximum(grams.sum(1, keepdims=True), 1)
    out = np.zeros((len(texts), TERMS), np.float32)
    out[:, :GRAMS] = np.log1p(grams / size * 200)
    for i, t in enumerate(texts):
        for j, v in enumerate(_descriptors(t)):
            at = v * (STEPS - 1)
            low = int(at)
            # a value between two steps counts for both
            out[i, GRAMS + j * STEPS + low] += 3 * (1 - (at - low))
            if low + 1 < STEPS:
                out[i, GRAMS + j * STEPS + low + 1] += 3 * (at - low)
    return out


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.iloc[at : at + 256]
            x = term_counts(part["text"].tolist())
            yield pd.DataFrame({"quality": part["quality"].values, "x": [r.astype(np.float16).tobytes() for r in x]})


class Voters:
    """Projection and the labelled vectors."""

    def __init__(self, project: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int):
        self.project, self.vectors, self.labels, self.k = project, vectors, labels, k

    def embed(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.project
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        sim = self.embed(term_counts(texts)) @ self.vectors.T
        k = min(self.k, sim.shape[1])
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        # neighbours much closer than the rest decide
        weight = np.maximum(np.take_along_axis(sim, near, 1), 1e-6) ** 8
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, dims: int = 48, k: int = 15, seed: int = 7) -> Voters | float:
    """Fit on about ``sample`` rows of ``docs`` that ``labels`` (doc_id, quality) marks, half of either label if there are.

    Ids are drawn from ``labels`` first, so that texts are never shuffled. The driver holds ``sample`` vectors of
    ``TERMS`` halves; the broadcast holds ``sample`` x ``dims`` floats. Returns the only label, or 1.0, instead if there
    are fewer than two labels.
    """
    good = labels.where(F.col("quality").isin(0, 1))
    count = {r["quality"]: r["n"] for r in good.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return float(max(count, default=1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("quality") == 1, min(1.0, sample / 2 / count[1])).otherwise(min(1.0, sample / 2 / count[0]))
    picked = settle(good.where(draw < share))
    drawn = docs.select("doc_id", "text").where("text is not null").join(small(picked), "doc_id")
    rows = drawn.select("text", "quality").mapInPandas(_sample, "quality int, x binary").collect()
    rows = sorted((bytes(r["x"]), r["quality"]) for r in rows)
    labels = np.array([q for _, q in rows], float)
    if len(set(labels)) < 2:
        return float(labels[0]) if len(labels) else 1.0
    x = np.vstack([np.frombuffer(b, np.float16) for b, _ in rows]).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    unit = x * idf / np.maximum(np.linalg.norm(x * idf, axis=1, keepdims=True), 1e-9)
    values, vectors = np.linalg.eigh(unit.T @ unit)
    project = idf[:, None] * vectors[:, np.argsort(-values)[:dims]].astype(np.float32)
    voters = Voters(project, np.zeros((0, dims), np.float32), labels, min(k, 2 * int(min(labels.sum(), (1 - labels).sum())) or 1))
    voters.vectors = voters.embed(x).astype(np.float32)
    return voters


def score(docs: DataFrame, model: Voters | float, threshold: float = 0.3, keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 if score >= threshold) for each row of ``docs``.

    A null text is scored as an empty one. Rows are scored one by one: repeats and other columns change nothing.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        m = broadcast.value
        if isinstance(m, float):
            return pd.Series(m, index=texts.index)
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 512):
            out[at : at + 512] = m.score(texts.iloc[at : at + 512].tolist())
        return pd.Series(out, index=texts.index)

    out = docs.select(*keep, predict(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _model(docs: DataFrame, labels: DataFrame) -> tuple[Voters | float, Column]:
    out = remainder("doc_id", 5) == 0
    learn = labels.where(~out & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fit(docs, learn), out


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled ids whose crc32 by 5 is not 0, score every row."""
    model, out = _model(docs, labels)
    return score(docs, model, keep=("doc_id", out.alias("held_out")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as 1, with their own columns."""
    model, _ = _model(docs, labels)
    names = [c for c in docs.columns]
    scored = score(docs.withColumnRenamed("score", "_own_score").withColumnRenamed("predicted", "_own_predicted"), model, keep=tuple("_own_" + c if c in ("score", "predicted") else c for c in names))
    return scored.where("predicted = 1").select(*[F.col("_own_" + c).alias(c) if c in ("score", "predicted") else F.col(c) for c in names])
