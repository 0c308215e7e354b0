"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed character trigrams (of the UTF-8 bytes of the lower-cased words). Each language has
up to ``per_lang`` centroids, found by spherical k-means on a bounded sample of labelled texts; a text takes the
language of the centroid with the largest cosine. A text further from its centroid than the centroid's own members
(mean similarity less three standard deviations) is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import remainder
from emberfold.llm.textbits import gram_counts

BINS = 4096
LETTER = r"\p{L}"
APART = re.compile(r"[\W\d_]+")


def _counts(texts: list[str]) -> np.ndarray:
    # one blank around each word, so that grams see where words begin and no punctuation
    return gram_counts([f" {APART.sub(' ', t.lower())} ".encode() for t in texts], 3, BINS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.iloc[at : at + 256]
            counts = np.log1p(_counts(part["text"].tolist()))
            yield pd.DataFrame({"lang": part["lang"].values, "x": [r.astype(np.float16).tobytes() for r in counts]})


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids; begins with the mean's farthest points, so that reruns agree."""
    c = _unit(x.mean(0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[np.argmin((x @ c.T).max(1))]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = _unit(np.vstack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


class Centroids:
    """idf, unit centroids, their languages and the least similarity each accepts."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centroids, self.langs, self.least = idf, centroids, langs, least

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x = _unit(np.log1p(_counts(texts)) * self.idf)
        sim = x @ self.centroids.T
        best = sim.argmax(1)
        top = sim[np.arange(len(texts)), best]
        return [self.langs[j] for j in best], np.clip(top, 0, 1).astype(float), top < self.least[best]


def fit(labelled: DataFrame, per_lang: int = 4, sample: int = 400, seed: int = 7) -> Centroids | None:
    """Fit on about ``sample`` texts of each language of ``labelled`` (doc_id, text, lang); None if there is none.

    ``sample`` bounds what the driver holds (``sample`` vectors of 4,096 halves per language); rows are chosen by a
    hash of id and text, so reruns agree.
    """
    good = labelled.where(F.col("text").rlike(LETTER) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in good.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    rows = good.where(draw < share[F.col("lang")]).select("text", "lang").mapInPandas(_sample, "lang string, x binary").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    tf = np.vstack([np.frombuffer(b, np.float16) for _, b in rows]).astype(np.float32)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    x, lang = _unit(tf * idf), np.array([a for a, _ in rows])
    centroids, names, least = [], [], []
    for name in sorted(set(lang)):
        own = x[lang == name]
        c = _kmeans(own, per_lang)
        near, sim = (own @ c.T).argmax(1), (own @ c.T).max(1)
        for j in range(len(c)):
            s = sim[near == j] if (near == j).any() else sim
            centroids.append(c[j])
            names.append(str(name))
            least.append(s.mean() - 3 * s.std())
    return Centroids(idf, np.vstack(centroids), names, np.array(least))


def identify(docs: DataFrame, model: Centroids | None, reject: bool = True, keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score (cosine, 0 to 1) and rejected for each row of ``docs``.

    ``und`` and 0 for a text that is null or has no letter, and for every text if there is no model; with ``reject`` a
    rejected text is ``und`` too, else it keeps the nearest language. Rows are scored one by one: repeats, ties (the
    first centroid in order of language) and other columns change nothing.
    """
    asked = docs.select(*keep, F.when(F.col("text").rlike(LETTER), F.col("text")).alias("_text"))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = broadcast.value
        out = pd.DataFrame({"lang": "und", "score": 0.0, "rejected": False}, index=texts.index)
        have = np.flatnonzero(texts.notna().to_numpy())
        for at in range(0, len(have) if m is not None else 0, 512):
            part = have[at : at + 512]
            lang, score, rejected = m.predict([texts.iloc[i] for i in part])
            out.iloc[part, 0], out.iloc[part, 1], out.iloc[part, 2] = lang, score, rejected
        return out

    out = asked.withColumn("_p", predict("_text")).drop("_text")
    lang = F.when(F.col("_p.rejected"), F.lit("und")).otherwise(F.col("_p.lang")) if reject else F.col("_p.lang")
    return out.withColumns({"lang_pred": lang, "score": F.col("_p.score"), "rejected": F.col("_p.rejected")}).drop("_p")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Learn from ids of remainder 0, 1 and 3 (of crc32 by 4), predict every row."""
    out = remainder("doc_id", 4) == 2
    model = fit(docs.where(~out).select("doc_id", "text", "lang"))
    return identify(docs, model, reject=False, keep=("doc_id", out.alias("held_out")))
