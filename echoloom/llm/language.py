"""Language ID by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed character n-grams (one to three letters, case
folded, words bounded by blanks). Each language has several centroids, found by spherical k-means
among its sampled texts, so that spelling, topic or markup variants get their own. The language of the
nearest centroid by cosine is predicted; a text farther from it than nearly all its training texts
were is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import sampled

BUCKETS = 4096
PER_LANGUAGE = 600
SAMPLE_ROWS = 6_000
CENTROIDS = 4
REJECT_QUANTILE = 0.005
UNKNOWN = "und"

_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


class Grams:
    """Counts the n-grams of whole texts."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """Occurrences by bucket; None for a text without letters."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        letters = self.letter[codes]
        if not letters.any():
            return None
        codes = np.where(letters, codes, np.uint32(32))
        keep = np.ones(len(codes), bool)
        keep[1:] = letters[1:] | letters[:-1]  # runs of other characters are one blank
        codes = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)]))
        total = np.zeros(BUCKETS)
        value = np.zeros(len(codes), np.uint32)
        for n in range(3):
            if len(codes) <= n:
                break
            value = value[: len(codes) - n] * np.uint32(31) + codes[n:] * _MULTIPLIERS[n]
            mixed = value ^ (value >> np.uint32(15))
            mixed = mixed * np.uint32(0x2C1B3C6D)
            total += np.bincount((mixed >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
        return total


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    norm = np.linalg.norm(out, axis=-1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


@dataclass(frozen=True)
class Model:
    """Languages, inverse document frequencies, centroids, their language and least similarity."""

    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected?) of each row of counts."""
        near = _weighted(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = near[np.arange(len(best)), best]
        return self.owner[best], cosine, cosine < self.least[best]


def _kmeans(rows: np.ndarray, k: int, seed: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: unit centroids and the rows' assignment."""
    rng = np.random.default_rng(seed)
    picks = [int(rng.integers(len(rows)))]
    near = rows @ rows[picks[0]]
    while len(picks) < min(k, len(rows)):
        gap = np.maximum(1.0 - near, 0) ** 2
        if gap.sum() <= 1e-12:
            break
        picks.append(int(rng.choice(len(rows), p=gap / gap.sum())))
        near = np.maximum(near, rows @ rows[picks[-1]])
    centres = rows[picks]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        means = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        if np.allclose(means, centres, atol=1e-6):
            break
        centres = means
    return centres, (rows @ centres.T).argmax(axis=1)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        langs, blobs = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts = grams.counts(text)
            if counts is not None:
                langs.append(lang)
                blobs.append(np.minimum(counts, 60_000).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(blobs, pa.binary())], ["lang", "counts"])


def fit(docs: DataFrame, allowed: Column | None = None, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS) -> Model:
    """Learn from `docs` (doc_id, text, lang) with a non-NULL lang.

    `allowed` says which rows may be learned from. About `per_language` texts of each language,
    `sample_rows` in all at most, chosen by a hash of their doc_id, reach the driver as count vectors.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Model((), np.ones(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0, np.int64), np.zeros(0))
    each = max(1, min(per_language, sample_rows // len(sizes)))
    chosen = None
    for lang, count in sorted(sizes.items()):
        some = (F.col("lang") == lang) & sampled(F.col("doc_id"), min(1.0, each / count))
        chosen = some if chosen is None else chosen | some
    found = rows.where(chosen).select("lang", "text").mapInArrow(_gram_rows, "lang string, counts binary").orderBy("lang", "counts").collect()
    langs = np.array([r["lang"] for r in found])
    counts = np.stack([np.frombuffer(r["counts"], np.uint16) for r in found]).astype(np.float32) if found else np.zeros((0, BUCKETS), np.float32)
    idf = np.log((1.0 + len(counts)) / (1.0 + (counts > 0).sum(axis=0))) + 1.0
    vectors = _weighted(counts, idf.astype(np.float32))
    names = tuple(sorted(set(langs.tolist())))
    centres, owner, least = [], [], []
    for number, name in enumerate(names):
        own = vectors[langs == name]
        found_centres, place = _kmeans(own, k, seed=number)
        for c, centre in enumerate(found_centres):
            members = own[place == c]
            centres.append(centre)
            owner.append(number)
            least.append(float(np.quantile(members @ centre, REJECT_QUANTILE)) - 0.05 if len(members) else 0.0)
    return Model(names, idf, np.array(centres).reshape(-1, BUCKETS), np.array(owner, np.int64), np.array(least))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of `docs` (doc_id, text).

    score is the cosine to the nearest centroid, 0 to 1. NULL texts and texts without a letter get
    `und`, score 0 and are rejected, as does everything if nothing was learned. Only the text is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CENTROIDS vectors for each language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, known = Grams(), shared.value
        for texts in parts:
            lang, score, far = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
            rows = texts.tolist()
            for start in range(0, len(rows), 512):
                counted = [(i, c) for i in range(start, min(start + 512, len(rows))) if (c := grams.counts(rows[i])) is not None]
                if counted and known.languages:
                    at = np.array([i for i, _ in counted])
                    own, cosine, out = known.predict(np.stack([c for _, c in counted]))
                    lang[at] = np.array(known.languages, object)[own]
                    score[at], far[at] = np.clip(cosine, 0, 1), out
            yield pd.DataFrame({"lang_pred": lang, "score": score, "rejected": far})

    return docs.select("doc_id", told("text").alias("s")).select("doc_id", "s.*")
