"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes disguises: homoglyphs (Cyrillic, Greek, full-width letters) become Latin, digits
and signs inside words become the letters they stand for. Whole-word matches count with their
weight unless they lie inside an exception phrase. The sum is normalised by the number of words;
a logistic curve over sum and density gives the score.

Weights are learned: every word of a bounded sample of labelled rows is counted in Spark by label;
words that come with label 1 far more often than chance allows join the seed terms, and seed terms
that the labels contradict lose their weight. Texts that begin a copy group count once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import sampled, tidy

#: Seed terms.
SEEDS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb filth vermin garbage "
    "bastard bitch cunt dickhead douchebag asshole fuck fucking shit bullshit whore slut retard retarded"
).split()
#: Harmless phrases that hold a seed term.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "pond scum", "soap scum", "garbage collection", "garbage collector",
    "garbage can", "garbage truck", "clown fish", "circus clown", "idiot proof", "sore loser", "dumb waiter", "dumb bell", "dumb terminal",
)
#: Letters that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαορνικτυε", "aeopcyxijsdhkmtbhaopviktue"))
#: What digits and signs stand for inside words.
DIGITS = dict(zip("013457", "oieast"))
SIGNS = {"@": "a", "$": "s"}

SAMPLE_ROWS = 20_000
MAX_TERMS = 2_000
MIN_TEXTS = 6
REJECT = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_SIGN_IN_WORD = re.compile(r"(?<=[^\W_])[@$](?=[^\W_])")
_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS})


def fold_text(text: str) -> str:
    """Lower case, full-width forms and homoglyphs to Latin, digits and inner signs to letters."""
    if not text.isascii():
        text = "".join(unicodedata.normalize("NFKC", c) if "＀" <= c <= "￯" else c for c in text) if re.search("[＀-￯]", text) else text
    text = _SIGN_IN_WORD.sub(lambda m: SIGNS[m.group()], text.lower())
    return text.translate(_TABLE)


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights in (0, 1], exception phrases, and the curve's three coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 4.0, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        if len(found):
            found.make_automaton()
        return found


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of whole-word terms outside exception phrases, in order of their end.

    A term that lies inside a longer matching term counts as the longer one only.
    """
    if not len(automaton):
        return []
    spans = []
    size = len(folded)
    for last, (length, weight) in automaton.iter(folded):
        start, end = last + 1 - length, last + 1
        if (start and folded[start - 1].isalnum()) or (end < size and folded[end].isalnum()):
            continue
        spans.append((start, end, weight))
    if len(spans) > 1:
        spans.sort(key=lambda s: (s[0], -s[1]))
        kept, reach = [], -1
        for span in spans:
            if span[1] > reach:
                kept.append(span)
                reach = span[1]
        spans = kept
    return [s for s in spans if s[2] is not None]


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, float, float]:
    """Matches, their summed weight, and that weight per 100 words."""
    if not text:
        return 0, 0.0, 0.0
    found = matches(fold_text(text), automaton)
    total = float(sum(s[2] for s in found))
    return len(found), total, 100.0 * total / max(1, len(text.split())) if found else 0.0


def curve_score(total: np.ndarray, density: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    z = curve[0] + curve[1] * np.log1p(total) + curve[2] * np.log1p(density)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def score_column(text: Column, lexicon: Lexicon) -> Column:
    """struct(matches long, weight double, score double) of a text.

    A NULL or empty text has no matches and the lowest score of the curve.
    """

    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for texts in parts:
            rows = np.array([features(t, automaton) for t in texts], dtype=float).reshape(-1, 3)
            yield pd.DataFrame({"matches": rows[:, 0].astype("int64"), "weight": rows[:, 1], "score": curve_score(rows[:, 1], rows[:, 2], lexicon.curve)})

    @F.pandas_udf("matches long, weight double, score double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(judged)(parts)

    return scored(text)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic, origin = [], [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = _WORD.findall(fold_text(text or ""))
            if not found:
                continue
            # near copies share the smallest hash of their word triples: they count once for a word
            triples = zip(found, found[1:], found[2:]) if len(found) > 2 else [tuple(found)]
            own = min(zlib.crc32(" ".join(t).encode()) for t in triples)
            distinct = set(found)
            words += distinct
            toxic += [label] * len(distinct)
            origin += [own] * len(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32()), pa.array(origin, pa.int64())], ["word", "toxic", "origin"])


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [features(t, automaton)[1:] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64())], ["toxic", "total", "density"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has a leading column of ones."""
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(len(w)), x.T @ (p - y) + keep @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> Lexicon:
    """Learn a lexicon from `labels` (doc_id, toxic) of `docs` (doc_id, text).

    `allowed` says which doc_ids may be learned from. At most about `sample_rows` labelled rows
    are used (chosen by a hash of their id), which bounds the broadcast side; words are counted
    in Spark, and only the `max_terms` best terms reach the driver. Rows with a NULL id, label or
    text teach nothing. Without labelled rows of both kinds the seed terms stand as they are.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seeds = Lexicon({w: 0.5 for w in SEEDS})
    count = known.count()
    if count == 0:
        return seeds
    known = known.where(sampled(F.col("doc_id"), min(1.0, sample_rows / count)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")  # bounded by sample_rows

    words = rows.mapInArrow(tidy(_word_rows), "word string, toxic int, origin long")
    origins = words.groupBy("word", "toxic").agg(F.countDistinct("origin").alias("n"))
    counted = origins.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"),
    )
    sizes = dict(rows.groupBy("toxic").count().collect())
    pos_rows, neg_rows = sizes.get(1, 0), sizes.get(0, 0)
    if not pos_rows or not neg_rows:
        return seeds
    lift = F.log(((F.col("pos") + 0.5) / (pos_rows + 1)) / ((F.col("neg") + 0.5) / (neg_rows + 1)))
    # surprise of `pos` toxic texts when each text of the word were toxic at the base rate
    base = pos_rows / (pos_rows + neg_rows)
    seen = F.col("pos") + F.col("neg")
    surprise = F.when(F.col("pos") >= seen * base, F.col("pos") * F.log(F.greatest(F.col("pos"), F.lit(1)) / (seen * base)))
    told = counted.withColumn("lift", lift).withColumn("surprise", surprise + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (seen * (1 - base)))).otherwise(0.0))
    strong = told.where((F.col("pos") >= MIN_TEXTS) & (F.col("lift") >= 3.0) & (F.col("surprise") >= 14.0))
    best = strong.orderBy(F.desc("surprise"), "word").limit(max_terms).select("word", "lift").collect()
    judged = {r["word"]: r["lift"] for r in told.where(F.col("word").isin(SEEDS)).select("word", "lift").collect()}
    weights = {w: float(np.clip(judged.get(w, 4.0) / 8.0, 0.0, 1.0)) for w in SEEDS}
    weights |= {r["word"]: float(np.clip(r["lift"] / 8.0, 0.0, 1.0)) for r in best}
    lexicon = Lexicon({w: v for w, v in sorted(weights.items()) if v > 0.05})

    found = rows.mapInArrow(tidy(_feature_rows(lexicon)), "toxic int, total double, density double").toPandas()  # bounded by sample_rows
    x = np.column_stack([np.ones(len(found)), np.log1p(found["total"]), np.log1p(found["density"])])
    w = _logistic(x, found["toxic"].to_numpy(float))
    curve = (float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2])))
    return Lexicon(lexicon.weights, EXCEPTIONS, curve)


def score_documents(docs: DataFrame, lexicon: Lexicon, least: float = REJECT) -> DataFrame:
    """doc_id, matches, score, predicted for every row of `docs`, in one pass without a shuffle."""
    out = docs.select("doc_id", score_column(F.col("text"), lexicon).alias("s"))
    return out.select("doc_id", F.col("s.matches").alias("matches"), F.col("s.score").alias("score"), (F.col("s.score") >= least).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, least: float = REJECT) -> DataFrame:
    """`docs` without the rows whose score reaches `least`; all columns stay as they are."""
    return docs.where(score_column(F.col("text"), lexicon)["score"] < least)
