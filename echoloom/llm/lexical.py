"""Ranked lexical search over bit-sliced Bloom signatures.

Documents are gathered in blocks of like size. A block is a bit matrix with a row for each position of a
Bloom signature and a column for each document; a document sets the positions of each of its terms, and
further ones for each frequency level in LEVELS that the term reaches. The rows of a term, and-combined,
tell which documents may hold it, and the levels how often at most: never too few, now and then too many.
Weighted with the term's weight and the document's length, these slices sum up to an upper bound on every
document's score for every item.

The documents with the highest bounds are scored exactly first. The score of the TOP-th of them is a floor:
documents whose bound lies below it are excluded for certain, all others are scored exactly from
their whole texts. So results are those of scoring everything.

The items are the stated query set. They go to the tasks in blocks of at most BLOCK_TERMS terms, and each
block of items is a search of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom.llm.common import frozen

TOP = 20
#: Documents scored for the floor of an item.
SEEDS = 48
#: Frequencies that have bits of their own; from the last on a term counts as infinitely frequent in bounds.
LEVELS = (1, 2, 3, 4, 6, 9, 14, 21, 32, 48, 96)
HASHES = 5
#: Bits of a signature for each entry at least (twice that at most), and bits of a signature at most.
BITS, WIDEST = 8, 1 << 20
#: Documents of a block, and bytes of its matrix at most.
DOCS, MATRIX = 512, 1 << 22
BLOCK_TERMS = 200_000
#: Terms of a block of items that are summed at once.
SLICE = 2048
BROADCAST_PAIRS = 200_000
MEMO = 200_000

_KEPT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[term] = xxhash.xxh3_64_intdigest(term)
        return value


def positions(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """[term, HASHES] rows of a matrix of `width` rows (a power of two)."""
    x = hashes + np.uint64((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return (x[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(width - 1)


def length_factor(n: int, docs: int, total: int) -> int:
    return 75 + 25 * n * docs // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def saturation(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class _Block:
    """Documents of one signature width, until the matrix is full."""

    def __init__(self, width: int):
        self.width, self.room = width, min(DOCS, max(8, 8 * MATRIX // width))
        self.bits = np.zeros((width, self.room // 8), np.uint8)
        self.rows: list[tuple] = []

    def add(self, row: tuple, spots: np.ndarray) -> None:
        at = len(self.rows)
        self.bits[spots, at >> 3] |= np.uint8(128 >> (at & 7))
        self.rows.append(row)

    def packed(self) -> tuple:
        return self.width, [r[0] for r in self.rows], [r[1] for r in self.rows], [r[2] for r in self.rows], self.bits[:, : -(-len(self.rows) // 8)].tobytes()


_INDEX = "width int, ids array<long>, digests array<long>, sizes array<long>, bits binary, term int, df long, docs long, total long"


def _indexed(vocabulary: dict[bytes, int]):
    def batch_of(blocks: list[tuple], counts: list[tuple], sums: list[tuple]) -> pa.RecordBatch:
        rows = [(*b, None, None, None, None) for b in blocks] + [(*[None] * 5, *c, None, None) for c in counts] + [(*[None] * 7, *s) for s in sums]
        kinds = [pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, open_, df, docs, total = _Hashes(), {}, Counter(), 0, 0
        for batch in batches:
            for doc_id, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text"))):
                found = terms(text)
                if not found:
                    continue
                docs, total = docs + 1, total + len(found)
                held = Counter(found)
                df.update(vocabulary.keys() & held.keys())
                hashes = np.fromiter(map(memo.__getitem__, held), np.uint64, len(held))
                often = np.fromiter(held.values(), np.int64, len(held))
                reached = [hashes[often >= least] for least in LEVELS]
                width = min(WIDEST, max(64, 1 << (BITS * sum(map(len, reached)) - 1).bit_length()))
                if width not in open_:
                    open_[width] = _Block(width)
                block = open_[width]
                spots = np.concatenate([positions(h, level, width).reshape(-1) for level, h in enumerate(reached) if len(h)])
                block.add((doc_id, digest, len(found)), spots)
                if len(block.rows) == block.room:
                    yield batch_of([block.packed()], [], [])
                    del open_[width]
        for block in open_.values():
            yield batch_of([block.packed()], [], [])
        yield batch_of([], [(vocabulary[t], n) for t, n in df.items()], [(docs, total)])

    return run


@dataclass(frozen=True)
class Queries:
    """A block of items for the tasks: terms, their weights, and how often each item has which."""

    ids: list[int]
    terms: list[bytes]
    weights: list[int]
    counts: list[dict[int, int]]
    docs: int
    total: int


def bounds(width: int, sizes: list[int], bits: bytes, queries: Queries, hashes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """[item, document of the block] upper bounds on scores; `matrix` has the item's counts by term."""
    count = len(sizes)
    rows = np.frombuffer(bits, np.uint8).reshape(width, -1)
    ms = [length_factor(n, queries.docs, queries.total) for n in sizes]
    # the score of a term by level: as frequent as may be below the next level
    ceilings = np.array([[0] * count, *([saturation(nxt - 1, m) for m in ms] for nxt in LEVELS[1:]), [1_000_000] * count], np.float64)
    weights = np.array(queries.weights, np.float64)
    out = np.zeros((len(queries.ids), count))
    for start in range(0, len(hashes), SLICE):
        part = hashes[start : start + SLICE]
        live, spots = np.arange(len(part)), np.bitwise_and.reduce(rows[positions(part, 0, width)], axis=1)
        held = spots.any(axis=1)
        live, spots = live[held], spots[held]
        if not len(live):
            continue
        level = np.unpackbits(spots, axis=1, count=count)
        among = np.arange(len(live))
        for k in range(1, len(LEVELS)):
            spots = spots & np.bitwise_and.reduce(rows[positions(part[live[among]], k, width)], axis=1)
            more = spots.any(axis=1)
            among, spots = among[more], spots[more]
            if not len(among):
                break
            level[among] += np.unpackbits(spots, axis=1, count=count)
        gain = np.take_along_axis(ceilings, level.astype(np.intp), axis=0) * weights[start + live][:, None]
        out += matrix[:, start + live] @ gain
    return out if out.max(initial=0) < 1 << 52 else out * (1 + 1e-9)


def _prepared(queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.zeros((len(queries.ids), len(queries.terms)))
    for i, held in enumerate(queries.counts):
        matrix[i, list(held)] = list(held.values())
    return np.array([xxhash.xxh3_64_intdigest(t) for t in queries.terms], np.uint64), matrix


_FOUND = "item int, doc_id long, digest long, bound double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["item", "doc_id", "digest", "bound"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in ("width", "ids", "digests", "sizes", "bits"))


def _highest(queries: Queries, seeds: int):
    """Of each task, the `seeds` documents of each item with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, matrix = _prepared(queries)
        best: list[list[tuple]] = [[] for _ in queries.ids]
        for width, ids, digests, sizes, bits in _blocks(batches):
            for item, row in enumerate(bounds(width, sizes, bits, queries, hashes, matrix)):
                floor = best[item][-1][0] if len(best[item]) >= seeds else 0
                at = np.nonzero(row > floor)[0]
                if len(at) > seeds:
                    at = at[np.argpartition(-row[at], seeds - 1)[:seeds]]
                if len(at):
                    both = best[item] + [(row[j], ids[j], digests[j]) for j in at.tolist()]
                    best[item] = sorted(both, key=lambda b: -b[0])[:seeds]
        for item, rows in enumerate(best):
            if rows:
                yield _batch([(item, doc_id, digest, bound) for bound, doc_id, digest in rows])

    return run


def _open(queries: Queries, floors: dict[int, tuple[int, int | None]]):
    """All documents that are not excluded: bound over the floor, or at it with an id that may still come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, matrix = _prepared(queries)
        for width, ids, digests, sizes, bits in _blocks(batches):
            order = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
            found = []
            for item, row in enumerate(bounds(width, sizes, bits, queries, hashes, matrix)):
                score, last = floors.get(item, (1, None))
                keep = row > score
                keep |= (row == score) if last is None else (row == score) & (order <= last)
                found += [(item, ids[j], digests[j], row[j]) for j in np.nonzero(keep)[0].tolist()]
            if found:
                yield _batch(found)

    return run


def _scored(queries: Queries):
    number = {t: i for i, t in enumerate(queries.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                found = terms(text)
                if not found:
                    continue
                m = length_factor(len(found), queries.docs, queries.total)
                gain = {}
                for term, tf in Counter(found).items():
                    if (k := number.get(term)) is not None:
                        gain[k] = queries.weights[k] * saturation(tf, m)
                for item in items:
                    held = queries.counts[item]
                    out.append((item, doc_id, sum(times * gain[k] for k, times in held.items() if k in gain)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], ["item", "doc_id", "score"])

    return run


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    first = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.where("score > 0").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)


def _search(texts: DataFrame, items: list[tuple[int, list[bytes]]], top: int, seeds: int) -> DataFrame:
    """(item, doc_id, score, rank) for a block of items (number, terms); `item` counts within the block."""
    spark = texts.sparkSession
    known = sorted({t for _, found in items for t in found})
    vocabulary = {t: i for i, t in enumerate(known)}
    index = frozen(texts.mapInArrow(_indexed(vocabulary), _INDEX))
    docs, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not docs:
        return spark.createDataFrame([], "item int, doc_id long, score long, rank int")
    df = dict(index.where("term is not null").groupBy("term").agg(F.sum("df")).collect())  # BLOCK_TERMS rows at most
    queries = Queries([n for n, _ in items], known, [weight(docs, df.get(i, 0)) for i in range(len(known))], [dict(Counter(vocabulary[t] for t in found)) for _, found in items], docs, total)
    blocks = index.where("bits is not null").select("width", "ids", "digests", "sizes", "bits")

    def exact(pairs: DataFrame) -> DataFrame:
        """(item, doc_id, score): every document that is paired with an item, its text read once."""
        wanted = frozen(pairs.groupBy(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest")).agg(F.collect_set("item").alias("items")))
        if (wanted.agg(F.sum(F.size("items"))).first()[0] or 0) <= BROADCAST_PAIRS:
            wanted = F.broadcast(wanted)
        met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("digest") == F.col("__digest")))
        return met.select("doc_id", "text", "items").mapInArrow(_scored(queries), "item int, doc_id long, score long")

    highest = blocks.mapInArrow(_highest(queries, seeds), _FOUND)
    order = W.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last())
    first = highest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= seeds)
    floors = {r["item"]: (r["score"], r["doc_id"]) for r in _ranked(exact(first), top).where(F.col("rank") == top).collect()}  # one row an item of the block
    return _ranked(frozen(exact(blocks.mapInArrow(_open(queries, floors), _FOUND))), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, seeds: int = SEEDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with a score above 0, best first.

    docs has doc_id and text, items item_id and text; other columns play no part. Equal scores go by
    ascending doc_id, NULL ids last. Repeated rows are documents and items of their own; repeated items
    have results of their own under the same id, and a NULL item_id is reported as NULL. NULL
    and empty texts have no terms: such documents are never found and such items find nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("digest", F.xxhash64("text"))
    listed = frozen(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("number", F.monotonically_increasing_id()))
    words = F.size(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    sized = frozen(listed.where("text is not null").select("number", "text", words.cast("long").alias("n")))
    blocks = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // block_terms))
    parts = []
    for block in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        found = [(r["number"], terms(r["text"])) for r in mine.orderBy("number").toLocalIterator()]  # about block_terms terms
        found = [(n, t) for n, t in found if t]
        if found:
            numbers = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(found)], "item int, number long")
            parts.append(_search(texts, found, top, seeds).join(F.broadcast(numbers), "item").select("number", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts).join(listed.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
