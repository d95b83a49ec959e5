"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes (XXH64, seed 42)
of its shingles of three words, repeats included. Fingerprints link at DISTANCE = 2 differing bits or
fewer, and documents of linked fingerprints belong together.

Equal fingerprints are one class from the start. Of two linked ones, either the upper halves differ in
one bit at most, or the lower halves are equal (1 + 1 > 2 otherwise), so each class is filed under both
halves and looks up the Hamming ball of radius 1 of its upper half; flips from 0 to 1 are enough, as the
other side of a pair makes the opposite one. A bucket is what meets under one key. Keys of more
than LIMIT classes get 16 bits of the other half by the same rule, so a bucket never has more than
2^16 classes at home, and the visitors of a key one flip away.

A bucket is verified row against rows over all 64 bits, and sends only pairs that join parts that were
apart in it: a dense group costs rows in proportion to its members, not to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import frozen
from echoloom.llm.jaccard import linked

SHINGLE = 3
DISTANCE = 2
#: Classes that meet under a key before it is made finer.
LIMIT = 4096
#: Shingles hashed at once, and hot keys sent to all tasks at most.
CHUNK = 65_536
BROADCAST_KEYS = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words, NULL or empty ones included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for start in range(0, count, CHUNK):
        part = words[start : min(start + CHUNK, count) + SHINGLE - 1]
        texts = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) >= SHINGLE else iter([b" ".join(part)])
        hashes = np.fromiter((digest(t, 42) for t in texts), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of 255 bits fit one byte
            total += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits((2 * total > count).astype(np.uint8), bitorder="little").view("<u8")[0])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of `docs` (doc_id, text); fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketched, "doc_id long, fp long")


def _bits(fp: Column, at: int, width: int) -> Column:
    """`width` bits of a fingerprint from bit `at` on."""
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _ball(value: Column, width: int) -> Column:
    """The value itself (home) and every value with one 0 of its `width` bits turned to 1 (visits)."""
    shift = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    up = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: value.bitwiseAND(shift(i)) == 0)
    visits = F.transform(up, lambda i: F.struct(F.lit(1).alias("visit"), value.bitwiseOR(shift(i)).alias("key")))
    return F.concat(F.array(F.struct(F.lit(0).alias("visit"), value.alias("key"))), visits)


def _filed(classes: DataFrame, limit: int) -> DataFrame:
    """(half, key, fine, sub, visit, fp): every class under every key where it may meet a linked one.

    `fine` says which quarter the second key, `sub`, is of: 0 none, 1 the upper quarter of the other half, 2 the lower one.
    """
    fp = F.col("fp")
    upper = classes.select(fp, F.lit(0).alias("half"), F.explode(_ball(_bits(fp, 32, 32), 32)).alias("e")).select("fp", "half", "e.key", "e.visit")
    rows = upper.unionByName(classes.select(fp, F.lit(1).alias("half"), _bits(fp, 0, 32).alias("key"), F.lit(0).alias("visit")))
    hot = frozen(rows.groupBy("half", "key").agg(F.count("*").alias("n"), F.min("visit").alias("least")).where((F.col("n") > limit) & (F.col("least") == 0)).select("half", "key"))
    marks = hot.withColumn("hot", F.lit(True))
    if hot.count() <= BROADCAST_KEYS:
        marks = F.broadcast(marks)
    rows = rows.join(marks, ["half", "key"], "left")
    cold = rows.where("hot is null").select("half", "key", F.lit(0).alias("fine"), F.lit(0).cast("long").alias("sub"), "visit", "fp")
    # the rest of a pair: two bits between members, one (or none, for the same flip twice) between visitor and member
    base = F.when(F.col("half") == 0, F.lit(0)).otherwise(F.lit(32))
    other = F.shiftrightunsigned(fp, 0).bitwiseAND(F.lit((1 << 32) - 1))
    other = F.when(base == 0, other).otherwise(_bits(fp, 32, 32))
    high, low = F.shiftright(other, 16), other.bitwiseAND(F.lit((1 << 16) - 1))
    entry = lambda fine, sub, visit: F.struct(F.lit(fine).alias("fine"), sub.alias("sub"), visit.alias("visit"))
    seen = F.col("visit")
    home = F.transform(_ball(high, 16), lambda e: entry(1, e["key"], e["visit"]))
    fine = F.when(seen == 0, F.concat(home, F.array(entry(2, low, seen)))).otherwise(F.array(entry(1, high, seen), entry(2, low, seen)))
    deep = rows.where("hot").select("half", "key", "fp", F.explode(fine).alias("e")).select("half", "key", "e.fine", "e.sub", "e.visit", "fp")
    return cold.unionByName(deep)


def _verified(distance: int):
    def pairs_of(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Linked pairs of a bucket that join parts of it; visitors are only compared with members."""
        home = np.array([fp for visit, fp in rows if not visit], np.int64)
        if not len(home) or len(rows) < 2:
            return
        fps = np.concatenate([home, np.array([fp for visit, fp in rows if visit], np.int64)])
        words, part = fps.view(np.uint64), np.arange(len(fps))
        for i in range(len(home)):
            near = np.nonzero(np.bitwise_count(words[i + 1 :] ^ words[i]) <= distance)[0] + i + 1
            near = near[part[near] != part[i]]
            if len(near):
                parts, first = np.unique(part[near], return_index=True)
                for j in near[first].tolist():
                    yield int(fps[i]), int(fps[j])
                part[np.isin(part, parts)] = part[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def drained() -> pa.RecordBatch:
            pairs = list(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("half", "key", "fine", "sub", "visit", "fp")]
            for half, value, fine, sub, visit, fp in zip(*cols):
                here = (half, value, fine, sub)
                if here != key:
                    out.extend(pairs_of(rows))
                    key, rows = here, []
                if rows or not visit:  # members come first; visitors of an empty bucket are let go
                    rows.append((visit, fp))
            if len(out) >= 10_000:
                yield drained()
        out.extend(pairs_of(rows))
        yield drained()

    return run


def links(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b) of linked fingerprints `fp` (distinct), a spanning forest for each bucket."""
    filed = _filed(classes, limit)
    spots = ["half", "key", "fine", "sub"]
    met = filed.repartition(*spots).sortWithinPartitions(*spots, "visit", "fp")
    return met.mapInArrow(_verified(DISTANCE), "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own included. Texts without words
    (NULL, empty, white space) have fingerprint zero and are linked like any other. Repeated rows
    give repeated results. Rows with a NULL doc_id take part in links; a component in which
    all ids are NULL has a NULL id. Other columns of `docs` play no part.
    """
    sketched = frozen(fingerprints(docs))
    classes = frozen(sketched.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    grouped = linked(frozen(links(classes.select("fp"), limit)))
    named = frozen(classes.join(grouped.withColumnRenamed("id", "fp"), "fp").select("fp", "first_doc", "component"))
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("least"))
    moved = named.join(smallest, "component").select("fp", "least")
    # classes without links keep their own least id; the others get that of their component
    by_fp = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first_doc").alias("component_id"))
    out = sketched.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
