"""Vector code compression: product quantisation in exact integers, with norm-of-sum bounds.

Components become floor(SCALE * x) and vectors are cut into PARTS equal parts; each part position has a
codebook of ENTRIES entries, trained by ROUNDS rounds of exact k-means over all vectors. The codebooks
of all rounds are kept. A part remembers its entry with the distance to it, and for each of GROUPS
groups of entries a lower bound on the distance to the other entries of the group; each of these numbers
carries the stamp of the round in which it was measured. In a later round the entry's distance grows and a group's
bound falls by the net displacement of the entries between the two rounds, the norm of the sum of their
moves, which is at most the sum of the norms that accumulated drifts would take. Only where a lower
bound does not stay above the upper one are the group's entries measured again. Bounds are rounded to the safe
side, so that every tie is measured, and measured distances are exact integers.

A round reads the table of vectors and bounds once and writes it once, as Parquet in the shared checkpoint folder;
the table of the round before last is deleted. Sums of entries change by the parts that moved only. Only
codebooks and their sums, PARTS * ENTRIES rows of a fixed size, come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import drop_folder, frozen
from echoloom.session import ensure_checkpoint_dir

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
GROUPS = 4
#: Components up to here are compared in 64-bit integers, larger ones in unbounded ones.
EXACT = 1 << 25
LONG_MAX = (1 << 63) - 1
LIMB = 10**18
#: Stamp of a bound that was never measured, and the share by which bounds give way to rounding.
NEW = 255
SLACK = 1e-9
#: Labels whose sums are sent to all tasks at most.
BROADCAST_LABELS = 100_000

_STATE = "vec_id long, label {label}, vec binary, codes binary, stamps binary, bounds binary, part int, entry int, pos int, limb int, change decimal(38,0)"


@dataclass(frozen=True)
class Codebooks:
    """Entries of all rounds: history[round][part, entry, position within part], Python integers."""

    history: tuple[np.ndarray, ...]

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.last.reshape(-1).tolist()).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, embedding) of rows whose vector is not NULL and holds no NULL or non-finite component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", odd))


def _integers(lists: list, length: int) -> np.ndarray:
    """Floors of SCALE * x, padded with zeros to `length`: int64, or Python integers if one is large."""
    out = np.zeros((len(lists), length))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    if np.abs(out).max(initial=0) < EXACT // SCALE:
        return np.floor(out * SCALE).astype(np.int64)
    whole = lambda x: math.floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE
    exact = np.zeros((len(lists), length), object)
    for i, x in enumerate(lists):
        exact[i, : len(x)] = [whole(v) for v in x]
    return exact


def _packed(vector: np.ndarray) -> bytes:
    """A vector in the narrowest form that holds it; the first byte tells which."""
    top = max((abs(x) for x in vector.tolist()), default=0)
    for mark, kind, limit in ((b"h", "<i2", 1 << 15), (b"i", "<i4", 1 << 31)):
        if top < limit:
            return mark + vector.astype(kind).tobytes()
    return b"t" + ",".join(map(str, vector.tolist())).encode()


def _unpacked(blobs: list[bytes], length: int) -> np.ndarray:
    kinds = {b[:1] for b in blobs}
    if len(kinds) == 1 and kinds <= {b"h", b"i"}:
        kind = "<i2" if kinds == {b"h"} else "<i4"
        rows = np.frombuffer(b"".join(b[1:] for b in blobs), kind).reshape(len(blobs), length).astype(np.int64)
        return rows if kind == "<i2" or np.abs(rows).max(initial=0) < EXACT else rows.astype(object)
    read = {b"h": lambda b: np.frombuffer(b, "<i2").tolist(), b"i": lambda b: np.frombuffer(b, "<i4").tolist(), b"t": lambda b: [int(x) for x in b.decode().split(",")]}
    rows = np.array([read[b[:1]](b[1:]) for b in blobs], object).reshape(len(blobs), length)
    return rows.astype(np.int64) if max((abs(x) for x in rows.reshape(-1).tolist()), default=0) < EXACT else rows


def _large(numbers: np.ndarray) -> bool:
    return max((abs(x) for x in numbers.reshape(-1).tolist()), default=0) >= EXACT


def _squares(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis."""
    kind = object if vectors.dtype == object or _large(entries) else np.int64
    return ((vectors.astype(kind) - entries.astype(kind)) ** 2).sum(axis=-1)


def _down(numbers: np.ndarray) -> np.ndarray:
    """32-bit floats that are not above the numbers."""
    short = numbers.astype(np.float32)
    return np.where(short > numbers, np.nextafter(short, np.float32(0)), short).astype(np.float32)


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Distances as 32-bit floats, rounded up or down; distances over the largest float are infinite or that float."""
    root = np.sqrt(np.array([float(min(x, 1 << 240)) for x in squares.tolist()]) if squares.dtype == object else squares.astype(np.float64))
    root = np.minimum(root, 1e38) if not up else np.where(root > 1e38, np.inf, root)
    return -_down(-root * (1 + 1e-12)) if up else _down(root * (1 - 1e-12))


def _root(square: int) -> float:
    bits = square.bit_length()
    return math.sqrt(square) if bits < 1000 else float(math.isqrt(square) + 1) if bits < 2040 else math.inf


def displacements(history: list[np.ndarray] | tuple[np.ndarray, ...]) -> np.ndarray:
    """[round, part, entry]: net displacement from each round to the last, rounded up."""
    moves = np.array([((history[-1] - book) ** 2).sum(axis=2) for book in history])
    return np.array([_root(x) for x in moves.reshape(-1).tolist()]).reshape(moves.shape) * (1 + SLACK)


def _groups(entries: int) -> list[np.ndarray]:
    return [g for g in np.array_split(np.arange(entries), GROUPS) if len(g)]


def reassign(vectors: np.ndarray, codes: np.ndarray, stamps: np.ndarray, bounds: np.ndarray, history: list[np.ndarray] | tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, stamps, bounds) of a batch for the last codebooks of `history`, and how many distances were measured.

    codes [row, part]; stamps and bounds [row, part, 1 + GROUPS]: first the distance of the part's own
    entry, then lower bounds for the other entries of each group. A stamp of NEW holds nothing.
    """
    now, measured = len(history) - 1, 0
    groups, moved = _groups(history[-1].shape[1]), displacements(history)
    codes, stamps, bounds = codes.copy(), stamps.copy(), bounds.copy()
    width = vectors.shape[1] // PARTS
    for part in range(PARTS):
        mine, book = vectors[:, part * width : (part + 1) * width], history[-1][part]
        far = moved[:, part].copy()

        def lower(rows: np.ndarray, g: int) -> np.ndarray:
            """What the other entries of the group are away at least."""
            stamp, bound = stamps[rows, part, 1 + g], bounds[rows, part, 1 + g].astype(np.float64)
            told = stamp < NEW
            gone = far[:, groups[g]].max(axis=1)[np.where(told, stamp, 0)]
            return np.where(told, bound * (1 - SLACK) - gone, -np.inf)

        known = stamps[:, part, 0] < NEW
        upper = bounds[:, part, 0] * (1 + SLACK) + far[np.where(known, stamps[:, part, 0], 0), codes[:, part]]
        upper = np.where(known, upper, np.inf)
        every = np.arange(len(mine))
        rows = every[~np.all([lower(every, g) > upper for g in range(len(groups))], axis=0)]
        if not len(rows):
            continue
        # the distance of the own entry first: it may already settle the groups
        big = mine.dtype == object or _large(book)
        never = 1 << 2200 if big else 1 << 62
        exact = np.full((len(rows), len(book)), never, object if big else np.int64)
        mark, own, had = np.arange(len(rows)), codes[rows, part].astype(np.int64), known[rows]
        exact[mark[had], own[had]] = _squares(mine[rows[had]], book[own[had]])
        measured += int(had.sum())
        tight = np.full(len(rows), np.inf)
        tight[had] = _roots(exact[mark[had], own[had]], True)
        opened = np.stack([~(lower(rows, g) > tight * (1 + SLACK)) for g in range(len(groups))], axis=1)
        for g, members in enumerate(groups):
            at = mark[opened[:, g]]
            exact[np.ix_(at, members)] = _squares(mine[rows[at], None, :], book[None, members, :])
            measured += len(at) * len(members)
        chosen = exact.argmin(axis=1)  # the first of equals; what was not measured is farther
        codes[rows, part], stamps[rows, part, 0] = chosen, now
        bounds[rows, part, 0] = _roots(exact[mark, chosen], True)
        moved_away = had & (chosen != own)
        for g, members in enumerate(groups):
            others = np.where(members[None, :] == chosen[:, None], never, exact[:, members]).min(axis=1)
            low = np.where(others == never, np.float32(np.inf), _roots(others, False))
            at = opened[:, g]
            # an entry just left is one of the others of its group, whether the group was measured or not
            left = moved_away & ~at & (own >= members[0]) & (own <= members[-1])
            if left.any():
                kept = np.maximum(lower(rows[left], g), 0) * (1 - SLACK)
                bounds[rows[left], part, 1 + g] = _down(np.minimum(kept, low[left]))
                stamps[rows[left], part, 1 + g] = now
            bounds[rows[at], part, 1 + g] = low[at]
            stamps[rows[at], part, 1 + g] = now
    return codes, stamps, bounds, measured


def distances(vectors: np.ndarray, codes: np.ndarray, book: np.ndarray) -> list[int]:
    """Exact squared distances to the entries of `codes`, summed over parts."""
    width, total = vectors.shape[1] // PARTS, [0] * len(vectors)
    for part in range(PARTS):
        found = _squares(vectors[:, part * width : (part + 1) * width], book[part][codes[:, part]])
        total = [a + b for a, b in zip(total, found.tolist())]
    return total


def _state(batch: pa.RecordBatch, length: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes] | None]:
    """(vectors, codes, stamps, bounds, packed vectors) of a batch of fresh vectors or of a round's table."""
    rows, wide = batch.num_rows, 1 + len(_groups(entries))
    if "embedding" in batch.schema.names:
        vectors = _integers(batch.column("embedding").to_pylist(), length)
        return vectors, np.zeros((rows, PARTS), np.uint8), np.full((rows, PARTS, wide), NEW, np.uint8), np.zeros((rows, PARTS, wide), np.float32), [_packed(v) for v in vectors]
    packed = batch.column("vec").to_pylist()
    read = lambda name, kind, *shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(rows, *shape)
    return _unpacked(packed, length), read("codes", np.uint8, PARTS), read("stamps", np.uint8, PARTS, wide), read("bounds", "<f4", PARTS, wide), packed


def _limbs(number: int) -> Iterator[tuple[int, int]]:
    """(limb, digits) of a number, so that sums of any size fit columns; none of 0."""
    sign, number, limb = (-1 if number < 0 else 1), abs(number), 0
    while number:
        number, digits = divmod(number, LIMB)
        if digits:
            yield limb, sign * digits
        limb += 1


def _round(history: tuple[np.ndarray, ...], length: int):
    """Assign all parts to the last codebooks; the table of the round, and at the end of a task what its sums gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = history[-1].shape[1]
        width = length // PARTS
        gained = np.zeros((PARTS, entries, width + 1), object)  # the last position counts

        def book(vectors: np.ndarray, codes: np.ndarray, sign: int) -> None:
            for part in range(PARTS):
                mine = vectors[:, part * width : (part + 1) * width]
                for entry in np.unique(codes[:, part]).tolist():
                    rows = codes[:, part] == entry
                    gained[part, entry, :width] += sign * mine[rows].sum(axis=0).astype(object)
                    gained[part, entry, width] += sign * int(rows.sum())

        names = ["vec_id", "label", "vec", "codes", "stamps", "bounds", "part", "entry", "pos", "limb", "change"]
        label = None
        for batch in batches:
            label = batch.column("label").type
            if not batch.num_rows:
                continue
            vectors, codes, stamps, bounds, packed = _state(batch, length, entries)
            fresh = stamps[:, :, 0] == NEW
            after, stamps, bounds, _ = reassign(vectors, codes, stamps, bounds, history)
            changed = fresh.any(axis=1) | (codes != after).any(axis=1)
            book(vectors[changed], after[changed], 1)
            old = changed & ~fresh.any(axis=1)
            book(vectors[old], codes[old], -1)
            blobs = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            empty = [pa.nulls(batch.num_rows, t) for t in (*[pa.int32()] * 4, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary()), blobs(after), blobs(stamps), blobs(bounds.astype("<f4")), *empty], names)
        spots = [(*s, *limb) for s in np.ndindex(gained.shape) for limb in _limbs(gained[s])]
        if spots:
            empty = [pa.nulls(len(spots), t) for t in (pa.int64(), label, pa.binary(), pa.binary(), pa.binary(), pa.binary())]
            sums = [pa.array([s[i] for s in spots], pa.int32()) for i in range(4)] + [pa.array([Decimal(s[4]) for s in spots], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([*empty, *sums], names)

    return run


def _finish(history: tuple[np.ndarray, ...], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, codes, stamps, bounds, _ = _state(batch, length, history[-1].shape[1])
            codes = reassign(vectors, codes, stamps, bounds, history)[0]
            errors = [min(e, LONG_MAX) for e in distances(vectors, codes, history[-1])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def train(rows: DataFrame, folder: str, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks, int]:
    """(table of the last round, codebooks of all rounds, padded length) of the rows of `usable`; the tables lie in `folder`."""
    spark = rows.sparkSession
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    length = PARTS * max(1, -(-longest // PARTS))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    book = _integers([r["embedding"] for r in first], length).astype(object).reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)
    history = [book]
    if not len(first):
        return rows, Codebooks(tuple(history)), length
    shape = _STATE.format(label=rows.schema["label"].dataType.simpleString())
    totals, table = np.zeros((PARTS, len(first), length // PARTS + 1), object), rows
    for number in range(rounds):
        path = f"{folder}/round-{number}"
        table.mapInArrow(_round(tuple(history), length), shape).write.parquet(path)
        if number:
            drop_folder(spark, f"{folder}/round-{number - 1}")
        done = spark.read.parquet(path)
        for r in done.where("part is not null").groupBy("part", "entry", "pos", "limb").agg(F.sum("change").alias("change")).collect():  # the size of a codebook
            totals[r["part"], r["entry"], r["pos"]] += int(r["change"]) * LIMB ** r["limb"]
        book = history[-1].copy()
        for part, entry in np.ndindex(*totals.shape[:2]):
            if count := totals[part, entry, -1]:
                book[part, entry] = [total // count for total in totals[part, entry, :-1]]
        history.append(book)
        table = done.where("part is null").select("vec_id", "label", "vec", "codes", "stamps", "bounds")
    return table, Codebooks(tuple(history)), length


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    Each row is a vector of its own, also where ids or whole rows repeat. The first codebooks come from
    the `entries` smallest ids, equal ids by their vectors, NULL ids last; fewer vectors make fewer
    entries. Vectors that are shorter than the longest, or whose length PARTS does not divide, end in zeros, so
    that every one keeps its code. Errors beyond a long are given as its largest value. Other columns of
    `vectors` play no part.
    """
    spark = vectors.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    rows = usable(vectors, id_col, vector_col, label_col)
    table, books, length = train(rows, folder, rounds, entries)
    kind = rows.schema["label"].dataType.simpleString()
    path = f"{folder}/codes"
    table.mapInArrow(_finish(books.history, length), f"vec_id long, label {kind}, code string, error long").write.parquet(path)
    drop_folder(spark, f"{folder}/round-{rounds - 1}")
    coded = spark.read.parquet(path)
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = frozen(sums.select(F.col("label").alias("of"), F.least("total", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
