"""N-gram Jaccard join by signature trees.

Every text becomes the set of its distinct five-word shingles (64-bit hashes). Texts with equal
sets form a class and are compared once. The join looks for classes with
100 * |intersection| >= 80 * |union|:

* Roots. A class hangs under one root per token of its prefix: its smallest hashes, as many as a
  pair of that size could miss plus one, but not over PREFIX. Hashes order the union at random, so a
  linked pair has no common token among the first PREFIX with a chance under 0.2 ** 32 (4e-23),
  far below that of a hash collision. Roots with the same members are searched once.
* Trees. Below a root, classes are cut into size bands (sizes in a band differ by a quarter at
  most) and, in large bands, into leaves of LEAF classes. Inner nodes hold the OR of their token
  bitmaps and the range of their sizes. The traversal takes pairs of nodes, drops those whose
  largest possible overlap is too small, and goes on below the others down to pairs of classes.
* Checks. Pairs that survive are compared exactly on their whole texts. A leaf first sends a
  spanning forest of its candidates, the likeliest first; where a leaf had more candidates than
  that, a second traversal sends all those whose ends are still in different components. So a
  large group of near copies costs a few pairs per member, and no link between components is lost.
  A pair that hangs under several roots is sent by the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import frozen, spare, tidy
from echoloom.operators.cluster import components

WORDS = 5
PERCENT = 80
PREFIX = 32
LEAF = 4096
NODE = 16
HELD = 500_000
MEMO = 100_000
LINKS_PER_TASK = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Hashes(dict):
    """Word -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, memo: dict, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words than `width` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([memo[w] for w in words], dtype=np.uint64)
    if len(hashes) < width:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], dtype=np.uint64)
    count = len(hashes) - width + 1
    total = np.zeros(count, np.uint64)
    for i in range(width):
        total = _mix(total + hashes[i : i + count] * _MULTIPLIERS[i % 5] + np.uint64(i + 1))
    return np.unique(total)


def _band(size: int) -> int:
    return int(np.floor(np.log(size) / np.log(1.25) + 1e-9))


def _width(band: int) -> int:
    """Bits of the bitmaps of a band: at least four per shingle, a power of two, 128 to 16384."""
    return int(min(16384, max(128, 1 << int(np.ceil(np.log2(4 * 1.25 ** (band + 1)))))))


def _bitmap(tokens: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(width)] = 1
    return np.packbits(bits).tobytes()


def _sketch(width: int, percent: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            sizes, keys, firsts, bands, sigs = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingles(text, memo, width)
                n = len(tokens)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if n else None)
                need = -(-percent * n // 100)
                firsts.append(tokens[: min(prefix, n - need + 1)].view(np.int64) if n else [])
                bands.append(_band(n) if n else None)
                sigs.append(_bitmap(tokens, _width(bands[-1])) if n else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(bands, pa.int32()), pa.array(sigs, pa.binary())],
                ["doc_id", "digest", "n", "key", "prefix", "band", "sig"],
            )

    return run


class _Leaf:
    """Classes of one band below a root: bitmaps, sizes, ids, and the nodes above them."""

    def __init__(self, rows: list[tuple[int, int, bytes, int]]):
        rows.sort(key=lambda r: (r[3], r[1], r[0]))  # classes of one component, then of like size, share nodes
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.groups = np.array([r[3] for r in rows], np.int64)
        self.bits = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        self.summarise()

    def summarise(self) -> None:
        self.words = np.ascontiguousarray(self.bits).view(np.uint64)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        starts = np.arange(0, len(self.ids), NODE)
        self.starts, self.ends = starts, np.minimum(starts + NODE, len(self.ids))
        self.either = np.bitwise_or.reduceat(self.words, starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, starts)
        self.most = np.maximum.reduceat(self.sizes, starts)
        self.hidden = np.maximum.reduceat(self.sizes - self.ones, starts)
        low, high = np.minimum.reduceat(self.groups, starts), np.maximum.reduceat(self.groups, starts)
        self.pure = np.where(low == high, low, -1)

    def folded(self, width: int) -> "_Leaf":
        """The same leaf with bitmaps of fewer bits: position mod width, so parts are OR-combined."""
        if self.bits.shape[1] == width:
            return self
        other = object.__new__(_Leaf)
        other.ids, other.sizes, other.groups = self.ids, self.sizes, self.groups
        other.bits = np.bitwise_or.reduce(self.bits.reshape(len(self.ids), -1, width), axis=1)
        other.summarise()
        return other


def traverse(left: _Leaf, right: _Leaf, same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids in left, ids in right, bounds on the similarity) of every pair that may be linked, node by node.

    Node pairs are dropped by size range and by the most tokens they can share: those on bits
    that both ORs hold, and those of a class that share a bit with another of its own. A part holds
    the pairs of one node of `left`, NODE * LEAF or so at most.
    """
    width = min(left.bits.shape[1], right.bits.shape[1])
    left, right = left.folded(width), left.folded(width) if same else right.folded(width)
    for i in range(len(left.starts)):
        first = i if same else 0
        shared = np.bitwise_count(left.either[i] & right.either[first:]).sum(axis=1, dtype=np.int64)
        most = np.minimum(shared + np.minimum(left.hidden[i], right.hidden[first:]), np.minimum(left.most[i], right.most[first:]))
        open_ = (100 + percent) * most >= percent * (left.least[i] + right.least[first:])
        open_ &= (100 * right.most[first:] >= percent * left.least[i]) & (100 * left.most[i] >= percent * right.least[first:])
        open_ &= (left.pure[i] < 0) | (left.pure[i] != right.pure[first:])
        nodes = np.nonzero(open_)[0] + first
        if not len(nodes):
            continue
        cols = np.concatenate([np.arange(right.starts[j], right.ends[j]) for j in nodes])
        out_a, out_b, out_s = [], [], []
        for a in range(left.starts[i], left.ends[i]):
            b = cols[cols > a] if same else cols
            both = np.bitwise_count(left.words[a] & right.words[b]).sum(axis=1, dtype=np.int64)
            most = np.minimum(left.sizes[a] - left.ones[a], right.sizes[b] - right.ones[b]) + both
            most = np.minimum(most, np.minimum(left.sizes[a], right.sizes[b]))
            total = left.sizes[a] + right.sizes[b]
            ok = ((100 + percent) * most >= percent * total) & (left.ids[a] != right.ids[b])
            ok &= (left.groups[a] < 0) | (left.groups[a] != right.groups[b])
            b = b[ok]
            if len(b):
                out_a.append(np.full(len(b), left.ids[a]))
                out_b.append(right.ids[b])
                out_s.append(most[ok] / total[ok])
        if out_a:
            yield np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_s)


def _likeliest(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], held: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """A spanning forest of all pairs, likeliest first, and whether there were more pairs than it has.

    A pair outside the forest of some pairs is outside the forest of all, so whenever `held` pairs
    have come together they are cut down to their forest.
    """
    kept, count, more = [], 0, False

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, score = (np.concatenate(c) for c in zip(*kept))
        chosen = _forest(a, b, score)
        return a[chosen], b[chosen], score[chosen]

    for part in parts:
        kept.append(part)
        count += len(part[0])
        if count > held:
            kept = [cut()]
            more |= len(kept[0][0]) < count
            count = len(kept[0][0])
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    a, b, _ = cut()
    return a, b, more or len(a) < count


def _forest(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> list[int]:
    """Positions of a spanning forest of the pairs, likeliest first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for k in np.argsort(-score, kind="stable").tolist():
        u, v = root(int(a[k])), root(int(b[k]))
        if u != v:
            parent[u] = v
            kept.append(k)
    return kept


def _searched(percent: int, full: bool):
    """Traverse each leaf pair of the (sorted) rows; rows of a leaf pair follow each other."""

    def pairs_of(key: tuple, sides: dict[int, list], under: dict[int, list[int]]) -> Iterator[tuple[int | None, int | None]]:
        """Pairs to check; at last (None, None) if the leaf pair had more candidates."""
        same = key[1] == key[2]
        if not sides.get(0) or (not same and not sides.get(1)):
            return
        left = _Leaf(sides[0])
        right = left if same else _Leaf(sides[1])
        parts, more = traverse(left, right, same, percent), False
        if not full:
            forest_a, forest_b, more = _likeliest(parts, HELD)
            parts = [(forest_a, forest_b)]
        sets = {}
        for part in parts:
            for a_id, b_id in zip(part[0].tolist(), part[1].tolist()):
                for one in (a_id, b_id):
                    if one not in sets:
                        sets[one] = {r for r in under[one] if r < key[0]}
                # a root that both hang under and that comes first sends, or has joined, the pair
                if sets[a_id].isdisjoint(sets[b_id]):
                    yield min(a_id, b_id), max(a_id, b_id)
        if more:
            yield None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, under, out = None, {}, {}, []

        def drained():
            rows = list(out)
            out.clear()
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["root", "leaf_a", "leaf_b", "a", "b"])

        def found():
            for pair in pairs_of(key, sides, under):
                out.append((*key, *pair))
                if len(out) >= 10_000:
                    yield drained()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("root", "leaf_a", "leaf_b", "side", "rid", "n", "sig", "grp", "roots")]
            for root, leaf_a, leaf_b, side, rid, n, sig, grp, roots in zip(*cols):
                here = (root, leaf_a, leaf_b)
                if here != key:
                    if key is not None:
                        yield from found()
                    key, sides, under = here, {}, {}
                sides.setdefault(side, []).append((rid, n, sig, grp))
                under[rid] = roots
        if key is not None:
            yield from found()
        yield drained()

    return run


def _leaf_pairs(members: DataFrame) -> DataFrame:
    """Rows (root, leaf_a, leaf_b, side, rid): each class once for every leaf pair it takes part in.

    A leaf is numbered band * 2**16 + slot. Bands of a root with up to LEAF classes are one leaf;
    larger ones are cut into slots of about LEAF by a hash. Pairs are within a band and with
    the next one.
    """
    bands = members.groupBy("root", "band").agg(F.count("*").alias("count"))
    bands = bands.withColumn("slots", F.ceil(F.col("count") / LEAF).cast("int")).select("root", "band", "count", "slots")
    above = bands.select("root", (F.col("band") - 1).alias("band"), F.col("slots").alias("above"))
    under = bands.select("root", (F.col("band") + 1).alias("band"), F.col("slots").alias("under"))
    shape = bands.join(above, ["root", "band"], "left").join(under, ["root", "band"], "left")
    rows = members.join(shape, ["root", "band"]).withColumn("slot", F.pmod(F.xxhash64("rid"), F.col("slots")).cast("int"))
    leaf = lambda band, slot: band * F.lit(1 << 16) + slot
    own = leaf(F.col("band"), F.col("slot"))
    entry = lambda a, b, side: F.struct(a.cast("int").alias("leaf_a"), b.cast("int").alias("leaf_b"), F.lit(side).alias("side"))
    within = F.transform(
        F.sequence(F.lit(0), F.col("slots") - 1),
        lambda s: F.when(s >= F.col("slot"), entry(own, leaf(F.col("band"), s), 0)).otherwise(entry(leaf(F.col("band"), s), own, 1)),
    )
    none = F.array().cast("array<struct<leaf_a:int,leaf_b:int,side:int>>")
    upward = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda s: entry(own, leaf(F.col("band") + 1, s), 0))).otherwise(none)
    downward = F.when(F.col("under").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("under") - 1), lambda s: entry(leaf(F.col("band") - 1, s), own, 1))).otherwise(none)
    within = F.when(F.col("count") > 1, within).otherwise(none)
    return rows.select("root", "rid", F.explode(F.concat(within, upward, downward)).alias("p")).select("root", "rid", "p.*")


def _search(leaf_pairs: DataFrame, classes: DataFrame, percent: int, full: bool) -> DataFrame:
    rows = leaf_pairs.join(classes.select("rid", "n", "sig", "grp", "roots"), "rid")
    placed = rows.repartition("root", "leaf_a", "leaf_b").sortWithinPartitions("root", "leaf_a", "leaf_b", "side", "rid")
    cols = ("root", "leaf_a", "leaf_b", "side", "rid", "n", "sig", "grp", "roots")
    return placed.select(*cols).mapInArrow(tidy(_searched(percent, full)), "root long, leaf_a int, leaf_b int, a long, b long")


def _exact(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        last, left = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]):
                if a != last:
                    last, left = a, shingles(ta, memo, width)
                right = shingles(tb, memo, width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of one task, LINKS_PER_TASK at most or so, by (id, least id reachable by them)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], ["id", "component"])


def linked(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of `links` (a, b; frozen): the least id reachable.

    Each task first turns its links into stars; if it takes several tasks, the stars are joined by
    rounds over the whole table.
    """
    tasks = -(-links.count() // LINKS_PER_TASK)
    stars = links.coalesce(max(1, tasks)).mapInArrow(_stars, "id long, component long")
    if tasks <= 1:
        return frozen(stars)
    edges = frozen(stars).select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(edges, edges.select(F.col("a").alias("id")).distinct())


def _keyed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            keep = [xxhash.xxh3_128_digest(shingles(t, memo, width).tobytes()) == k for t, k in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["rid", "text"])

    return run


def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own included. Texts that
    are NULL, empty or only white space have no shingles and are linked with nothing, not even
    with each other: their component is their own doc_id. Repeated rows give repeated results.
    NULL doc_ids take part in links; a component in which all ids are NULL has a NULL id. Other
    columns of `docs` play no part.
    """
    sketch_type = "doc_id long, digest long, n long, key binary, prefix array<long>, band int, sig binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    sketched = frozen(rows.mapInArrow(tidy(_sketch(width, percent, PREFIX)), sketch_type)).withColumn("rid", F.monotonically_increasing_id())
    full, rows_in = sketched.where("n > 0"), sketched.count()
    heads = frozen(full.groupBy("key").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_doc"), F.min_by(F.struct("doc_id", "digest"), "rid").alias("spot")), rows_in)
    classes = full.join(heads.select("rid"), "rid")

    # roots: prefix tokens of two classes or more, one for each set of members
    postings = classes.select("rid", "band", F.explode("prefix").alias("root")).repartition("root")
    marks = postings.groupBy("root").agg(
        F.count("*").alias("count"), F.bit_xor(F.xxhash64("rid")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("m2"),
    ).where("count > 1")
    roots = marks.groupBy("count", "m1", "m2").agg(F.min("root").alias("root")).select("root")
    members = frozen(postings.join(roots, "root").select("root", "rid", "band"), rows_in)
    leaf_pairs = frozen(_leaf_pairs(members), rows_in)

    under = members.groupBy("rid").agg(F.collect_list("root").alias("roots"))  # at most PREFIX
    hung = frozen(classes.select("rid", "n", "sig").join(under, "rid"), rows_in)
    alone = hung.withColumn("grp", F.lit(-1).cast("long"))
    first = frozen(_search(leaf_pairs, alone, percent, full=False), rows_in)
    tried = first.where("a is not null").select("a", "b").distinct()
    ends = tried.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    # whole texts of the classes that have a candidate, read once for both rounds; ids may be NULL or repeat, so a
    # class's text is found by its digest as well, and no row meets two classes
    wanted = ends.join(heads, "rid").select("rid", F.col("spot.doc_id").alias("__doc"), F.col("spot.digest").alias("__digest"), "key")
    theirs = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("digest") == F.col("__digest"))).select("rid", "key", "text")
    texts = frozen(theirs.mapInArrow(tidy(_keyed(width)), "rid long, text string").groupBy("rid").agg(F.first("text").alias("text")), rows_in)

    def checked(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
        both = with_a.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(tidy(_exact(width, percent)), "a long, b long")

    links = frozen(checked(tried), rows_in)
    grouped = linked(links)
    dense = first.where("a is null").select("root", "leaf_a", "leaf_b").distinct()
    if not dense.isEmpty():
        labelled = hung.join(grouped.withColumnRenamed("id", "rid"), "rid", "left").withColumn("grp", F.coalesce("component", "rid"))
        again = _search(leaf_pairs.join(dense, ["root", "leaf_a", "leaf_b"]), labelled, percent, full=True)
        rest = again.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        links = frozen(links.unionByName(checked(rest)), rows_in)
        grouped = linked(links)

    # the class of every row, the component of every class, the smallest doc_id of every component
    named = heads.join(grouped.withColumnRenamed("id", "rid"), "rid", "left").select("key", "first_doc", F.coalesce("component", "rid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_key = named.select("key", "root").join(smallest, "root").select("key", "component_id")
    out = sketched.select("doc_id", "n", "key").join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """`docs` with one row of each group: the one with the smallest doc_id; all columns stay.

    Rows without shingles and rows with a NULL id are kept. A doc_id names one document: its
    repeated rows go or stay together.
    """
    groups = near_duplicate_groups(docs, percent, width).where("n_shingles > 0 and component_id is not null and doc_id is not null")
    name = spare(docs, "gone_id")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
