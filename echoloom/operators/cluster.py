"""Embeddings, density clustering, k-means, cluster records and nearest vectors.

Density clustering needs all pairs within a radius, but never lists them. Vectors are dealt to a tree
of cells: a cell of more than BLOCK_ROWS vectors is split around FANOUT of them, and its parts again. Two
leaves meet only if on every level above them the triangle inequality lets their cells come
close enough. A leaf no wider than the radius needs no comparison inside: all its vectors are neighbours,
so counts and links follow from its size. Leaves are cut into blocks, and two
blocks are compared with one matrix product. Blocks are dealt to groups, and a tile takes all block pairs of two groups,
so a vector travels once for each group that holds a partner of its block. A tile returns neighbour counts and a spanning forest of its
neighbour graph, so its output is linear in its rows whatever the number of close pairs;
the union of the forests has the same connected parts as the whole graph. Equal vectors
are merged before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom.functions import vectors as V
from echoloom.functions.text import text_or_empty
from echoloom.session import ensure_checkpoint_dir

NOISE = -1
BLOCK_ROWS = 2048
#: Parts of a cell that is split, and levels of splitting at most; what is still too large then is compared block by block.
FANOUT = 16
DEPTH = 24
#: Groups that the blocks are dealt to, and full blocks of a group; only more vectors than these hold make more groups.
GROUPS = 16
GROUP_BLOCKS = 64
#: Links that one task joins at once.
LINKS_PER_TASK = 200_000
#: Starts of k-means that are fitted at a time.
TRIES_AT_ONCE = 4


# --- embeddings ------------------------------------------------------------------------
def clusterable(docs: DataFrame) -> DataFrame:
    """Classified, completed and not yet in a cluster."""
    return docs.where(F.col("feedback_type").isNotNull() & (F.col("processing_status") == "completed") & F.col("cluster_id").isNull())


def embedding_text(docs: DataFrame) -> DataFrame:
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    labelled = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), c))
    text = F.concat_ws(" ", some("title"), some("body"), labelled("Component", "component"), labelled("Type", "feedback_type"))
    return docs.select("id", text.alias("text"))


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], size: int) -> DataFrame:
    """Unit vectors from a user-supplied model, one Arrow batch at a time; blank text gives zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blank = batch["text"].fillna("").str.strip() == ""
            out = np.zeros((len(batch), size))
            if (~blank).any():
                found = np.asarray(model(batch.loc[~blank, "text"].tolist()), dtype=float)
                norms = np.linalg.norm(found, axis=1, keepdims=True)
                out[~blank.to_numpy()] = np.divide(found, norms, out=np.zeros_like(found), where=norms > 0)
            yield pd.DataFrame({"id": batch["id"], "embedding": list(out)})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, embedding array<double>")


def cache_key(text) -> "F.Column":
    return F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per text that the (text_hash, embedding) cache does not hold."""
    keyed = texts.select(cache_key(F.col("text")).alias("text_hash"), "text")
    distinct = keyed.groupBy("text_hash").agg(F.min("text").alias("text"))
    return distinct.join(cache.select("text_hash"), "text_hash", "left_anti")


def cached_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    keyed = texts.select("id", cache_key(F.col("text")).alias("text_hash"))
    return keyed.join(cache, "text_hash").select("id", "embedding")


# --- radius graph ----------------------------------------------------------------------
def _split(rows: DataFrame, wide: DataFrame, depth: int) -> DataFrame:
    """(id, v, n, cell, far, center) of the rows of the cells of `wide` (cell, rows), dealt to parts of them.

    The vectors of a cell with the least hashes are its pivots: FANOUT of them, or fewer where that many parts would be
    small, since pairs of leaves grow with the square of their number. They go to each of the tasks that share the
    cell's rows; a row goes to the part of its nearest pivot.
    """
    kind = rows.schema["id"].dataType.simpleString()
    parts = F.least(F.lit(FANOUT), F.ceil(2 * F.col("rows") / BLOCK_ROWS)).cast("int")
    shared = wide.select("cell", F.ceil(F.col("rows") / (4 * BLOCK_ROWS)).cast("int").alias("tasks"), parts.alias("parts"))
    mine = rows.join(shared, "cell")  # few cells, large ones are split by adaptive execution
    least = W.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(depth)), "id")
    pivots = mine.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= F.col("parts"))
    pivots = pivots.select("id", "v", "n", "cell", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    dealt = mine.select("id", "v", "n", "cell", F.lit(1).alias("kind"), F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int").alias("task"))
    both = pivots.unionByName(dealt).repartition("cell", "task").sortWithinPartitions("cell", "task", "kind", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, fresh = None, [], False
        for batch in batches:
            keys = list(zip(batch["cell"], batch["task"], batch["kind"]))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                cell, task, what = keys[lo]
                part = batch.iloc[lo:hi]
                if what == 0:
                    if here != (cell, task) or not fresh:
                        here, held, fresh = (cell, task), [], True
                    held += part["v"].tolist()
                    continue
                fresh = False
                pivot = np.array(held)
                m = np.array(part["v"].tolist())
                apart = np.maximum(0.0, 2 - 2 * m @ pivot.T)  # squared chords of unit vectors
                to = apart.argmin(axis=1)
                far = np.sqrt(apart[np.arange(len(m)), to])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "n": part["n"].to_numpy(), "cell": [f"{cell}.{t}" for t in to], "far": far, "center": [held[t] for t in to]})

    return both.mapInPandas(run, f"id {kind}, v array<double>, n bigint, cell string, far double, center array<double>")


def _cells(vectors: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """(placed, nodes): vectors (id, v, n) with their leaf, and all cells (cell, parent, depth, rows, total, far, center, leaf).

    A leaf has BLOCK_ROWS vectors at most, or no two of its vectors are farther apart than the radius.
    """
    pivot = vectors.select(F.col("v").alias("center")).limit(1)
    rows = vectors.withColumn("cell", F.lit("0"))
    first = pivot.collect()  # one row
    if not first:
        shape = "cell string, parent string, depth int, rows bigint, total bigint, far double, center array<double>, leaf boolean"
        return rows, vectors.sparkSession.createDataFrame([], shape)
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in first[0]["center"]]))))
    current = rows.withColumn("far", far).withColumn("center", F.array(*[F.lit(float(x)) for x in first[0]["center"]])).checkpoint()
    placed = nodes = None
    for depth in range(DEPTH + 1):
        found = current.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.max("far").alias("far"), F.first("center").alias("center"))
        small = (F.col("rows") <= BLOCK_ROWS) | (2 * F.col("far") <= radius) | F.lit(depth == DEPTH)
        parent = F.substring_index("cell", ".", depth) if depth else F.lit("")
        found = found.select("cell", parent.alias("parent"), F.lit(depth).alias("depth"), "rows", "total", "far", "center", small.alias("leaf")).checkpoint()
        nodes = found if nodes is None else nodes.unionByName(found)
        wide = found.where("NOT leaf").select("cell", "rows")
        done = current.select("id", "v", "n", "cell") if wide.isEmpty() else current.join(wide, "cell", "left_anti").select("id", "v", "n", "cell")
        placed = done if placed is None else placed.unionByName(done)
        if wide.isEmpty():
            break
        current = _split(current.select("id", "v", "n", "cell"), wide, depth).checkpoint()
    return placed, nodes


def _near_leaves(nodes: DataFrame, radius: float) -> DataFrame:
    """(left, right) of leaves that can hold close vectors, each pair once; both may be one leaf."""
    side = lambda s: nodes.select(*[F.col(c).alias(f"{c}{s}") for c in ("cell", "parent", "far", "center", "leaf", "depth")])
    a, b = side("1"), side("2")
    open_ = nodes.where("depth = 0").select(*[F.col(c).alias(f"{c}{s}") for s in "12" for c in ("cell", "leaf")])
    apart = V.euclidean(F.col("center1"), F.col("center2"))
    found = None
    for _ in range(DEPTH + 1):
        ends = open_.where("leaf1 AND leaf2").select(F.col("cell1").alias("left"), F.col("cell2").alias("right"))
        found = ends if found is None else found.unionByName(ends)
        rest = open_.where("NOT (leaf1 AND leaf2)")
        if rest.isEmpty():
            break
        # a leaf stays, any other cell makes way for its parts
        up = rest.select(F.struct("cell1", "leaf1").alias("x"), F.struct("cell2", "leaf2").alias("y"))
        key = lambda s, t: F.struct(F.col(f"{t}.leaf{s}").alias("leaf"), F.col(f"{t}.cell{s}").alias("cell"))
        keyed = lambda side_, s: side_.select("*", F.explode(F.array(F.struct(F.lit(False).alias("leaf"), F.col(f"parent{s}").alias("cell")), F.struct(F.lit(True).alias("leaf"), F.col(f"cell{s}").alias("cell")))).alias(f"key{s}"))
        met = up.withColumn("key1", key("1", "x")).withColumn("key2", key("2", "y")).join(keyed(a, "1"), "key1").join(keyed(b, "2"), "key2")
        swapped = F.col("cell1") > F.col("cell2")
        same = F.col("x.cell1") == F.col("y.cell2")  # the parts of one cell meet in both orders
        ok = (apart - F.col("far1") - F.col("far2") <= radius + 1e-9) & ~(same & swapped)
        open_ = met.where(ok).select("cell1", "leaf1", "cell2", "leaf2").checkpoint()
    return found


def _blocks(vectors: DataFrame, radius: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, pairs, narrow): vectors with cell and block, block pairs to compare with their tile, and leaves no wider than the radius."""
    placed, nodes = _cells(vectors, radius)
    # rounding of the distances must not decide
    leaves = nodes.where("leaf").select("cell", "rows", "total", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("parts"), (2 * F.col("far") <= radius - 1e-6).alias("narrow"))
    block = F.concat_ws("_", F.col("cell"), F.pmod(F.xxhash64("id"), F.col("parts")))
    placed = placed.join(leaves, "cell").select("id", "v", "n", "cell", block.alias("block"))
    ends = lambda s, name: leaves.select(F.col("cell").alias(name), F.col("parts").alias(f"parts{s}"), F.col("narrow").alias(f"narrow{s}"))
    near = _near_leaves(nodes, radius).join(ends("1", "left"), "left").join(ends("2", "right"), "right")
    same = F.col("left") == F.col("right")
    near = near.where(~(same & F.col("narrow1"))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts1") - 1)))
    near = near.withColumn("y", F.explode(F.sequence(F.when(same, F.col("x")).otherwise(0), F.col("parts2") - 1)))
    pairs = near.select(F.concat_ws("_", "left", "x").alias("left"), F.concat_ws("_", "right", "y").alias("right"))
    rows = leaves.agg(F.sum("rows")).first()[0] or 0
    groups = F.lit(max(GROUPS, -(-rows // (GROUP_BLOCKS * BLOCK_ROWS))))
    one, two = F.pmod(F.xxhash64("left"), groups), F.pmod(F.xxhash64("right"), groups)
    pairs = pairs.withColumn("tile", F.concat_ws("|", F.least(one, two), F.greatest(one, two))).checkpoint()  # read four times
    return placed, pairs, leaves.where("narrow").select("cell", "total")


def _tiles(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each vector once per tile that its block takes part in."""
    ends = pairs.select("tile", F.explode(F.array("left", "right")).alias("block")).distinct()
    return placed.join(ends, "block")


class _Parts:
    """Connected parts of a tile's rows."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def of(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            up = self.parent[found]
            if (up == found).all():
                self.parent[rows] = found
                return found
            found = up

    def link(self, close: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Links of `close` (rows `left` by rows `right`) that join different parts."""
        a, b = self.of(left), self.of(right)
        out = []
        for i, row in enumerate(close if len(right) else []):
            while True:
                fresh = row & (b != a[i])
                at = int(fresh.argmax())
                if not fresh[at]:
                    break
                old, new = b[at], a[i]
                self.parent[old] = new
                a[a == old] = new
                b[b == old] = new
                out.append((left[i], right[at]))
        return out


def _neighbour_table(placed: DataFrame, pairs: DataFrame, eps: float, id_kind: str, core: bool) -> DataFrame:
    """Per tile: close counts (core=False), or forest edges among core and their borders (core=True)."""

    def run(rows: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"a": [], "b": [], "both": []} if core else {"id": [], "near": []})
        ids, m = rows["id"].to_numpy(), np.array(rows["v"].tolist())
        mine = {block: np.asarray(at) for block, at in rows.groupby("block").indices.items()}
        # pairs inside one block first: they join most rows
        wanted = sorted(zip(todo["left"], todo["right"]), key=lambda p: p[0] != p[1])

        def close(left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
            near = 1 - m[left] @ m[right].T <= eps + 1e-12
            if same:
                np.fill_diagonal(near, False)
            return near

        if not core:
            weights, near = rows["n"].to_numpy().astype(float), np.zeros(len(rows))
            for x, y in wanted:
                left, right = mine[x], mine[y]
                met = close(left, right, x == y).astype(float)
                near[left] += met @ weights[right]
                if x != y:
                    near[right] += weights[left] @ met
            return pd.DataFrame({"id": ids, "near": near.astype(np.int64)})
        flags, parts, edges, heads = rows["core"].to_numpy(dtype=bool), _Parts(len(rows)), [], {}
        for x, y in wanted:
            left, right = mine[x], mine[y]
            ends = np.concatenate([left, right])
            # rows that are all core and joined already have nothing to add
            if flags[ends].all() and len(np.unique(parts.of(ends))) == 1:
                continue
            met = close(left, right, x == y)
            cl, cr = flags[left], flags[right]
            edges += parts.link(met[np.ix_(cl, cr)], left[cl], right[cr])
            # a border row needs its least core neighbour only
            for one, two, table in [(left, right, met), (right, left, met.T)][: 1 if x == y else 2]:
                for i in np.flatnonzero(~flags[one]):
                    cores = two[table[i] & flags[two]]
                    if len(cores):
                        best = min(ids[cores])
                        heads[one[i]] = min(best, heads.get(one[i], best))
        found = [(ids[a], ids[b], True) for a, b in edges] + [(ids[a], head, False) for a, head in heads.items()]
        return pd.DataFrame(found, columns=["a", "b", "both"])

    schema = f"id {id_kind}, near bigint" if not core else f"a {id_kind}, b {id_kind}, both boolean"
    # a tile holds the vectors of about 2 * GROUP_BLOCKS full blocks at most
    todo = pairs.select(F.col("tile").alias("place"), F.col("left"), F.col("right"))
    return _tiles(placed, pairs).groupBy("tile").cogroup(todo.groupBy("place")).applyInPandas(run, schema)


def _counts(placed: DataFrame, pairs: DataFrame, narrow: DataFrame, eps: float, kind: str) -> DataFrame:
    """(id, near): how many other vectors are close, `n` of each row counted."""
    inside = placed.join(narrow, "cell").select("id", (F.col("total") - F.col("n")).alias("near"))
    counts = _neighbour_table(placed, pairs, eps, kind, core=False).unionByName(inside)
    return counts.groupBy("id").agg(F.sum("near").alias("near"))


def neighbour_counts(vectors: DataFrame, eps: float) -> DataFrame:
    """(id, neighbours): other vectors within the cosine distance `eps`; zero vectors have none."""
    ensure_checkpoint_dir(vectors.sparkSession)
    unit = vectors.select("id", V.normalize(F.col("embedding")).alias("v"), F.lit(1).cast("bigint").alias("n"))
    placed, pairs, narrow = _blocks(unit.where(V.norm(F.col("v")) > 0), math.sqrt(2 * eps))
    kind = vectors.schema["id"].dataType.simpleString()
    counts = _counts(placed, pairs, narrow, eps, kind).withColumnRenamed("near", "neighbours")
    return vectors.select("id").join(counts, "id", "left").na.fill(0, ["neighbours"])


def similarity_rows(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) for the wanted cells of the similarity matrix, given as (a, b) ids."""
    left = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    right = vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("similarity"))


def similarity_totals(vectors: DataFrame) -> DataFrame:
    """(grp, total, pairs): sum over each group's whole similarity matrix, without its cells.

    Σᵢⱼ cos(i, j) is the squared length of the sum of the unit vectors.
    """
    unit = vectors.select("grp", F.posexplode(V.normalize(F.col("embedding"))).alias("pos", "x"))
    sums = unit.groupBy("grp", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy("grp").agg(F.sum(F.col("x") * F.col("x")).alias("total"), F.max(F.col("n") * F.col("n")).alias("pairs"))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one task as (end, least end reachable by them)."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ends = list(parent)
    yield pd.DataFrame({"a": ends, "b": [root(x) for x in ends]})


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): least id of the connected part.

    Each task first turns its links, LINKS_PER_TASK or so, into stars. If they take several tasks, the stars are joined by
    large-star and small-star rounds, whose number grows with the logarithm of the longest path; every round is frozen by a
    reliable checkpoint.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    kind = nodes.schema["id"].dataType.simpleString()
    links = edges.select("a", "b").checkpoint()
    tasks = max(1, -(-links.count() // LINKS_PER_TASK))
    stars = links.coalesce(tasks).mapInPandas(_stars, f"a {kind}, b {kind}").checkpoint()
    roots = stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if tasks > 1:
        roots = _joined_stars(stars)
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _joined_stars(stars: DataFrame) -> DataFrame:
    current = stars.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    previous = None
    while True:
        # large star: larger neighbours of a node move to its least neighbour
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of a node, and the node, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = small.checkpoint()
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == previous:
            return current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        previous = mark


def dbscan(vectors: DataFrame, eps: float = 0.3, min_samples: int = 2) -> DataFrame:
    """(id, label): cosine density clusters named by their least core id, −1 for noise ("-1" if ids are strings).

    A row counts itself. A border row joins its least core neighbour's cluster. Zero vectors
    are noise, as no cosine is defined for them.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    unit = vectors.select("id", V.normalize(F.col("embedding")).alias("v"))
    unit = unit.withColumn("zero", V.norm(F.col("v")) == 0).withColumn("key", F.xxhash64(F.to_json(F.struct("v")))).checkpoint()
    solid = unit.where("NOT zero")
    merged = solid.groupBy("key", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    members = solid.select("id", "key", "v").join(merged.select("key", "v", F.col("id").alias("lead"), "n"), ["key", "v"])
    placed, pairs, narrow = _blocks(merged.select("id", "v", "n"), math.sqrt(2 * eps))
    kind = vectors.schema["id"].dataType.simpleString()
    counts = _counts(placed, pairs, narrow, eps, kind)
    flagged = placed.join(counts, "id", "left").withColumn("core", F.coalesce("near", F.lit(0)) + F.col("n") >= min_samples).drop("near").checkpoint()
    tiles = _neighbour_table(flagged, pairs, eps, kind, core=True)
    # in a narrow leaf every vector is a neighbour of the least core one
    inside = flagged.join(narrow, "cell")
    heads = inside.where("core").groupBy("cell").agg(F.min("id").alias("head"))
    linked = inside.join(heads, "cell").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"), F.col("core").alias("both"))
    found = tiles.unionByName(linked).checkpoint()
    cores = flagged.where("core").select("id")
    parts = components(found.where("both").select("a", "b"), cores)
    border = found.where("NOT both").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("core_id"))
    border = border.join(parts.select(F.col("id").alias("core_id"), "component"), "core_id").select("id", "component")
    labels = parts.unionByName(border).select(F.col("id").alias("lead"), F.col("component").alias("label"))
    out = members.select("id", "lead").join(labels, "lead", "left").select("id", F.coalesce("label", F.lit(NOISE).cast(kind)).alias("label"))
    return out.unionByName(unit.where("zero").select("id", F.lit(NOISE).cast(kind).alias("label")))


def kmeans(vectors: DataFrame, k: int = 5, seed: int = 42, tries: int = 10, max_iter: int = 300) -> DataFrame:
    """(id, label): the best of `tries` starts by cost.

    The rows are frozen, not persisted: each fit then holds them decoded, and a round does not read them again. A round
    is a short job, so TRIES_AT_ONCE fits run at a time.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    data = vectors.select("id", array_to_vector("embedding").alias("features")).checkpoint()
    fit = lambda i: KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(data)
    with ThreadPoolExecutor(TRIES_AT_ONCE) as pool:
        models = list(pool.map(fit, range(tries)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("id", F.col("prediction").alias("label"))


# --- cluster tables --------------------------------------------------------------------
def clustered() -> Column:
    """True for rows with a cluster, whatever the type of their ids."""
    return F.col("label").cast("string") != str(NOISE)


def centroids(labelled: DataFrame) -> DataFrame:
    """(label, centroid, members) from (label, embedding); noise is left out.

    Averaged per coordinate, so partial sums combine on the map side.
    """
    rows = labelled.where(clustered()).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("members"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.max("members").alias("members"))
    return packed.select("label", F.transform("c", lambda c: c["x"]).alias("centroid"), "members")


def build_clusters(docs: DataFrame, labelled: DataFrame, min_size: int = 2, similarity: float = 0.3) -> DataFrame:
    """Cluster rows: title, summary, centroid, size, and the first member's type and part."""
    rows = labelled.where(clustered()).join(docs.select("id", "feedback_type", "component", "severity_score"), "id")
    facts = rows.groupBy("label").agg(
        F.min_by(F.struct("id", "feedback_type", "component", "severity_score"), "id").alias("r"),
        F.avg("severity_score").alias("avg_severity"),
    )
    out = centroids(labelled).where(F.col("members") >= min_size).join(facts, "label")
    return out.select(
        F.col("label").alias("id"),
        F.concat(F.lit("Cluster "), F.col("label").cast("string")).alias("title"),
        F.concat(F.lit("Cluster of "), F.col("members").cast("string"), F.lit(" similar feedback items")).alias("summary"),
        F.col("centroid").alias("centroid_embedding"),
        F.col("members").alias("member_count"),
        "r.feedback_type",
        "r.component",
        "avg_severity",
        F.col("r.severity_score").alias("representative_severity"),
        F.col("r.id").alias("representative_document_id"),
        F.lit(similarity).alias("similarity_threshold"),
    )


def build_memberships(clusters: DataFrame, labelled: DataFrame) -> DataFrame:
    facts = clusters.select(F.col("id").alias("label"), "centroid_embedding", "representative_document_id")
    rows = labelled.join(facts, "label")
    return rows.select(
        F.col("label").alias("cluster_id"),
        F.col("id").alias("document_id"),
        V.cosine(F.col("embedding"), F.col("centroid_embedding")).alias("similarity_score"),
        (F.col("id") == F.col("representative_document_id")).alias("is_representative"),
    )


def assign_clusters(docs: DataFrame, memberships: DataFrame) -> DataFrame:
    mine = memberships.select(F.col("document_id").alias("id"), F.col("cluster_id").alias("__cluster"))
    return docs.join(mine, "id", "left").withColumn("cluster_id", F.coalesce("__cluster", "cluster_id")).drop("__cluster")


def clustering_stats(clusters: DataFrame, memberships: DataFrame, docs: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    counts = one(clusters, "total_clusters").join(one(memberships, "total_memberships"), "one")
    counts = counts.join(one(docs.where(F.col("feedback_type").isNotNull()), "classified"), "one").drop("one")
    clustered = F.col("total_memberships")
    return counts.select(
        "total_clusters", "total_memberships",
        (clustered / F.greatest("total_clusters", F.lit(1))).alias("average_cluster_size"),
        clustered.alias("clustered_documents"),
        (F.col("classified") - clustered).alias("unclustered_documents"),
        (clustered / F.greatest("classified", F.lit(1))).alias("clustering_rate"),
    )


# --- nearest vectors -------------------------------------------------------------------
def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 10_000) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar vectors of each query, exact.

    Queries are sent to the tasks in blocks of about `block`, chosen by a hash of their id. For each
    block the vector table is read once and never shuffled: every task keeps its own k best
    per query, and one merge over all blocks follows.
    """
    blocks = max(1, -(-queries.count() // block))
    mine = [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) for b in range(blocks)]
    best = reduce(DataFrame.unionByName, [_best_in_tasks(part, vectors, k) for part in mine])
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k)


def _best_in_tasks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity) of one block of queries: the k best of each task."""
    found = queries.select("id", "embedding").collect()
    ids = [r["id"] for r in found]
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    q = unit(np.array([r["embedding"] for r in found], dtype=float)) if found else np.zeros((0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0 or len(ids) == 0:
                continue
            scores = q @ unit(np.array(batch["embedding"].tolist(), dtype=float)).T
            take = min(k, len(batch))
            keys = batch["id"].to_numpy()
            order = np.lexsort((np.broadcast_to(keys, scores.shape), -np.round(scores, 12)), axis=1)[:, :take]
            yield pd.DataFrame({
                "query_id": np.repeat(np.array(ids), take), "id": keys[order].ravel(),
                "similarity": np.take_along_axis(scores, order, axis=1).ravel(),
            })

    qk, vk = queries.schema["id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInPandas(run, f"query_id {qk}, id {vk}, similarity double")


def cell_index(vectors: DataFrame, lists: int = 100, seed: int = 42, max_iter: int = 20):
    """Inverted cells for approximate search: k-means cells and each vector's cell."""
    data = vectors.select("id", "embedding", array_to_vector(V.normalize(F.col("embedding"))).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=max_iter).fit(data)
    return model, model.transform(data).select("id", "embedding", F.col("prediction").alias("cell"))


def nearest_in_cells(queries: DataFrame, model, cells: DataFrame, k: int = 5, probes: int = 10) -> DataFrame:
    """Approximate twin of `nearest`: only the `probes` cells closest to a query are searched."""
    centers = queries.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, center array<double>"
    )
    every = F.broadcast(centers.agg(F.collect_list(F.struct("cell", "center")).alias("centers")))  # `lists` entries
    unit = queries.select(F.col("id").alias("query_id"), V.normalize(F.col("embedding")).alias("q"), F.lit(1).alias("one"))
    ranked = unit.join(every.withColumn("one", F.lit(1)), "one").select(
        "query_id", "q",
        F.slice(F.array_sort(F.transform("centers", lambda c: F.struct(V.euclidean(F.col("q"), c["center"]).alias("d"), c["cell"].alias("cell")))), 1, probes).alias("best"),
    )
    visits = ranked.select("query_id", "q", F.explode("best").alias("b")).select("query_id", "q", "b.cell")
    scored = cells.join(visits, "cell").select("query_id", "id", V.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)
