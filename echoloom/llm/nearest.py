"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt to lists by their nearest centroid and rotated by one random orthogonal matrix,
so that the first dimensions tell a fair part of any distance. A query goes to its nearest lists; how
many, a sample of the queries tells, whose true neighbours are found by brute force. In
a list the vectors are scanned in blocks of columns: after each block a hypothesis test compares the
partial distance with the distance of the tenth neighbour so far, and candidates that are very
unlikely to beat it are abandoned. Survivors are measured exactly on the original vectors.

Lists are cut into blocks of about BLOCK vectors and their queries into blocks of about QUERIES, so no
task gets a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom.llm.common import frozen, sampled

LIST_SIZE = 400
MAX_LISTS = 1024
SAMPLE_ROWS = 32_768
PROBE_FACTOR = 4
#: Share of the true neighbours of MEASURED queries that must lie in the lists a query goes to.
RECALL = 0.95
MEASURED = 256
BLOCK = 4096
QUERIES = 2048
COLUMNS = 16
EPSILON = 2.1
#: Share of the squared lengths by which two rotations of one vector may differ.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of vectors that can be compared.

    NULL ids, NULL or empty or all-zero vectors and vectors with NULL or non-finite components take no
    part, nor do vectors whose length is not the most frequent one. An id that occurs more than
    once counts once, with its smallest vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    inf = F.lit(float("inf"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
    common = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select(F.col("size").alias("__size"))
    return rows.join(F.broadcast(common), F.col("size") == F.col("__size")).select("vec_id", "embedding")


def fit(vectors: DataFrame, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Index:
    """Centroids by k-means on at most about `sample_rows` vectors (chosen by a hash of their id), and the rotation."""
    count = vectors.count()
    if count == 0:
        return Index(np.zeros((0, 0)), np.zeros((0, 0)), 0)
    share = min(1.0, sample_rows / count)
    rows = vectors.where(sampled(F.col("vec_id"), share)).orderBy("vec_id").select("embedding").toPandas()["embedding"]
    if not len(rows):
        rows = vectors.orderBy("vec_id").limit(1).select("embedding").toPandas()["embedding"]
    data = np.stack(rows.to_numpy()).astype(float)
    rng = np.random.default_rng(seed)
    k = int(min(max(1, round(count / list_size)), max_lists, len(data)))
    centres = data[rng.choice(len(data), k, replace=False)]
    for _ in range(15):
        own = _closest(data, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        sizes = np.bincount(own, minlength=k)
        lost = sizes == 0
        centres = np.where(lost[:, None], data[rng.integers(len(data), size=k)], sums / np.maximum(sizes, 1)[:, None])
    rotation, _ = np.linalg.qr(rng.normal(size=(data.shape[1], data.shape[1])))
    return Index(centres, rotation, int(min(k, np.ceil(PROBE_FACTOR * np.sqrt(k)))))


def _closest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * data @ centres.T).argmin(axis=1)


def scan_block(queries: np.ndarray, own_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, distances) of each query's best candidates in one block, `k` at most."""
    turned, asked = vectors @ rotation, queries @ rotation
    size, weight = vectors.shape[1], (queries**2).sum(axis=1)
    for number in range(len(queries)):
        alive = np.nonzero(ids != own_ids[number])[0]
        if not len(alive):
            continue
        partial = np.zeros(len(alive))
        bound = np.inf
        if len(alive) > 4 * k:
            # the whole distance of the first few sets the bound
            first = alive[: 2 * k]
            bound = np.partition(((vectors[first] - queries[number]) ** 2).sum(axis=1), k - 1)[k - 1]
        for start in range(0, size, COLUMNS):
            done = min(start + COLUMNS, size)
            partial += ((turned[alive, start:done] - asked[number, start:done]) ** 2).sum(axis=1)
            if done < size:
                keep = partial <= bound * (done / size) * (1 + EPSILON / np.sqrt(done)) ** 2 + ROUNDING * (weight[number] + bound)
                alive, partial = alive[keep], partial[keep]
                if len(alive) > 2 * k and done < size // 2:
                    # survivors that look nearest tighten the bound
                    some = alive[np.argpartition(partial, k)[: 2 * k]]
                    bound = min(bound, np.partition(((vectors[some] - queries[number]) ** 2).sum(axis=1), k - 1)[k - 1])
        exact = np.sqrt(((vectors[alive] - queries[number]) ** 2).sum(axis=1))
        order = np.lexsort((ids[alive], exact))[:k]
        yield number, ids[alive][order], exact[order]


def probes_for(placed: DataFrame, is_query: Column, index: Index, k: int, recall: float = RECALL, queries: int = MEASURED) -> int:
    """How many of its nearest lists a query needs until they hold `recall` of the true neighbours.

    Measured by brute force over the whole table for at most `queries` of the queries, chosen by a hash
    of their id; never less than the probes of the index. placed has vec_id, embedding and list.
    """
    lists = len(index.centroids)
    if index.probes >= lists:
        return lists
    some = placed.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).select("vec_id", "embedding").collect()
    if not some:
        return index.probes
    asked, ids = np.array([r["embedding"] for r in some]), np.array([r["vec_id"] for r in some])
    shared = placed.sparkSession.sparkContext.broadcast((asked, ids))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value
        far, near, home = np.full((len(own), k), np.inf), np.full((len(own), k), -1), np.full((len(own), k), -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, names = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)), batch.column("vec_id").to_numpy()
            new = (data**2).sum(axis=1) - 2 * known @ data.T
            new[names == own[:, None]] = np.inf
            far = np.hstack([far, new])
            near = np.hstack([near, np.broadcast_to(names, new.shape)])
            home = np.hstack([home, np.broadcast_to(batch.column("list").to_numpy(), new.shape)])
            best = np.argpartition(far, k - 1, axis=1)[:, :k]
            far, near, home = (np.take_along_axis(x, best, axis=1) for x in (far, near, home))
        query, place = np.nonzero(np.isfinite(far))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(near[query, place].astype(np.int64)), pa.array(far[query, place]), pa.array(home[query, place].astype(np.int32))],
            ["query", "vec_id", "far", "list"],
        )

    rows = placed.select("vec_id", "embedding", "list").mapInArrow(closest, "query int, vec_id long, far double, list int")
    place = F.row_number().over(W.partitionBy("query").orderBy("far", "vec_id"))
    truth = rows.withColumn("place", place).where(F.col("place") <= k).select("query", "list").collect()  # at most `queries` times k rows
    if not truth:
        return index.probes
    order = np.argsort((index.centroids**2).sum(axis=1) - 2 * asked @ index.centroids.T, axis=1, kind="stable")
    ranks = np.argsort(order, axis=1)  # place of each list in a query's order
    needed = np.sort([ranks[r["query"], r["list"]] + 1 for r in truth])
    return max(index.probes, int(needed[int(np.ceil(recall * len(needed))) - 1]))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, index: Index | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `is_query` holds, its `k` nearest others.

    score is the Euclidean distance in double precision on the original vectors; ties go to the
    smaller vec_id. All vectors are searched, by the lists nearest to the query, as many as `probes_for`
    finds necessary. A query whose lists hold fewer than `k` others goes to more. See `usable` for the
    vectors that take no part.
    """
    rows = frozen(usable(vectors, id_col, vector_col))
    index = index or fit(rows)
    out = "query_id long, vec_id long, score double"
    spark = rows.sparkSession
    if index.probes == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False))
                own = pa.array(_closest(data, shared.value.centroids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), own], ["vec_id", "embedding", "list"])

    placed = frozen(rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int"))
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    held = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    probes = probes_for(placed, is_query, index, k)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False))
            far = (known.centroids**2).sum(axis=1) - 2 * data @ known.centroids.T
            order = np.argsort(far, axis=1, kind="stable")
            lists = []
            for row in order:
                # the nearest lists, and more if those hold too few vectors
                enough = int(np.searchsorted(np.cumsum(held[row]), k + 1)) + 1
                lists.append(row[: max(probes, enough)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "query", "lists"])

    asked = placed.where(is_query).select("vec_id", "embedding").mapInArrow(probe, "query_id long, query array<double>, lists array<int>")
    asked = frozen(asked.select("query_id", "query", F.explode("lists").alias("list")))
    wanted = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    parts = spark.createDataFrame(
        [(i, -(-sizes[i] // BLOCK), -(-wanted[i] // QUERIES)) for i in sorted(sizes) if i in wanted], "list int, blocks int, chunks int",
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.join(F.broadcast(parts), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("chunk", upto(F.col("chunks")))
    right = asked.join(F.broadcast(parts), "list").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).withColumn("block", upto(F.col("blocks")))
    key = ["list", "block", "chunk"]

    def scan(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(ask):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        queries, ids = np.stack(ask["query"].to_numpy()), ask["query_id"].to_numpy()
        found = list(scan_block(queries, ids, np.stack(have["embedding"].to_numpy()), have["vec_id"].to_numpy(), shared.value.rotation, k))
        if not found:
            return scan(have.iloc[:0], ask)
        return pd.DataFrame({
            "query_id": np.concatenate([np.full(len(v), ids[n]) for n, v, _ in found]),
            "vec_id": np.concatenate([v for _, v, _ in found]), "score": np.concatenate([s for _, _, s in found]),
        })

    best = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "query_id", "query").groupBy(*key)).applyInPandas(scan, out)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
