import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.functions import vectors as V
from echoloom.operators import cluster as C

VEC = "id int, embedding array<double>"


def brute(rows, eps, min_samples):
    """{id: label}: least core id of the connected part; borders follow their least core."""
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], dtype=float)
    norms = np.linalg.norm(m, axis=1)
    unit = np.divide(m, norms[:, None], out=np.zeros_like(m), where=norms[:, None] > 0)
    close = (1 - unit @ unit.T <= eps + 1e-12) & (norms[:, None] > 0) & (norms[None, :] > 0)
    core = close.sum(axis=1) >= min_samples
    part = {i: i for i, c in zip(range(len(ids)), core) if c}
    changed = True
    while changed:
        changed = False
        for i in part:
            for j in part:
                if close[i, j] and part[j] < part[i]:
                    part[i] = part[j]
                    changed = True
    out = {}
    for i in range(len(ids)):
        if i in part:
            out[ids[i]] = ids[part[i]]
        else:
            near = [j for j in part if close[i, j]]
            out[ids[i]] = ids[part[min(near)]] if near else -1
    return out


def test_a_vector_travels_once_a_group_of_blocks(spark, monkeypatch):
    """Without structure every block meets every other; a vector used to travel once for each."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 8)
    monkeypatch.setattr(C, "GROUPS", 3)
    monkeypatch.setattr(C, "GROUP_BLOCKS", 1000)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(160)]
    df = spark.createDataFrame(rows, VEC)
    unit = df.select("id", V.normalize(F.col("embedding")).alias("v"), F.lit(1).cast("bigint").alias("n"))
    placed, pairs, _ = C._blocks(unit, 1.0)
    assert pairs.count() > 400 and C._tiles(placed, pairs).count() <= 3 * 160
    assert {r["id"]: r["label"] for r in C.dbscan(df, 0.1, 4).collect()} == brute(rows, 0.1, 4)
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (1 - m @ m.T <= 0.1 + 1e-12).sum(axis=1) - 1
    assert {r["id"]: r["neighbours"] for r in C.neighbour_counts(df, 0.1).collect()} == dict(enumerate(want.tolist()))


def test_similarity_and_distances(one):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = one(a=arr(1, 0), b=arr(0, 1), z=arr(0, 0), p=arr(0, 0), q=arr(3, 4))
    c = F.col
    assert row(V.cosine(c("a"), c("b"))) == 0 and row(V.cosine(c("a"), c("a"))) == 1 and row(V.cosine(c("a"), c("z"))) == 0
    assert row(V.euclidean(c("p"), c("q"))) == 5 and row(V.manhattan(c("p"), c("q"))) == 7
    assert row(V.normalize(c("q"))) == [0.6, 0.8] and row(V.normalize(c("z"))) == [0.0, 0.0]


def test_five_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.9, 0.1]), (4, [0.0, 0.0, 1.0])]
    got = {r["id"]: r["label"] for r in C.dbscan(spark.createDataFrame(rows, VEC), 0.5, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: -1}


@pytest.mark.parametrize("min_samples, block", [(2, 2048), (4, 2048), (4, 16)])
def test_density_clusters_equal_the_definition(spark, monkeypatch, min_samples, block):
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    rng = random.Random(min_samples)
    centers = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(120):
        c = rng.choice(centers)
        rows.append((i, [x + rng.gauss(0, 0.25) for x in c]))
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, [0.0] * 4)]
    got = {r["id"]: r["label"] for r in C.dbscan(spark.createDataFrame(rows, VEC), 0.02, min_samples).collect()}
    assert got == brute(rows, 0.02, min_samples)


def test_a_deep_tree_with_narrow_cells(spark, monkeypatch):
    """Cells of cells, leaves whose vectors are all neighbours, and vectors far from all others."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 8)
    monkeypatch.setattr(C, "FANOUT", 3)
    rng = random.Random(7)
    centers = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(5)]
    rows = []
    for i in range(150):
        spread = rng.choice([1e-4, 1e-4, 0.1, 0.6])
        rows.append((i, [x + rng.gauss(0, spread) for x in rng.choice(centers)]))
    df = spark.createDataFrame(rows, VEC).repartition(3)
    unit = df.select("id", V.normalize(F.col("embedding")).alias("v"), F.lit(1).cast("bigint").alias("n"))
    placed, nodes = C._cells(unit, 0.2)
    seen = nodes.collect()
    assert placed.count() == 150 and max(r["depth"] for r in seen) >= 2 and any(r["leaf"] and r["rows"] > 8 for r in seen)
    assert {r["id"]: r["label"] for r in C.dbscan(df, 0.02, 4).collect()} == brute(rows, 0.02, 4)
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (1 - m @ m.T <= 0.02 + 1e-12).sum(axis=1) - 1
    assert {r["id"]: r["neighbours"] for r in C.neighbour_counts(df, 0.02).collect()} == dict(enumerate(want.tolist()))


def test_components_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "LINKS_PER_TASK", 30)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 100], "a int, b int").repartition(6)
    out = {r["id"]: r["component"] for r in C.components(edges, spark.range(0, 202).selectExpr("cast(id AS int) AS id")).collect()}
    assert all(out[i] == (0 if i <= 100 else 101) for i in range(201)) and out[201] == 201


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 100], "a int, b int")
    out = {r["id"]: r["component"] for r in C.components(edges, spark.range(0, 202).selectExpr("cast(id AS int) AS id")).collect()}
    assert all(out[i] == (0 if i <= 100 else 101) for i in range(201)) and out[201] == 201


def test_centroids_and_clusters(spark):
    rows = [(0, [1.0, 0.0], 7), (1, [3.0, 0.0], 7), (2, [0.0, 2.0], 8), (3, [0.0, 9.0], -1)]
    labelled = spark.createDataFrame(rows, "id int, embedding array<double>, label int")
    got = {r["label"]: (r["centroid"], r["members"]) for r in C.centroids(labelled).collect()}
    assert got == {7: ([2.0, 0.0], 2), 8: ([0.0, 2.0], 1)}
    docs = spark.createDataFrame([(i, "bug", "ui", 0.2 * (i + 1)) for i in range(4)], "id int, feedback_type string, component string, severity_score double")
    clusters = C.build_clusters(docs, labelled)
    r = clusters.collect()
    assert len(r) == 1 and r[0]["title"] == "Cluster 7" and r[0]["representative_document_id"] == 0 and r[0]["avg_severity"] == pytest.approx(0.3)
    members = {m["document_id"]: (m["similarity_score"], m["is_representative"]) for m in C.build_memberships(clusters, labelled).collect()}
    assert members == {0: (1.0, True), 1: (1.0, False)}


def test_kmeans_and_nearest(spark):
    rows = [(i, [float(i // 10 * 10) + i % 10 * 0.1, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, VEC)
    labels = {r["id"]: r["label"] for r in C.kmeans(df, k=4, tries=3).collect()}
    assert len({labels[i] for i in range(40)}) == 4 and all(labels[i] == labels[i // 10 * 10] for i in range(40))
    got = C.nearest(df.where("id = 5"), df, 3).orderBy("rank").collect()
    assert got[0]["id"] == 5 and len(got) == 3
    # several blocks of queries give what one block gives
    rows_of = lambda block: sorted(map(tuple, C.nearest(df, df, 3, block=block).collect()))
    assert rows_of(7) == rows_of(1000) and len(rows_of(7)) == 120


def test_embedding_hook_and_cache(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "  "), (3, "ab"), (4, "xyz")], "id int, text string")

    def model(batch):
        return [[3.0 * len(t), 4.0 * len(t)] for t in batch]

    got = {r["id"]: r["embedding"] for r in C.embed(texts, model, 2).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]
    cache = texts.where("id = 4").select(C.cache_key(F.col("text")).alias("text_hash"), F.array(F.lit(1.0)).alias("embedding"))
    assert C.cache_misses(texts, cache).count() == 2
    assert [r["id"] for r in C.cached_embeddings(texts, cache).collect()] == [4]


def test_clusters_of_string_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.0, 0.0])]
    whole = spark.createDataFrame(rows, "id long, embedding array<double>")
    text = whole.withColumn("id", F.concat(F.lit("id-"), "id"))
    assert {r["id"]: r["label"] for r in C.dbscan(text, 0.3).collect()} == {"id-1": "id-1", "id-2": "id-1", "id-3": "-1", "id-4": "-1"}
    labelled = C.dbscan(text, 0.3).join(text, "id")
    assert [(r["label"], r["members"]) for r in C.centroids(labelled).collect()] == [("id-1", 2)]


def test_fewer_parts_and_groups_for_few_vectors(spark, monkeypatch):
    """A cell little above the size of a block makes few leaves, and small leaves make no groups of their own."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 40)
    monkeypatch.setattr(C, "GROUPS", 2)
    monkeypatch.setattr(C, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(100, 8))
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)], 1) for i, v in enumerate(m)]
    unit = spark.createDataFrame(rows, "id bigint, v array<double>, n bigint")
    placed, pairs, _ = C._blocks(unit, 1.1)
    assert placed.count() == 100 and placed.select("cell").distinct().count() < C.FANOUT
    assert pairs.select("tile").distinct().count() <= 3


def test_kmeans_fits_frozen_rows_several_at_a_time(spark, monkeypatch):
    import threading

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 6 * (i % 3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    data = df.select("id", C.array_to_vector("embedding").alias("features"))
    costs = [C.KMeans(k=3, seed=42 + i, maxIter=300).fit(data).summary.trainingCost for i in range(4)]
    seen = []

    class Spy(C.KMeans):
        def fit(self, dataset):
            seen.append((dataset.storageLevel.useMemory, threading.get_ident()))
            return super().fit(dataset)

    monkeypatch.setattr(C, "KMeans", Spy)
    got = {r["id"]: r["label"] for r in C.kmeans(df, k=3, tries=4).collect()}
    assert len(seen) == 4 and not any(held for held, _ in seen) and len({thread for _, thread in seen}) > 1
    m = np.array([v for _, v in rows])
    label = np.array([got[i] for i, _ in rows])
    cost = sum(((m[label == k] - m[label == k].mean(axis=0)) ** 2).sum() for k in set(label))
    assert abs(cost - min(costs)) < 1e-6
