"""Vector and clustering plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.functions import vectors as V
from echoloom.operators import cluster as C
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.tables import with_tables

EPS = 0.62


def _vectors(spark, sf):
    return T.vectors(spark, sf).select(F.col("document_id").alias("id"), "embedding")


def _docs(spark, sf):
    """Documents that own the vectors, unclustered."""
    severity = F.element_at(T._severity_map(), F.col("severity"))
    return T.documents(spark, sf).withColumn("cluster_id", F.lit(None).cast("bigint")).withColumn("severity_score", severity)


def _labelled(spark, sf):
    vectors = _vectors(spark, sf)
    return C.dbscan(vectors, EPS).join(vectors, "id")


VEC = with_tables("vectors")
_COS = "list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding)))"
# next vector by id, the last one paired with the first
_PAIRS = "vectors a JOIN vectors b ON b.document_id = (a.document_id + 1) % (SELECT count(*) FROM vectors)"


def _next(spark, sf):
    v = _vectors(spark, sf)
    total = v.agg(F.count("*").alias("total"))
    b = v.select(F.col("id").alias("b_id"), F.col("embedding").alias("b"))
    a = v.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")  # one row
    return a.withColumn("b_id", (F.col("id") + 1) % F.col("total")).join(b, "b_id").select("id", F.col("embedding").alias("a"), "b")


@plan("i01_embedding_text", with_tables("docs") + "SELECT id, md5(trim(concat_ws(' ', title, nullif(body, ''), 'Component: ' || component, 'Type: ' || feedback_type))) AS text_md5 FROM docs")
def _(spark, sf):
    return C.embedding_text(T.documents(spark, sf)).select("id", F.md5(F.encode(F.trim("text"), "UTF-8")).alias("text_md5"))


@plan("i02_normalize", VEC + "SELECT document_id AS id, round(list_sum(list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding)))), 6) AS total FROM vectors")
def _(spark, sf):
    df = _vectors(spark, sf).withColumn("u", V.normalize(F.col("embedding")))
    return df.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@plan("i03_cosine", VEC + f"SELECT a.document_id AS id, round({_COS}, 9) AS similarity FROM {_PAIRS}")
def _(spark, sf):
    return _next(spark, sf).select("id", F.round(V.cosine(F.col("a"), F.col("b")), 9).alias("similarity"))


@plan(
    "i04_distances",
    VEC + f"SELECT a.document_id AS id, round(list_distance(a.embedding, b.embedding), 9) AS euclidean, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1] - z[2]))), 9) AS manhattan FROM {_PAIRS}",
)
def _(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _next(spark, sf).select("id", F.round(V.euclidean(a, b), 9).alias("euclidean"), F.round(V.manhattan(a, b), 9).alias("manhattan"))


EDGES = VEC.rstrip() + f", e AS (SELECT a.document_id AS a, b.document_id AS b FROM vectors a JOIN vectors b ON a.document_id <> b.document_id WHERE 1 - {_COS} <= {EPS}) "
DBSCAN = (
    "WITH RECURSIVE " + EDGES[5:].rstrip()
    + ", reach AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other), labels AS (SELECT v.document_id AS id, coalesce(min(other), -1) AS label FROM vectors v LEFT JOIN reach ON id = v.document_id GROUP BY 1) "
)


@plan("i06_dbscan", DBSCAN + "SELECT id, label FROM labels")
def _(spark, sf):
    return C.dbscan(_vectors(spark, sf), EPS)


@plan(
    "i06_dbscan_of_three",
    "WITH RECURSIVE " + EDGES[5:].rstrip() + """, core AS (SELECT document_id AS id FROM vectors LEFT JOIN e ON a = document_id GROUP BY 1 HAVING count(b) + 1 >= 3),
    reach AS (SELECT id, id AS other FROM core UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other JOIN core c ON c.id = e.b),
    part AS (SELECT id, min(other) AS label FROM reach GROUP BY id),
    border AS (SELECT a AS id, min(b) AS nearest FROM e JOIN core c ON c.id = e.b WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
    SELECT document_id AS id, coalesce(p.label, q.label, -1) AS label FROM vectors LEFT JOIN part p ON p.id = document_id LEFT JOIN border b ON b.id = document_id LEFT JOIN part q ON q.id = b.nearest""",
)
def _(spark, sf):
    return C.dbscan(_vectors(spark, sf), EPS, 3)


@plan("c13_radius_neighbours", EDGES + "SELECT document_id AS id, count(b) AS neighbours FROM vectors LEFT JOIN e ON a = document_id GROUP BY 1")
def _(spark, sf):
    return C.neighbour_counts(_vectors(spark, sf), EPS)


_CENTROID = "SELECT label, pos, avg(x) AS x, count(*) AS members FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM {src}) GROUP BY label, pos"


@plan("i08_centroids", VEC + f"SELECT label, pos, round(x, 9) AS x, members FROM ({_CENTROID.format(src='vectors')})")
def _(spark, sf):
    out = C.centroids(T.vectors(spark, sf))
    return out.select("label", F.posexplode("centroid").alias("pos", "x"), "members").select("label", F.col("pos").cast("bigint") + 1, F.round("x", 9).alias("x"), "members").toDF("label", "pos", "x", "members")


_SEV = T._SEV_CASE
CLUSTERS = DBSCAN.rstrip() + ", " + with_tables("docs")[5:].rstrip() + f""", m AS (SELECT l.label, d.id, d.feedback_type, d.component, {_SEV} AS sev FROM labels l JOIN docs d USING (id) WHERE label <> -1) """


@plan(
    "i09_cluster_records",
    CLUSTERS + """SELECT label AS id, 'Cluster ' || label AS title, 'Cluster of ' || count(*) || ' similar feedback items' AS summary, count(*) AS member_count, min(id) AS representative,
    arg_min(coalesce(feedback_type, '-'), id) AS feedback_type, round(avg(sev), 6) AS avg_severity FROM m GROUP BY label""",
)
def _(spark, sf):
    out = C.build_clusters(_docs(spark, sf), _labelled(spark, sf))
    return out.select(
        "id", "title", "summary", "member_count", F.col("representative_document_id").alias("representative"),
        F.coalesce("feedback_type", F.lit("-")).alias("feedback_type"), F.round("avg_severity", 6).alias("avg_severity"),
    )


@plan(
    "i10_memberships",
    DBSCAN.rstrip() + f""", lv AS (SELECT id, l.label, embedding FROM labels l JOIN vectors ON document_id = id WHERE l.label <> -1), c AS (SELECT label, list(x ORDER BY pos) AS embedding FROM ({_CENTROID.format(src='lv')}) GROUP BY label)
    SELECT a.label AS cluster_id, a.id AS document_id, round({_COS}, 6) AS similarity_score, a.id = min(a.id) OVER (PARTITION BY a.label) AS is_representative FROM lv a JOIN c b USING (label)""",
)
def _(spark, sf):
    labelled = _labelled(spark, sf).persist()
    out = C.build_memberships(C.build_clusters(_docs(spark, sf), labelled), labelled)
    return out.withColumn("similarity_score", F.round("similarity_score", 6))


@plan("g03_cluster_first_member", CLUSTERS + "SELECT label AS cluster_id, min(id) AS document_id FROM m GROUP BY label")
def _(spark, sf):
    out = C.build_clusters(_docs(spark, sf), _labelled(spark, sf))
    return out.select(F.col("id").alias("cluster_id"), F.col("representative_document_id").alias("document_id"))


@plan("i11_assign_clusters", CLUSTERS + "SELECT d.id, m.label AS cluster_id FROM docs d LEFT JOIN m USING (id)")
def _(spark, sf):
    labelled = _labelled(spark, sf).where(F.col("label") != C.NOISE)
    members = labelled.select(F.col("label").alias("cluster_id"), F.col("id").alias("document_id"))
    return C.assign_clusters(_docs(spark, sf), members).select("id", "cluster_id")


@plan("b10_clusterable", with_tables("docs") + "SELECT id FROM docs WHERE feedback_type IS NOT NULL AND processing_status = 'completed' AND cluster_id IS NULL")
def _(spark, sf):
    return C.clusterable(T.documents(spark, sf)).select("id")


@plan(
    "d05_clustering_stats",
    with_tables("docs", "clusters", "memberships")
    + """SELECT c AS total_clusters, m AS total_memberships, round(m / c, 6) AS average_cluster_size, d - m AS unclustered_documents, round(m / d, 6) AS clustering_rate
    FROM (SELECT (SELECT count(*) FROM clusters) AS c, (SELECT count(*) FROM memberships) AS m, (SELECT count(feedback_type) FROM docs) AS d)""",
)
def _(spark, sf):
    out = C.clustering_stats(T.clusters(spark, sf), T.memberships(spark, sf), T.documents(spark, sf))
    return out.select(
        "total_clusters", "total_memberships", F.round("average_cluster_size", 6).alias("average_cluster_size"),
        "unclustered_documents", F.round("clustering_rate", 6).alias("clustering_rate"),
    )


@plan("i07_kmeans")
def _(spark, sf):
    return C.kmeans(_vectors(spark, sf)).groupBy("label").agg(F.count("*").alias("members"))


@plan(
    "i12_embedding_cache",
    "SELECT count(DISTINCT sha256(text)) AS misses FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))",
)
def _(spark, sf):
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    known = docs.join(T.read(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    cache = known.select(C.cache_key(F.col("text")).alias("text_hash")).distinct()
    return C.cache_misses(docs, cache).agg(F.count("*").alias("misses"))


@plan(
    "i13_nearest",
    VEC + f"""SELECT query_id, id, similarity, rank FROM (SELECT a.document_id AS query_id, b.document_id AS id, round({_COS}, 9) AS similarity,
    row_number() OVER (PARTITION BY a.document_id ORDER BY round({_COS}, 12) DESC, b.document_id) AS rank FROM (SELECT c AS document_id, list(x ORDER BY pos) AS embedding
    FROM (SELECT label AS c, pos, avg(x) AS x FROM ({_CENTROID.format(src='vectors').replace('avg(x) AS x, count(*) AS members', 'x').replace('GROUP BY label, pos', '')}) GROUP BY label, pos) GROUP BY c) a, vectors b) WHERE rank <= 5""",
)
def _(spark, sf):
    queries = C.centroids(T.vectors(spark, sf)).select(F.col("label").alias("id"), F.col("centroid").alias("embedding"))
    out = C.nearest(queries, _vectors(spark, sf), 5)
    return out.select("query_id", "id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@plan("i13_nearest_in_cells")
def _(spark, sf):
    vectors = _vectors(spark, sf)
    queries = C.centroids(T.vectors(spark, sf)).select(F.col("label").alias("id"), F.col("centroid").alias("embedding"))
    model, cells = C.cell_index(vectors)
    return C.nearest_in_cells(queries, model, cells, k=5).select("query_id", "id", F.round("similarity", 9).alias("similarity"), "rank")


@plan("i14_embed_callback", "SELECT doc_id AS id, CAST(1 AS DOUBLE) AS length FROM documents")
def _(spark, sf):
    def model(texts):
        return [[float(len(t)), float(t.count(" ") + 1), 1.0] for t in texts]

    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.embed(docs, model, 3).select("id", F.round(V.norm(F.col("embedding")), 6).alias("length"))


@plan(
    "i14_embed_vectors",
    """SELECT id, round(l / n, 6) AS x, round(s / n, 6) AS y, round(1 / n, 9) AS z FROM (SELECT id, l, s, sqrt(l * l + s * s + 1) AS n FROM
    (SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS l, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS s FROM documents))""",
)
def _(spark, sf):
    model = lambda texts: [[float(len(t)), float(t.count(" ") + 1), 1.0] for t in texts]
    found = C.embed(T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), model, 3)
    part = lambda i, digits: F.round(F.col("embedding")[i], digits)
    return found.select("id", part(0, 6).alias("x"), part(1, 6).alias("y"), part(2, 9).alias("z"))


@plan(
    "i05_similarity_totals",
    VEC + f"SELECT a.label, round(sum({_COS}), 6) AS total, count(*) AS pairs FROM vectors a JOIN vectors b ON a.label = b.label GROUP BY a.label",
)
def _(spark, sf):
    out = C.similarity_totals(T.vectors(spark, sf).withColumn("grp", F.col("label")))
    return out.select(F.col("grp").alias("label"), F.round("total", 6).alias("total"), "pairs")


@plan("i05_similarity_rows", VEC + f"SELECT a.document_id AS a, b.document_id AS b, round({_COS}, 9) AS similarity FROM vectors a JOIN vectors b ON b.document_id // 10 = a.document_id // 10 AND b.document_id > a.document_id")
def _(spark, sf):
    v = _vectors(spark, sf)
    ids = v.select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 9)).alias("b"))
    ids = ids.where(F.floor(F.col("a") / 10) == F.floor(F.col("b") / 10))
    return C.similarity_rows(v, ids).withColumn("similarity", F.round("similarity", 9))
