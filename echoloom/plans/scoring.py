"""Scoring, ranking and distribution plans over the document, cluster and membership tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import scores as S
from echoloom.operators import scoring
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.tables import AS_OF, with_tables

def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")

# moves exact halves off the rounding edge; both sides add it
_NUDGE = 3.14159e-9


def case(subject: str, table: dict, otherwise) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(otherwise)} END"


def lit(v) -> str:
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else (f"'{v}'" if isinstance(v, str) else str(v))


def steps(subject: str, op: str, table, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {subject} {op} {b} THEN {lit(v)}" for b, v in table) + f" ELSE {lit(otherwise)} END"


def contained(subject: str, rules, otherwise) -> str:
    tests = [(" OR ".join(f"contains({subject}, '{w}')" for w in ws), name) for name, ws in rules]
    return "CASE " + " ".join(f"WHEN {t} THEN '{name}'" for t, name in tests) + f" ELSE '{otherwise}' END"


SEGMENT = f"CASE WHEN author IS NULL OR author = '' THEN 'unknown' ELSE {contained('lower(author)', K.SEGMENT_WORDS, 'individual')} END"
_POINTS = " + ".join(f"CAST(contains(lower(body), '{w}') AS INT)" for w in K.QUALITY_WORDS)
_WORDS = "len(list_filter(string_split(body, ' '), lambda w: w <> ''))"
QUALITY = f"""CASE WHEN body IS NULL OR body = '' THEN 'low' ELSE (SELECT CASE WHEN p >= 3 THEN 'high' WHEN p >= 1 THEN 'medium' ELSE 'low' END
    FROM (SELECT {_POINTS} + CASE WHEN {_WORDS} < 10 THEN -2 WHEN {_WORDS} > 100 THEN 1 ELSE 0 END AS p)) END"""
_URGENCY_ITEMS = [f"CASE WHEN contains(t, '{w.replace(chr(39), chr(39) * 2)}') THEN '{w.replace(chr(39), chr(39) * 2)}' END" for w in K.URGENCY_WORDS] + [
    f"CASE WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN 'pattern: {p.replace(chr(39), chr(39) * 2)}' END" for p in K.URGENCY_PATTERNS
]
URGENCY = f"list_filter([{', '.join(_URGENCY_ITEMS)}], lambda x: x IS NOT NULL)"
_STRONG = " OR ".join(f"contains(x, '{w.replace(chr(39), chr(39) * 2)}')" for w in K.URGENCY_STRONG)
URGENCY_BOOST = f"""CASE WHEN len(u) = 0 THEN CAST(1 AS DOUBLE) ELSE least(CAST(1.5 AS DOUBLE), CAST(1 AS DOUBLE) + len(u) * CAST(0.1 AS DOUBLE)
    + CASE WHEN len(list_filter(u, lambda x: {_STRONG})) > 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END"""


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@plan("h37_severity_score", with_tables("docs") + f"SELECT id, {case('severity', K.SEVERITY_SCORES, 0.2)} AS score FROM docs")
def _(spark, sf):
    return T.documents(spark, sf).select("id", S.severity_score(F.col("severity")).alias("score"))


@plan(
    "h38_severity_boost",
    with_tables("docs")
    + """SELECT id, CASE WHEN component = 'security' THEN CAST(1.2 AS DOUBLE) WHEN feedback_type = 'bug' THEN CAST(1.1 AS DOUBLE)
    WHEN feedback_type = 'feature_request' THEN CAST(0.9 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS boost FROM docs""",
)
def _(spark, sf):
    return T.documents(spark, sf).select("id", S.severity_boost(F.col("feedback_type"), F.col("component")).alias("boost"))


def _reach_sql(users: str, segment: str, component: str) -> str:
    return f"""least({steps(users, '<=', K.REACH_STEPS, K.REACH_TOP)} * {case(segment, K.SEGMENT_REACH, 0.9)}
        * CASE WHEN {component} IN {_in(K.REACH_CRITICAL)} THEN CAST(1.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, CAST(1 AS DOUBLE))"""


@plan(
    "h39_reach_score",
    with_tables("docs")
    + f"SELECT id, round({_reach_sql('users', 'segment', 'component')}, 9) AS score FROM (SELECT *, id % 700 AS users, {SEGMENT} AS segment FROM docs)",
)
def _(spark, sf):
    df = T.documents(spark, sf)
    score = S.reach_score(F.col("id") % 700, S.user_segment(F.col("author")), F.col("component"))
    return df.select("id", F.round(score, 9).alias("score"))


_RECENCY = steps(f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(timestamp)) / 3600000000.0", "<=", K.RECENCY_STEPS, K.RECENCY_OLD)


@plan("h40_recency_score", with_tables("docs") + f"SELECT id, {_RECENCY} AS score FROM docs")
def _(spark, sf):
    return T.documents(spark, sf).select("id", S.recency_score(F.col("timestamp"), _as_of()).alias("score"))


@plan(
    "h41_trend_boost",
    with_tables("scores")
    + "SELECT document_id, CASE WHEN priority_score > 0.5 THEN CAST(1.2 AS DOUBLE) WHEN priority_score > 0.2 THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS boost FROM scores",
)
def _(spark, sf):
    return T.scores(spark, sf).select("document_id", S.trend_boost(F.col("priority_score")).alias("boost"))


_PERSONA = f"""least({case('segment', K.SEGMENT_PERSONA, 0.4)} * {steps('value', '>=', K.VALUE_STEPS, 1.0)}
    * {case('quality', K.QUALITY_FACTORS, 1.0)}, CAST(1 AS DOUBLE))"""


@plan(
    "h42_persona_score",
    with_tables("docs")
    + f"SELECT id, round({_PERSONA}, 9) AS score FROM (SELECT *, {SEGMENT} AS segment, {QUALITY} AS quality, o_totalprice / 30 AS value FROM docs JOIN orders ON id = o_orderkey)",
)
def _(spark, sf):
    value = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 30).alias("value"))
    df = T.documents(spark, sf).join(value, "id")
    score = S.persona_score(S.user_segment(F.col("author")), F.col("value"), S.feedback_quality(F.col("body")))
    return df.select("id", F.round(score, 9).alias("score"))


@plan("h43_user_segment", with_tables("docs") + f"SELECT segment, count(*) AS documents FROM (SELECT {SEGMENT} AS segment FROM docs) GROUP BY segment")
def _(spark, sf):
    df = T.documents(spark, sf).select(S.user_segment(F.col("author")).alias("segment"))
    return df.groupBy("segment").agg(F.count("*").alias("documents"))


@plan("h44_feedback_quality", with_tables("docs") + f"SELECT id, {QUALITY} AS quality FROM docs")
def _(spark, sf):
    return T.documents(spark, sf).select("id", S.feedback_quality(F.col("body")).alias("quality"))


# pair form of the coherence: every pair of members, as the definition says
CLUSTER_STATS = """stats AS (SELECT cluster_id, size, avg_similarity, temporal_coherence, user_diversity,
    (avg_similarity + temporal_coherence + user_diversity) / 3 AS quality FROM (
    SELECT m.cluster_id, count(*) AS size, coalesce(avg(similarity_score) FILTER (WHERE similarity_score <> 0), 0.5) AS avg_similarity,
    CAST(count(DISTINCT author) AS DOUBLE) / count(*) AS user_diversity
    FROM memberships m JOIN docs d ON d.id = m.document_id GROUP BY m.cluster_id) JOIN (
    SELECT cluster_id, CASE WHEN max(n) > 1 THEN greatest(0, 1 - coalesce(avg(dt) FILTER (WHERE dt > 0), 0) / 86400) ELSE 0.5 END AS temporal_coherence
    FROM (SELECT a.cluster_id, abs(epoch_us(x.timestamp) - epoch_us(y.timestamp)) / 1000000.0 AS dt, count(*) OVER (PARTITION BY a.cluster_id, a.document_id) AS n
    FROM memberships a JOIN docs x ON x.id = a.document_id JOIN memberships b ON b.cluster_id = a.cluster_id JOIN docs y ON y.id = b.document_id)
    GROUP BY cluster_id) USING (cluster_id))"""


def _stats(spark, sf):
    return scoring.cluster_stats(T.documents(spark, sf), T.memberships(spark, sf))


@plan(
    "c06_cluster_stats",
    with_tables("docs", "memberships").rstrip() + ", " + CLUSTER_STATS
    + " SELECT cluster_id, size, round(avg_similarity, 6) AS avg_similarity, round(user_diversity, 6) AS user_diversity, round(quality, 6) AS quality FROM stats",
)
def _(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return _stats(spark, sf).select("cluster_id", "size", r("avg_similarity"), r("user_diversity"), r("quality"))


# events by user and hour: times are close, so the coherence is not clipped to zero
@plan(
    "g10_temporal_coherence",
    """WITH e AS (SELECT user_id * 1000 + epoch_us(ts) // 86400000000 AS cluster_id, epoch_us(ts) AS t FROM events),
    p AS (SELECT a.cluster_id, abs(a.t - b.t) / 1000000.0 AS dt FROM e a JOIN e b USING (cluster_id)),
    n AS (SELECT cluster_id, count(*) AS n FROM e GROUP BY cluster_id)
    SELECT cluster_id, round(CASE WHEN max(n) > 1 THEN greatest(0, 1 - coalesce(avg(dt) FILTER (WHERE dt > 0), 0) / 86400) ELSE 0.5 END, 6) AS temporal_coherence
    FROM p JOIN n USING (cluster_id) GROUP BY cluster_id""",
)
def _(spark, sf):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000))
    members = T.read(spark, sf, "events").select(
        (F.col("user_id") * 1000 + day).alias("cluster_id"), F.col("ts").alias("timestamp")
    )
    out = scoring.temporal_coherence(members)
    return out.select("cluster_id", F.round("temporal_coherence", 6).alias("temporal_coherence"))


@plan(
    "h45_cluster_quality",
    with_tables("scores") + "SELECT document_id, round((priority_score + reach_score + recency_score) / 3, 9) AS quality FROM scores",
)
def _(spark, sf):
    q = S.cluster_quality(F.col("priority_score"), F.col("reach_score"), F.col("recency_score"))
    return T.scores(spark, sf).select("document_id", F.round(q, 9).alias("quality"))


@plan(
    "h46_amplification",
    with_tables("docs", "clusters")
    + """SELECT id, round(CASE WHEN member_count < 3 THEN 1.0 ELSE (1 + (member_count - 1) * CAST(0.1 AS DOUBLE)) * least(avg_severity, 1.0) END, 9) AS amplification FROM clusters""",
)
def _(spark, sf):
    a = S.amplification(F.col("member_count"), F.col("avg_severity"), 3)
    return T.clusters(spark, sf).select("id", F.round(a, 9).alias("amplification"))


_URGENT = f"SELECT *, {URGENCY} AS u FROM (SELECT *, lower(title || ' ' || body) AS t FROM docs)"


@plan("h47_urgency", with_tables("docs") + f"SELECT id, array_to_string(u, '|') AS indicators FROM ({_URGENT})")
def _(spark, sf):
    u = S.urgency_indicators(F.col("title"), F.col("body"))
    return T.documents(spark, sf).select("id", F.array_join(u, "|").alias("indicators"))


@plan("h48_urgency_boost", with_tables("docs") + f"SELECT id, round({URGENCY_BOOST}, 9) AS boost FROM ({_URGENT})")
def _(spark, sf):
    df = T.documents(spark, sf).withColumn("u", S.urgency_indicators(F.col("title"), F.col("body")))
    return df.select("id", F.round(S.urgency_boost(F.col("u")), 9).alias("boost"))


@plan(
    "h49_revenue_boost",
    with_tables("docs")
    + f"SELECT component, CASE WHEN component IN {_in(K.REVENUE_COMPONENTS)} THEN CAST(1.15 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS boost, count(*) AS documents FROM docs GROUP BY ALL",
)
def _(spark, sf):
    df = T.documents(spark, sf).select("component", S.revenue_boost(F.col("component")).alias("boost"))
    return df.groupBy("component", "boost").agg(F.count("*").alias("documents"))


SCORED = (
    with_tables("docs", "memberships").rstrip()
    + f""", {CLUSTER_STATS}, prepared AS (SELECT d.id, d.cluster_id, title, coalesce(component, 'other') AS comp, coalesce(severity, 'low') AS sev,
    {SEGMENT} AS segment, {QUALITY} AS quality_level, coalesce(size, 1) AS users, s.size, s.quality, timestamp, {URGENCY.replace('(t,', "(lower(title || ' ' || body),")} AS u
    FROM docs d LEFT JOIN stats s ON s.cluster_id = d.cluster_id),
    parts AS (SELECT *, {case('sev', K.SEVERITY_SCORES, 0.2)} AS severity_score, {_reach_sql('users', 'segment', 'comp')} AS reach_score, {_RECENCY} AS recency_score,
    least({case('segment', K.SEGMENT_PERSONA, 0.4)} * {case('quality_level', K.QUALITY_FACTORS, 1.0)}, 1.0) AS persona_weight,
    CASE WHEN size IS NULL OR size < 2 THEN 1.0 ELSE (1 + (size - 1) * CAST(0.1 AS DOUBLE)) * least(quality, 1.0) END AS amp, {URGENCY_BOOST} AS urgency_boost,
    CASE WHEN comp IN {_in(K.REVENUE_COMPONENTS)} THEN CAST(1.15 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS revenue FROM prepared),
    scored AS (SELECT *, least((severity_score * CAST(0.35 AS DOUBLE) + reach_score * CAST(0.25 AS DOUBLE) + recency_score * CAST(0.2 AS DOUBLE)
    + persona_weight * CAST(0.2 AS DOUBLE)) * amp * urgency_boost * revenue, 1.0) AS priority_score FROM parts) """
)
_LEVEL_NAME = steps("priority_score", ">=", K.LEVEL_STEPS, "minimal")


def scored_documents(spark, sf):
    return scoring.score_documents(T.documents(spark, sf, wide=True), _stats(spark, sf), _as_of())


@plan(
    "h51_score_documents",
    SCORED
    + f"""SELECT id AS document_id, round(severity_score, 6) AS severity_score, round(reach_score, 6) AS reach_score, recency_score,
    round(persona_weight, 6) AS persona_weight, round(amp + 3.14159e-9, 6) AS amplification, round(urgency_boost, 6) AS urgency_boost,
    revenue > 1 AS is_revenue_critical, round(priority_score + 3.14159e-9, 6) AS priority_score, {_LEVEL_NAME} AS level FROM scored""",
)
def _(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return scored_documents(spark, sf).select(
        "document_id", r("severity_score"), r("reach_score"), "recency_score", r("persona_weight"),
        F.round(F.col("cluster_amplification") + _NUDGE, 6).alias("amplification"), r("urgency_boost"), "is_revenue_critical",
        F.round(F.col("priority_score") + _NUDGE, 6).alias("priority_score"), F.col("priority_name").alias("level"),
    )


@plan(
    "h53_score_reasoning",
    SCORED
    + """SELECT id AS document_id, array_to_string(list_filter([CASE WHEN severity_score >= 0.8 THEN 'High severity (' || sev || ')' END,
    CASE WHEN users > 10 THEN 'Affects ' || users || ' users' END, CASE WHEN amp > 1.1 THEN 'Multiple reports (' || coalesce(size, 1) || ' similar issues)' END,
    CASE WHEN urgency_boost > 1.1 THEN 'Contains urgency indicators' END, CASE WHEN revenue > 1.1 THEN 'Revenue-critical component (' || comp || ')' END],
    lambda x: x IS NOT NULL), '|') AS reasoning FROM scored""",
)
def _(spark, sf):
    return scored_documents(spark, sf).select("document_id", F.array_join("reasoning", "|").alias("reasoning"))


@plan(
    "f01_ranking",
    SCORED
    + f"""SELECT row_number() OVER (ORDER BY round(priority_score, 9) DESC, id) AS rank, id AS document_id, title, comp AS component,
    round(priority_score + 3.14159e-9, 6) AS priority_score, {case(f'({_LEVEL_NAME})', K.PRIORITY_LEVELS, 1)} AS priority_level
    FROM scored ORDER BY round(priority_score, 9) DESC, id LIMIT 100""",
)
def _(spark, sf):
    scores = scored_documents(spark, sf).withColumn("priority_score", F.round("priority_score", 9))
    docs = T.documents(spark, sf).withColumn("component", F.coalesce("component", F.lit("other")))
    out = scoring.ranking(scores, docs)
    return out.select(
        F.col("rank").cast("bigint").alias("rank"), "document_id", "title", "component",
        F.round(F.col("priority_score") + _NUDGE, 6).alias("priority_score"), "priority_level",
    )


@plan(
    "c10_ranking_join",
    with_tables("docs", "scores")
    + """SELECT row_number() OVER (ORDER BY priority_score DESC, document_id) AS rank, document_id, title, priority_score, component
    FROM scores JOIN docs ON id = document_id ORDER BY priority_score DESC, document_id LIMIT 100""",
)
def _(spark, sf):
    out = scoring.ranking(T.scores(spark, sf), T.documents(spark, sf))
    return out.select(F.col("rank").cast("bigint").alias("rank"), "document_id", "title", "priority_score", "component")


@plan(
    "h52_level_numbers",
    with_tables("scores") + f"SELECT document_id, {steps('priority_score', '>=', K.LEVEL_STEPS, 'minimal')} AS level, priority_level FROM scores",
)
def _(spark, sf):
    df = T.scores(spark, sf).withColumn("level", S.priority_level(F.col("priority_score")))
    return df.select("document_id", S.level_name(S.level_number(F.col("level"))).alias("level"), S.level_number(F.col("level")).alias("priority_level"))


@plan(
    "b11_scorable_documents",
    with_tables("docs", "scores")
    + "SELECT id FROM docs WHERE feedback_type IS NOT NULL AND processing_status = 'completed' AND id NOT IN (SELECT document_id FROM scores)",
)
def _(spark, sf):
    return scoring.scorable(T.documents(spark, sf), T.scores(spark, sf)).select("id")


_LEVELS = ", ".join(f"('{k}', {v})" for k, v in K.PRIORITY_LEVELS.items())


@plan(
    "d06_level_distribution",
    with_tables("scores")
    + f"SELECT level, count(document_id) AS documents FROM (VALUES {_LEVELS}) l(level, n) LEFT JOIN scores ON priority_level = n GROUP BY level",
)
def _(spark, sf):
    return scoring.level_distribution(T.scores(spark, sf))


@plan(
    "d07_prioritization_stats",
    with_tables("docs", "scores")
    + """SELECT coalesce(component, '(none)') AS component, count(*) AS scores, round(avg(priority_score), 6) AS average_priority_score
    FROM docs JOIN scores ON id = document_id GROUP BY 1 UNION ALL SELECT '(all)', count(*), round(avg(priority_score), 6) FROM scores""",
)
def _(spark, sf):
    out = scoring.prioritization_stats(T.scores(spark, sf), T.documents(spark, sf))
    return out.withColumn("average_priority_score", F.round("average_priority_score", 6))


@plan(
    "a19_score_upsert",
    with_tables("scores")
    + """SELECT document_id, round(priority_score, 6) AS priority_score FROM scores WHERE document_id % 4 <> 1
    UNION ALL SELECT o_orderkey, 0.5 FROM orders WHERE o_orderkey % 4 = 1""",
)
def _(spark, sf):
    current = T.scores(spark, sf).select("document_id", F.round("priority_score", 6).alias("priority_score"))
    incoming = T.read(spark, sf, "orders").where("o_orderkey % 4 = 1").select(
        F.col("o_orderkey").alias("document_id"), F.lit(0.5).alias("priority_score")
    )
    return scoring.replace_by_key(current, incoming, ["document_id"])


@plan(
    "c11_members_semi_join",
    with_tables("docs", "memberships")
    + "SELECT id, author FROM docs WHERE id IN (SELECT document_id FROM memberships WHERE similarity_score >= 0.5)",
)
def _(spark, sf):
    members = T.memberships(spark, sf).where("similarity_score >= 0.5").select(F.col("document_id").alias("id"))
    return T.documents(spark, sf).join(members, "id", "left_semi").select("id", "author")
