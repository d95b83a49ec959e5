"""Ticket and listing plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import scores as S
from echoloom.functions import tickets as TK
from echoloom.operators import listing as L
from echoloom.operators import tickets as op
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.scoring import case, steps
from echoloom.plans.tables import AS_OF, PERIOD_START, with_tables

def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")



def _candidates(spark, sf):
    return op.candidates(T.documents(spark, sf), T.scores(spark, sf), T.clusters(spark, sf), T.tickets(spark, sf))


CANDIDATES = (
    with_tables("docs", "scores", "clusters", "tickets").rstrip()
    + """, cand AS (SELECT s.*, d.title, coalesce(feedback_type, 'bug') AS feedback_type, d.component, author, coalesce(member_count, 1) AS cluster_size
    FROM scores s JOIN docs d ON d.id = s.document_id LEFT JOIN clusters c ON c.id = d.cluster_id
    WHERE priority_score >= 0.7 AND NOT EXISTS (SELECT 1 FROM tickets t WHERE t.source_document_id = s.document_id)) """
)


@plan(
    "c02_ticket_candidates",
    CANDIDATES + "SELECT document_id, priority_score, feedback_type, cluster_size FROM cand ORDER BY priority_score DESC, document_id LIMIT 50",
)
def _(spark, sf):
    return op.select_top(_candidates(spark, sf)).select("document_id", "priority_score", "feedback_type", "cluster_size")


@plan("c12_unticketed_high_scores", CANDIDATES + "SELECT count(*) AS candidates, round(sum(priority_score), 6) AS total FROM cand")
def _(spark, sf):
    return _candidates(spark, sf).agg(F.count("*").alias("candidates"), F.round(F.sum("priority_score"), 6).alias("total"))


_REASON = """array_to_string(list_filter([CASE WHEN severity_score >= 0.8 THEN 'High severity impact' WHEN severity_score >= 0.6 THEN 'Medium severity impact' END,
    CASE WHEN reach_score >= 0.8 THEN 'Affects many users' WHEN reach_score >= 0.6 THEN 'Moderate user impact' END,
    CASE WHEN recency_score >= 0.8 THEN 'Recent feedback' END, CASE WHEN persona_weight >= 0.8 THEN 'High-value user segment' END,
    CASE WHEN is_revenue_critical THEN 'Revenue-critical issue' END,
    CASE WHEN revenue_impact_multiplier > 1 THEN 'Revenue impact: 1.1x' END], lambda x: x IS NOT NULL), '|')"""


@plan("h54_ticket_reasoning", with_tables("scores") + f"SELECT document_id, regexp_replace({_REASON}, '1\\.[12]x', '1.1x') AS reasoning FROM scores")
def _(spark, sf):
    reasons = S.ticket_reasoning(
        F.col("severity_score"), F.col("reach_score"), F.col("recency_score"), F.col("persona_weight"),
        F.col("is_revenue_critical"), F.col("revenue_impact_multiplier"),
    )
    # 1.15 prints as 1.1 or 1.2, by how its binary form is rounded
    joined = F.regexp_replace(F.array_join(reasons, "|"), r"1\.[12]x", "1.1x")
    return T.scores(spark, sf).select("document_id", joined.alias("reasoning"))


_JIRA = steps("priority_score", ">=", K.JIRA_STEPS, "lowest")
_GITHUB = steps("priority_score", ">=", K.GITHUB_STEPS, "lowest")


@plan(
    "h55_ticket_priority",
    with_tables("scores") + f"SELECT document_id, {_JIRA} AS jira, {_GITHUB} AS github, {case(f'({_JIRA})', K.PRIORITY_SIGNS, '⚪')} AS sign FROM scores",
)
def _(spark, sf):
    jira = TK.ticket_priority(F.col("priority_score"), F.lit("jira"))
    return T.scores(spark, sf).select(
        "document_id", jira.alias("jira"), TK.ticket_priority(F.col("priority_score"), F.lit("github")).alias("github"),
        TK.priority_sign(jira).alias("sign"),
    )


@plan(
    "h56_priority_signs",
    with_tables("scores") + f"SELECT sign, count(*) AS scores FROM (SELECT {case(f'({_GITHUB})', K.PRIORITY_SIGNS, '⚪')} AS sign FROM scores) GROUP BY sign",
)
def _(spark, sf):
    sign = TK.priority_sign(TK.ticket_priority(F.col("priority_score"), F.lit("github")))
    return T.scores(spark, sf).groupBy(sign.alias("sign")).agg(F.count("*").alias("scores"))


@plan("h57_story_points", with_tables("scores") + f"SELECT {steps('priority_score', '>=', K.STORY_POINTS, 1)} AS points, count(*) AS scores FROM scores GROUP BY 1")
def _(spark, sf):
    return T.scores(spark, sf).groupBy(TK.story_points(F.col("priority_score")).alias("points")).agg(F.count("*").alias("scores"))


_KIND = "CASE WHEN feedback_type IN ('feature_request', 'performance') THEN feedback_type ELSE 'bug' END"
_PLATFORM = "CASE WHEN priority_score >= 0.9 THEN 'jira' ELSE 'github' END"
_PREFIX = "CASE " + " ".join(f"WHEN kind = '{k}' AND platform = '{p}' THEN '{f[:-2]}'" for (k, p), f in TK.TITLE_FORMATS.items()) + " END"
_TYPE = "CASE " + " ".join(f"WHEN kind = '{k}' AND platform = '{p}' THEN '{v}'" for (k, p), v in TK.TICKET_TYPES.items()) + " END"
_LABELS = "CASE " + " ".join(
    f"WHEN kind = '{k}' AND platform = '{p}' THEN " + " || ',' || ".join("coalesce(component, 'unknown')" if x == "{component}" else f"'{x}'" for x in v)
    for (k, p), v in TK.LABELS.items()
) + " END"


def _tickets(spark, sf):
    return op.build_tickets(_candidates(spark, sf))


@plan(
    "h58_ticket_texts",
    CANDIDATES + f"""SELECT document_id AS source_document_id, platform, {_PREFIX} || title AS title, {_TYPE} AS ticket_type, {_LABELS} AS labels
    FROM (SELECT *, {_KIND} AS kind, {_PLATFORM} AS platform FROM cand)""",
)
def _(spark, sf):
    return _tickets(spark, sf).select("source_document_id", "platform", "title", "ticket_type", F.array_join("labels", ",").alias("labels"))


@plan("h59_platform", CANDIDATES + f"SELECT {_PLATFORM} AS platform, count(*) AS tickets FROM cand GROUP BY 1")
def _(spark, sf):
    return _tickets(spark, sf).groupBy("platform").agg(F.count("*").alias("tickets"))


@plan(
    "h60_jira_payload",
    CANDIDATES + f"""SELECT document_id AS source_document_id, {_PREFIX} || title AS summary, {case(f'({_TYPE})', K.JIRA_ISSUE_TYPES, 'Bug')} AS issue_type,
    {case(f'({_JIRA})', K.JIRA_PRIORITIES, 'Medium')} AS priority, coalesce(component, 'unknown') AS component, 'FEED' AS project
    FROM (SELECT *, {_KIND} AS kind, 'jira' AS platform FROM cand WHERE priority_score >= 0.9)""",
)
def _(spark, sf):
    at = lambda path: F.get_json_object("payload", path)
    return _tickets(spark, sf).where("platform = 'jira'").select(
        "source_document_id", at("$.fields.summary").alias("summary"), at("$.fields.issuetype.name").alias("issue_type"),
        at("$.fields.priority.name").alias("priority"), at("$.fields.components[0].name").alias("component"),
        at("$.fields.project.key").alias("project"),
    )


@plan(
    "h61_github_payload",
    CANDIDATES + f"""SELECT document_id AS source_document_id, {_PREFIX} || title AS title, {_LABELS} AS labels
    FROM (SELECT *, {_KIND} AS kind, 'github' AS platform FROM cand WHERE priority_score < 0.9)""",
)
def _(spark, sf):
    at = lambda path: F.get_json_object("payload", path)
    labels = F.array_join(F.from_json(at("$.labels"), "array<string>"), ",")
    return _tickets(spark, sf).where("platform = 'github'").select("source_document_id", at("$.title").alias("title"), labels.alias("labels"))


@plan(
    "a20_ticket_rows",
    CANDIDATES + f"SELECT document_id AS source_document_id, 'open' AS status, {_PLATFORM} AS platform, priority_score FROM cand",
)
def _(spark, sf):
    return _tickets(spark, sf).select("source_document_id", "status", "platform", "priority_score")


@plan(
    "j27_ticket_caps",
    """SELECT event_id, hour_rank, day_rank FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS day_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, event_id) AS hour_rank FROM events) WHERE hour_rank <= 3) WHERE day_rank <= 20""",
)
def _(spark, sf):
    out = op.admit_by_caps(T.read(spark, sf, "events"), "ts", "event_id", "value", per_hour=3, per_day=20)
    return out.select("event_id", F.col("hour_rank").cast("bigint").alias("hour_rank"), F.col("day_rank").cast("bigint").alias("day_rank"))


_KNOWN = ", ".join(
    f"('{d}', '{v}')" for d, vs in (("platform", K.TICKET_PLATFORMS), ("status", K.TICKET_STATUSES), ("priority", K.PRIORITY_LEVELS.values())) for v in vs
)


@plan(
    "d13_ticket_statistics",
    with_tables("tickets").rstrip()
    + f""", counts AS (SELECT 'platform' AS dimension, platform AS value, count(*) AS n FROM tickets GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM tickets GROUP BY ALL
    UNION ALL SELECT 'priority', CAST(priority AS VARCHAR), count(*) FROM tickets GROUP BY ALL)
    SELECT k.dimension, k.value, coalesce(n, 0) AS tickets FROM (VALUES {_KNOWN}) k(dimension, value) LEFT JOIN counts c ON c.dimension = k.dimension AND c.value = k.value""",
)
def _(spark, sf):
    return op.ticket_statistics(T.tickets(spark, sf))


@plan(
    "b22_recent_feedback_tickets",
    with_tables("tickets") + f"SELECT id, created_at::VARCHAR AS created FROM tickets WHERE list_contains(labels, 'feedback') AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY",
)
def _(spark, sf):
    return op.feedback_tickets(T.tickets(spark, sf), _as_of()).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@plan(
    "b22_open_bug_tickets",
    with_tables("tickets") + f"SELECT id FROM tickets WHERE list_contains(labels, 'bug') AND status = 'open' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 9999 DAY",
)
def _(spark, sf):
    return op.feedback_tickets(T.tickets(spark, sf), _as_of(), days=9999, label="bug", status="open").select("id")


# --- listings --------------------------------------------------------------------------
_FILTER = L.FeedbackFilter(feedback_type="bug", source="src3", date_from=PERIOD_START, date_to="2001-01-01 00:00:00", search="VERSION 2")
_FILTER_SQL = f"feedback_type = 'bug' AND source_type = 'src3' AND created_at BETWEEN TIMESTAMP '{PERIOD_START}' AND TIMESTAMP '2001-01-01' AND body ILIKE '%version 2%'"


@plan("b16_feedback_listing", with_tables("docs") + f"SELECT id, title, component FROM docs WHERE {_FILTER_SQL}")
def _(spark, sf):
    return L.filter_feedback(T.documents(spark, sf), _FILTER).select("id", "title", "component")


@plan(
    "f02_feedback_page",
    with_tables("docs") + "SELECT id, title FROM docs WHERE feedback_type = 'bug' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40",
)
def _(spark, sf):
    rows = L.filter_feedback(T.documents(spark, sf), L.FeedbackFilter(feedback_type="bug"))
    return L.page(rows, [F.col("created_at").desc(), F.col("id")], number=3).select("id", "title")


@plan("f03_oldest_first", with_tables("docs") + "SELECT id, title FROM docs ORDER BY created_at, id LIMIT 100")
def _(spark, sf):
    return L.page(T.documents(spark, sf), [F.col("created_at"), F.col("id")], size=100).select("id", "title")


@plan(
    "d27_page_summary",
    with_tables("docs") + f"SELECT count(*) AS total, 2 AS page, 20 AS page_size, 40 < count(*) AS has_next, true AS has_previous FROM docs WHERE {_FILTER_SQL}",
)
def _(spark, sf):
    return L.page_summary(L.filter_feedback(T.documents(spark, sf), _FILTER), number=2)


_COUNT = "(length(lower(text)) - length(replace(lower(text), 'the ', ''))) / CAST(4 AS DOUBLE)"


@plan(
    "b17_search",
    f"SELECT doc_id AS id, round(least(1, {_COUNT} * 100 / length(text)), 9) AS relevance FROM documents WHERE text ILIKE '%the %' AND source = 'src3'",
)
def _(spark, sf):
    docs = T.raw_feedback(spark, sf).select("id", "source_type", F.col("content").alias("body"))
    return L.search(docs, "the ", L.FeedbackFilter(source="src3")).select("id", F.round("relevance", 9).alias("relevance"))


@plan(
    "b21_search_top_page",
    f"SELECT doc_id AS id, round(least(1, {_COUNT} * 100 / length(text)), 9) AS relevance FROM documents WHERE text ILIKE '%the %' ORDER BY 2 DESC, 1 LIMIT 20",
)
def _(spark, sf):
    docs = T.raw_feedback(spark, sf).select("id", F.col("content").alias("body"))
    hits = L.search(docs, "the ").select("id", F.round("relevance", 9).alias("relevance"))
    return L.page(hits, [F.col("relevance").desc(), F.col("id")])


@plan("b18_ticket_listing", with_tables("tickets") + "SELECT id, title FROM tickets WHERE status = 'open' AND platform = 'jira' ORDER BY created_at DESC, id LIMIT 50")
def _(spark, sf):
    rows = L.filter_equal(T.tickets(spark, sf), status="open", platform="jira")
    return L.page(rows, [F.col("created_at").desc(), F.col("id")], size=50).select("id", "title")


@plan(
    "b20_cluster_listing",
    with_tables("docs", "clusters")
    + """SELECT c.id, c.title, member_count, f.id AS document_id, f.title AS document_title FROM clusters c
    JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn FROM docs WHERE cluster_id IS NOT NULL) f ON f.cluster_id = c.id AND rn = 1
    WHERE c.title ILIKE '%cluster 1%'""",
)
def _(spark, sf):
    out = L.clusters_with_representative(T.clusters(spark, sf), T.documents(spark, sf), "cluster 1")
    return out.select("id", "title", "member_count", "document_id", "document_title")


@plan(
    "c08_cluster_representative",
    with_tables("docs")
    + "SELECT cluster_id AS id, min(id) AS document_id, arg_min(title, id) AS document_title FROM docs WHERE cluster_id IS NOT NULL GROUP BY cluster_id",
)
def _(spark, sf):
    out = L.clusters_with_representative(T.clusters(spark, sf), T.documents(spark, sf))
    return out.select("id", "document_id", "document_title")


@plan(
    "b15_period_documents",
    with_tables("docs") + f"SELECT count(*) AS documents FROM docs WHERE created_at BETWEEN TIMESTAMP '{PERIOD_START}' AND TIMESTAMP '{AS_OF}'",
)
def _(spark, sf):
    rows = L.filter_feedback(T.documents(spark, sf), L.FeedbackFilter(date_from=PERIOD_START, date_to=AS_OF))
    return rows.agg(F.count("*").alias("documents"))


@plan(
    "e06_distinct_keep_first",
    "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def _(spark, sf):
    return L.distinct_keep_first(T.read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
