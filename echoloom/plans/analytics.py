"""Trend, component, cluster, distribution and report plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.operators import analytics as A
from echoloom.operators import listing as L
from echoloom.operators import reports as R
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.tables import AS_OF, PERIOD_START, with_tables

PERIOD = A.Period(PERIOD_START, AS_OF)
_BEFORE = A.previous_period(PERIOD, 7)

def _in(period: A.Period, col: str = "created_at") -> str:
    return f"({col} >= TIMESTAMP '{period.start}' AND {col} < TIMESTAMP '{period.end}')"

NOW, PREV = _in(PERIOD), _in(_BEFORE)

def _four(spark, sf):
    return T.documents(spark, sf), T.scores(spark, sf), T.tickets(spark, sf), T.clusters(spark, sf)

def digest(spark, sf, period: A.Period = PERIOD) -> R.Digest:
    return R.Digest(*_four(spark, sf), period)

_TREND = """CASE WHEN prev = 0 THEN CASE WHEN cur > 0 THEN 100.0 ELSE 0.0 END ELSE (cur - prev) / prev * 100 END"""
TRENDS = with_tables("docs", "scores", "tickets", "clusters").rstrip() + f""", ds AS (SELECT d.*, priority_score FROM docs d LEFT JOIN scores s ON s.document_id = d.id),
    comp AS (SELECT component, count(*) FILTER (WHERE {NOW}) AS cur, count(*) FILTER (WHERE {PREV}) AS prev,
    count(*) FILTER (WHERE {NOW} AND priority_score >= 0.7) AS cur_high, count(*) FILTER (WHERE {PREV} AND priority_score >= 0.7) AS prev_high,
    coalesce(avg(priority_score) FILTER (WHERE {NOW}), 0) AS mean FROM ds GROUP BY component),
    tk AS (SELECT count(*) FILTER (WHERE {NOW}) AS cur, count(*) FILTER (WHERE {PREV}) AS prev,
    count(*) FILTER (WHERE {NOW} AND status IN ('resolved', 'closed')) AS cd, count(*) FILTER (WHERE {PREV} AND status IN ('resolved', 'closed')) AS pd FROM tickets),
    m AS (SELECT 1 AS rule_no, 'Total Feedback' AS metric, CAST(sum(cur) AS DOUBLE) AS cur, CAST(sum(prev) AS DOUBLE) AS prev FROM comp
    UNION ALL SELECT 2, 'High Priority Feedback', sum(cur_high), sum(prev_high) FROM comp UNION ALL SELECT 3, 'Tickets Created', cur, prev FROM tk
    UNION ALL SELECT 4, 'Resolution Rate', CASE WHEN cur > 0 THEN cd / cur * 100 ELSE 0 END, CASE WHEN prev > 0 THEN pd / prev * 100 ELSE 0 END FROM tk
    UNION ALL SELECT 5, component || ' Feedback', cur, prev FROM comp WHERE component IS NOT NULL AND cur > 0 AND prev > 0),
    t AS (SELECT *, {_TREND} AS change FROM m),
    trends AS (SELECT rule_no, metric, cur AS current_value, prev AS previous_value, change AS change_percentage,
    CASE WHEN abs(change) < 5 THEN 'stable' WHEN change > 0 THEN 'up' ELSE 'down' END AS trend_direction,
    CASE WHEN abs(change) >= 50 THEN 'high' WHEN abs(change) >= 20 THEN 'medium' ELSE 'low' END AS significance FROM t) """

@plan(
    "g12_trends",
    TRENDS + "SELECT metric, round(current_value, 6) AS current_value, round(previous_value, 6) AS previous_value, round(change_percentage, 6) AS change_percentage, trend_direction, significance FROM trends",
)
def _(spark, sf):
    docs, scores, tickets, _ = _four(spark, sf)
    r = lambda c: F.round(c, 6).alias(c)
    return A.analyze_trends(docs, scores, tickets, PERIOD).select(
        "metric", r("current_value"), r("previous_value"), r("change_percentage"), "trend_direction", "significance"
    )

@plan("b23_critical_trends", TRENDS + "SELECT metric, round(change_percentage, 6) AS change_percentage FROM trends WHERE significance = 'high' AND trend_direction = 'up'")
def _(spark, sf):
    return A.critical_trends(digest(spark, sf).trends()).select("metric", F.round("change_percentage", 6).alias("change_percentage"))

COMPONENTS = TRENDS.rstrip() + f""", titles AS (SELECT component, string_agg(title, '|' ORDER BY id) AS titles FROM (SELECT component, id, title,
    row_number() OVER (PARTITION BY component ORDER BY id) AS rn FROM docs WHERE {NOW} AND component IS NOT NULL) WHERE rn <= 5 GROUP BY component),
    res AS (SELECT component, count(*) FILTER (WHERE status IN ('resolved', 'closed')) * 100.0 / count(*) AS rate FROM tickets t JOIN docs d ON d.id = t.source_document_id
    WHERE {_in(PERIOD, 'd.created_at')} GROUP BY component),
    components AS (SELECT component, cur AS total_feedback, cur_high AS high_priority_count, mean AS avg_priority_score, prev,
    titles, coalesce(rate, 0) AS resolution_rate FROM comp LEFT JOIN titles USING (component) LEFT JOIN res USING (component) WHERE component IS NOT NULL AND cur > 0) """

@plan(
    "d10_components",
    COMPONENTS + """SELECT component, total_feedback, high_priority_count, round(avg_priority_score, 6) AS avg_priority_score, prev AS previous_count,
    round(resolution_rate, 6) AS resolution_rate FROM components""",
)
def _(spark, sf):
    return digest(spark, sf).components().select(
        "component", "total_feedback", "high_priority_count", F.round("avg_priority_score", 6).alias("avg_priority_score"),
        F.col("previous_value").cast("bigint").alias("previous_count"), F.round("resolution_rate", 6).alias("resolution_rate"),
    )

@plan("f07_components_by_volume", COMPONENTS + "SELECT row_number() OVER (ORDER BY total_feedback DESC, component) AS place, component, total_feedback FROM components")
def _(spark, sf):
    from pyspark.sql import Window as W

    rows = digest(spark, sf).components().select("component", "total_feedback")
    place = F.row_number().over(W.orderBy(F.col("total_feedback").desc(), "component"))
    return rows.withColumn("place", place.cast("bigint"))

@plan("f08_component_titles", COMPONENTS + "SELECT component, titles FROM titles")
def _(spark, sf):
    return A.component_titles(T.documents(spark, sf), PERIOD).select("component", F.array_join("top_issues", "|").alias("titles"))

@plan(
    "c01_high_priority_count",
    with_tables("docs", "scores") + f"SELECT count(*) AS documents FROM docs JOIN scores ON id = document_id WHERE {_in(PERIOD, 'docs.created_at')} AND priority_score >= 0.7",
)
def _(spark, sf):
    return digest(spark, sf)._counts(high="documents").select(F.col("value").cast("bigint").alias("documents"))

@plan(
    "c05_component_scores",
    with_tables("docs", "scores")
    + f"""SELECT component, count(*) AS documents, count(priority_score) AS scored, round(coalesce(avg(priority_score), 0), 6) AS mean
    FROM docs LEFT JOIN scores ON document_id = id WHERE {_in(PERIOD, 'docs.created_at')} AND component IS NOT NULL GROUP BY component""",
)
def _(spark, sf):
    docs, scores, *_ = _four(spark, sf)
    parts = A.component_activity(docs, scores, PERIOD, _BEFORE).where("component IS NOT NULL AND cur > 0")
    mean = F.coalesce(F.col("score_sum") / F.nullif(F.col("scored"), F.lit(0)), F.lit(0.0))
    return parts.select("component", F.col("cur").alias("documents"), "scored", F.round(mean, 6).alias("mean"))

@plan(
    "c07_component_periods",
    with_tables("docs") + f"SELECT component, count(*) FILTER (WHERE {NOW}) AS current_count, count(*) FILTER (WHERE {PREV}) AS previous_count FROM docs WHERE component IS NOT NULL AND ({NOW} OR {PREV}) GROUP BY component",
)
def _(spark, sf):
    docs, scores, *_ = _four(spark, sf)
    parts = A.component_activity(docs, scores, PERIOD, _BEFORE).where("component IS NOT NULL")
    return parts.select("component", F.col("cur").alias("current_count"), F.col("prev").alias("previous_count"))

@plan(
    "c04_source_distribution",
    with_tables("raw") + "SELECT source_type, count(*) AS documents FROM labels JOIN raw ON raw.id = labels.doc_id GROUP BY source_type",
)
def _(spark, sf):
    docs = T.read(spark, sf, "labels").select(F.col("doc_id").alias("raw_feedback_id"))
    return A.source_distribution(docs, T.raw_feedback(spark, sf))

_CL = f"SELECT * FROM clusters WHERE {NOW}"

@plan(
    "d12_cluster_analysis",
    with_tables("docs", "clusters")
    + f"""SELECT count(*) AS total_clusters, round(coalesce(avg(member_count), 0), 6) AS avg_cluster_size, arg_max(title, member_count * 1000000 - id) AS largest,
    max(member_count) AS largest_size, round(coalesce(count(*) / sum(member_count) * 100, 0), 6) AS efficiency,
    coalesce((SELECT string_agg(id, ',' ORDER BY member_count DESC, id) FROM (FROM ({_CL}) ORDER BY member_count DESC, id LIMIT 5)), '') AS top FROM ({_CL})""",
)
def _(spark, sf):
    facts = A.analyze_clusters(T.clusters(spark, sf), PERIOD)
    return facts.select(
        "total_clusters", F.round("avg_cluster_size", 6).alias("avg_cluster_size"), F.col("largest_cluster.title").alias("largest"),
        F.col("largest_cluster.size").alias("largest_size"), F.round("clustering_efficiency", 6).alias("efficiency"),
        F.array_join(F.transform("top_clusters", lambda c: c["id"].cast("string")), ",").alias("top"),
    )

_PCT = lambda n: f"round(count(*) FILTER (WHERE {n}) * 100.0 / count(*), 1)"

@plan(
    "d08_priority_distribution",
    with_tables("scores")
    + f"""SELECT count(*) FILTER (WHERE priority_level = 5) AS critical, count(*) FILTER (WHERE priority_level = 4) AS high,
    count(*) FILTER (WHERE priority_level = 3) AS medium, count(*) FILTER (WHERE priority_level <= 2) AS low,
    {_PCT('priority_level = 5')} AS critical_percentage, {_PCT('priority_level = 4')} AS high_percentage,
    {_PCT('priority_level = 3')} AS medium_percentage, {_PCT('priority_level <= 2')} AS low_percentage FROM scores WHERE {NOW}""",
)
def _(spark, sf):
    return A.priority_distribution(T.scores(spark, sf), PERIOD).drop("total")

_KINDS = ["bug", "feature_request", "performance", "other"]

@plan(
    "d09_classification_breakdown",
    with_tables("docs") + "SELECT " + ", ".join(
        [f"count(*) FILTER (WHERE feedback_type = '{k}') AS {k}" for k in _KINDS] + [_PCT(f"feedback_type = '{k}'") + f" AS {k}_percentage" for k in _KINDS]
    ) + f" FROM docs WHERE feedback_type IS NOT NULL AND {NOW}",
)
def _(spark, sf):
    return A.classification_breakdown(T.documents(spark, sf), PERIOD).drop("total")

@plan(
    "d11_resolution_rate",
    TRENDS + "SELECT cur AS tickets, round(CASE WHEN cur > 0 THEN cd / cur * 100 ELSE 0 END, 6) AS resolution_rate FROM tk",
)
def _(spark, sf):
    facts = A.ticket_activity(T.tickets(spark, sf), PERIOD, _BEFORE)
    return facts.select(F.col("cur").alias("tickets"), F.round("cur_rate", 6).alias("resolution_rate"))

@plan(
    "d15_processing_funnel",
    with_tables("docs", "scores", "tickets")
    + f"""SELECT count(*) AS total_processed, count(feedback_type) AS classified_count, count(cluster_id) AS clustered_count, count(s.document_id) AS prioritized_count,
    round(count(feedback_type) * 100.0 / count(*), 1) AS classification_rate, round(count(cluster_id) * 100.0 / count(*), 1) AS clustering_rate,
    round(count(s.document_id) * 100.0 / count(*), 1) AS prioritization_rate, (SELECT count(*) FROM tickets WHERE {NOW}) AS tickets_created
    FROM docs d LEFT JOIN scores s ON s.document_id = d.id WHERE {_in(PERIOD, 'd.created_at')}""",
)
def _(spark, sf):
    docs, scores, tickets, _ = _four(spark, sf)
    return A.processing_funnel(docs, scores, tickets, PERIOD)

def _titles_sql(least: float, limit: int) -> str:
    return with_tables("docs", "scores") + f"""SELECT id, title, priority_score FROM docs d JOIN scores s ON s.document_id = d.id
        WHERE {_in(PERIOD, 'd.created_at')} AND priority_score >= {least} ORDER BY priority_score DESC, id LIMIT {limit}"""

@plan("f04_top_priorities", _titles_sql(0.7, 5))
def _(spark, sf):
    docs, scores, *_ = _four(spark, sf)
    return A.high_titles(docs, scores, PERIOD, 0.7, 5)

@plan("f05_critical_issues", _titles_sql(0.9, 5))
def _(spark, sf):
    docs, scores, *_ = _four(spark, sf)
    return A.high_titles(docs, scores, PERIOD, 0.9, 5)

@plan("f05_critical_alerts", _titles_sql(0.95, 3))
def _(spark, sf):
    docs, scores, *_ = _four(spark, sf)
    return A.high_titles(docs, scores, PERIOD, 0.95, 3)

@plan(
    "f06_top_components",
    with_tables("docs") + f"SELECT component, count(*) AS items FROM docs WHERE {NOW} AND component IS NOT NULL GROUP BY component ORDER BY items DESC, component LIMIT 5",
)
def _(spark, sf):
    return A.top_components(T.documents(spark, sf), PERIOD)

@plan("d26_type_counts", with_tables("docs") + "SELECT feedback_type, count(*) AS documents FROM docs GROUP BY feedback_type")
def _(spark, sf):
    return T.documents(spark, sf).groupBy("feedback_type").agg(F.count("*").alias("documents"))

@plan(
    "d25_table_counts",
    with_tables("raw", "docs", "clusters", "tickets")
    + 'SELECT \'feedback\' AS "table", count(*) AS rows FROM raw UNION ALL SELECT \'clusters\', count(*) FROM clusters UNION ALL SELECT \'tickets\', count(*) FROM tickets',
)
def _(spark, sf):
    return A.table_counts(feedback=T.raw_feedback(spark, sf), clusters=T.clusters(spark, sf), tickets=T.tickets(spark, sf))

@plan(
    "g11_report_periods",
    """SELECT o_orderkey AS id, (o_orderdate - INTERVAL 1 HOUR)::VARCHAR AS hourly, (o_orderdate - INTERVAL 1 DAY)::VARCHAR AS daily,
    (o_orderdate - INTERVAL 7 DAY)::VARCHAR AS weekly, (o_orderdate - INTERVAL 30 DAY)::VARCHAR AS monthly FROM orders""",
)
def _(spark, sf):
    text = lambda k: F.date_format(A.report_start(k, F.col("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias(k)
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *[text(k) for k in ("hourly", "daily", "weekly", "monthly")])


@plan(
    "k03_sliding_week_trend",
    """WITH e AS (SELECT CAST(ts AS DATE) AS d FROM events), w AS (SELECT d + CAST(i AS INTEGER) AS window_end, count(*) AS n FROM e, range(1, 8) r(i) GROUP BY 1)
    SELECT CAST(a.window_end AS VARCHAR) AS window_end, a.n AS current_count, b.n AS previous_count, CASE WHEN (a.n - b.n) * 100.0 / b.n >= 5 THEN 'up'
    WHEN (a.n - b.n) * 100.0 / b.n <= -5 THEN 'down' ELSE 'stable' END AS trend_direction FROM w a JOIN w b ON b.window_end = a.window_end - 7""",
)
def _(spark, sf):
    # pre-aggregated sliding windows; a week is compared with the week before by its end
    windows = T.read(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "7 days", "1 day")).agg(F.count("*").alias("n"))
    now = windows.select(F.to_date("window.end").alias("window_end"), F.col("n").alias("current_count"))
    before = windows.select(F.date_add(F.to_date("window.end"), 7).alias("window_end"), F.col("n").alias("previous_count"))
    rows = now.join(before, "window_end").select(
        F.col("window_end").cast("string").alias("window_end"), "current_count", "previous_count",
        F.col("current_count").cast("double").alias("current_value"), F.col("previous_count").cast("double").alias("previous_value"),
    )
    return A.with_trend(rows).select("window_end", "current_count", "previous_count", "trend_direction")

# --- insights and reports --------------------------------------------------------------
_PCT1 = "printf('%.1f', abs(change_percentage))"
INSIGHTS = COMPONENTS.rstrip() + f""", cl AS ({_CL}), cf AS (SELECT count(*) AS total, coalesce(avg(member_count), 0) AS mean, max(member_count) AS largest,
    arg_max(title, member_count * 1000000 - id) AS title, coalesce(count(*) / sum(member_count) * 100, 0) AS eff FROM cl),
    top AS (SELECT * FROM components ORDER BY total_feedback DESC, component LIMIT 1),
    insights AS (SELECT 1 AS rule_no, rule_no || ' ' || metric AS subject, CASE WHEN trend_direction = 'up' THEN '🚨 ' || metric || ' has increased significantly by ' || {_PCT1} || '% - requires immediate attention'
    ELSE '✅ ' || metric || ' has decreased by ' || {_PCT1} || '% - positive trend' END AS insight FROM trends WHERE significance = 'high' AND trend_direction <> 'stable'
    UNION ALL SELECT 2, '', '🔧 ' || component || ' is the most affected component with ' || total_feedback || ' feedback items' FROM top WHERE total_feedback > 10
    UNION ALL SELECT 3, '', '⚠️ ' || count(*) || ' components have high priority issues requiring immediate attention' FROM components WHERE high_priority_count > 5 AND total_feedback > 10 HAVING count(*) > 0
    UNION ALL SELECT 4, '', '📊 Average cluster size is ' || printf('%.1f', mean) || ' - good clustering efficiency' FROM cf WHERE total > 0 AND mean > 5
    UNION ALL SELECT 5, '', '🔍 Large cluster detected: ' || title || ' with ' || largest || ' items - consider breaking down into sub-issues' FROM cf WHERE largest > 10
    UNION ALL SELECT 6, '', '🚨 High priority feedback is increasing - consider increasing development resources' FROM trends WHERE significance = 'high' AND trend_direction = 'up' HAVING count(*) > 0
    UNION ALL SELECT 7, '', '🔧 Focus on ' || component || ' - has ' || high_priority_count || ' high-priority issues' FROM top WHERE high_priority_count > 10
    UNION ALL SELECT 8, '', '🔍 Large clusters detected - consider breaking down into smaller, more specific issues' FROM cf WHERE mean > 8
    UNION ALL SELECT 9, '', '📊 Low clustering efficiency - review clustering parameters and feedback quality' FROM cf WHERE eff < 10) """

@plan("h66_insights", INSIGHTS + "SELECT rule_no, subject, insight FROM insights")
def _(spark, sf):
    return digest(spark, sf).insights()

@plan(
    "h62_trend_sentence",
    TRENDS + """SELECT string_agg(metric || CASE WHEN trend_direction = 'up' THEN ' increased by ' ELSE ' decreased by ' END || printf('%.1f', abs(change_percentage)) || '%', '; ' ORDER BY rule_no, metric) AS trend_analysis,
    (SELECT count(*) || ' significant trend(s) detected.' FROM trends WHERE significance <> 'low') AS trends,
    (SELECT 'Previous day: ' || count(*) FILTER (WHERE trend_direction = 'up') || ' increasing trends, ' || count(*) FILTER (WHERE trend_direction = 'down') || ' decreasing trends.' FROM trends) AS trend_comparison
    FROM (SELECT * FROM trends ORDER BY rule_no, metric LIMIT 3)""",
)
def _(spark, sf):
    trends = digest(spark, sf).trends()
    parts = [R.trend_sentence(trends), R.trend_summary(trends), R.trend_comparison(trends)]
    return R.one_row(parts, ["trend_analysis", "trends", "trend_comparison"])

_EXEC_COUNTS = f"""(SELECT count(*) FROM docs WHERE {NOW})::VARCHAR AS total_feedback,
    (SELECT count(*) FROM ds WHERE {NOW} AND priority_score >= 0.7)::VARCHAR AS high_priority_count"""

@plan(
    "d14_executive_report",
    INSIGHTS + f"""SELECT {_EXEC_COUNTS}, (SELECT cur FROM tk)::VARCHAR AS tickets_created,
    (SELECT string_agg('<li>' || insight || '</li>', chr(10) ORDER BY rule_no, subject) FROM (SELECT * FROM insights ORDER BY rule_no, subject LIMIT 5)) AS key_insights,
    (SELECT string_agg('<li>' || component || ': ' || total_feedback || ' items</li>', chr(10) ORDER BY total_feedback DESC, component) FROM (SELECT * FROM components ORDER BY total_feedback DESC, component LIMIT 5)) AS top_components,
    coalesce((SELECT string_agg('<li>' || insight || '</li>', chr(10) ORDER BY rule_no, subject) FROM (SELECT * FROM insights ORDER BY rule_no, subject LIMIT 5 OFFSET 5)), '') AS recommendations""",
)
def _(spark, sf):
    return digest(spark, sf).executive().select(
        "total_feedback", "high_priority_count", "tickets_created", "key_insights", "top_components", "recommendations"
    )

@plan(
    "d15_technical_report",
    with_tables("docs", "scores", "tickets", "clusters")
    + f"""SELECT (SELECT count(*) FROM docs WHERE {NOW})::VARCHAR AS total_processed, (SELECT count(cluster_id) FROM docs WHERE {NOW})::VARCHAR AS clustered_count,
    (SELECT count(*) FROM clusters WHERE {NOW})::VARCHAR AS cluster_count, (SELECT count(*) FROM docs WHERE {NOW} AND feedback_type = 'bug')::VARCHAR AS bug_count,
    coalesce((SELECT string_agg('• ' || title || ': ' || member_count || ' items', chr(10) ORDER BY member_count DESC, id) FROM (FROM clusters WHERE {NOW} ORDER BY member_count DESC, id LIMIT 5)), 'No clusters found.') AS top_clusters,
    (SELECT string_agg('• ' || component || ': ' || n || ' items', chr(10) ORDER BY n DESC, component) FROM (SELECT component, count(*) AS n FROM docs WHERE {NOW} AND component IS NOT NULL GROUP BY 1 ORDER BY n DESC, component LIMIT 5)) AS component_analysis""",
)
def _(spark, sf):
    return digest(spark, sf).technical().select("total_processed", "clustered_count", "cluster_count", "bug_count", "top_clusters", "component_analysis")

_LAST_HOUR = A.Period("1998-08-02 00:00:00", "1998-08-02 01:00:00")
_DAY = A.Period("1998-08-01 00:00:00", "1998-08-02 00:00:00")

@plan(
    "d16_hourly_digest",
    with_tables("docs", "scores", "tickets")
    + f"""SELECT '00:00' AS hour, (SELECT count(*) FROM docs WHERE {_in(_LAST_HOUR)})::VARCHAR AS new_feedback_count, (SELECT count(*) FROM tickets WHERE {_in(_LAST_HOUR)})::VARCHAR AS tickets_created,
    coalesce((SELECT string_agg('• ' || title, chr(10) ORDER BY priority_score DESC, id) FROM (SELECT d.*, priority_score FROM docs d JOIN scores s ON document_id = id WHERE {_in(_LAST_HOUR, 'd.created_at')} AND priority_score >= 0.7 ORDER BY priority_score DESC, id LIMIT 5)), '') AS top_priorities""",
)
def _(spark, sf):
    return digest(spark, sf, _LAST_HOUR).hourly().select("hour", "new_feedback_count", "tickets_created", "top_priorities")

@plan(
    "d17_daily_digest",
    with_tables("docs", "scores", "tickets")
    + f"""SELECT '1998-08-01' AS date, (SELECT count(*) FROM docs WHERE {_in(_DAY)})::VARCHAR AS total_feedback, (SELECT count(*) FROM tickets WHERE {_in(_DAY)})::VARCHAR AS tickets_created,
    (SELECT count(*) FROM tickets WHERE {_in(_DAY)} AND status IN ('resolved', 'closed'))::VARCHAR AS resolved_tickets,
    (SELECT count(*) FROM scores WHERE {_in(_DAY)} AND priority_level = 5)::VARCHAR AS critical_count""",
)
def _(spark, sf):
    return digest(spark, sf, _DAY).daily().select("date", "total_feedback", "tickets_created", "resolved_tickets", "critical_count")

@plan(
    "d18_daily_totals",
    with_tables("docs", "scores", "tickets")
    + f"""SELECT (SELECT count(*) FROM docs WHERE {_in(_DAY)})::VARCHAR AS total_feedback, (SELECT count(*) FROM docs d JOIN scores s ON document_id = id WHERE {_in(_DAY, 'd.created_at')} AND priority_score >= 0.7)::VARCHAR AS high_priority,
    (SELECT count(*) FROM tickets WHERE {_in(_DAY)} AND status IN ('resolved', 'closed'))::VARCHAR AS resolved""",
)
def _(spark, sf):
    return digest(spark, sf, _DAY).daily_totals().select("total_feedback", "high_priority", "resolved")

@plan(
    "h63_component_breakdown",
    COMPONENTS + """SELECT string_agg('• ' || component || ': ' || total_feedback || ' items (' || high_priority_count || ' high-priority)', chr(10) ORDER BY total_feedback DESC, component) AS component_breakdown
    FROM (SELECT * FROM components ORDER BY total_feedback DESC, component LIMIT 5)""",
)
def _(spark, sf):
    return digest(spark, sf).daily().select("component_breakdown")

@plan(
    "h64_report_texts",
    with_tables("docs")
    + f"""SELECT format, contains(content, n::VARCHAR) AS has_total FROM (SELECT unnest(['html', 'markdown', 'text', 'json']) AS format, n::VARCHAR AS content, n FROM (SELECT count(*) AS n FROM docs WHERE {NOW}))""",
)
def _(spark, sf):
    out = None
    for fmt in ("html", "markdown", "text", "json"):
        data = digest(spark, sf).technical()
        row = R.render(data, "technical", fmt).select(F.lit(fmt).alias("format"), F.col("content").contains(F.col("total_processed")).alias("has_total"))
        out = row if out is None else out.unionByName(row)
    return out

@plan(
    "h65_report_summary",
    with_tables("docs", "tickets")
    + f"""SELECT 'daily' AS report_type, 'Daily Summary - 1998-08-02 00:00' AS title, 'Daily summary: ' || (SELECT count(*) FROM docs WHERE {_in(_DAY)}) || ' feedback items, '
    || (SELECT count(*) FROM tickets WHERE {_in(_DAY)}) || ' tickets created, ' || (SELECT count(*) FROM tickets WHERE {_in(_DAY)} AND status IN ('resolved', 'closed')) || ' resolved.' AS summary""",
)
def _(spark, sf):
    return R.report_rows(digest(spark, sf, _DAY), "daily").select("report_type", "title", "summary")

@plan(
    "h67_trend_alerts",
    TRENDS + """SELECT metric AS subject, CASE WHEN abs(change_percentage) >= 50 THEN 'high' WHEN abs(change_percentage) >= 20 THEN 'medium' ELSE 'low' END AS priority
    FROM trends WHERE significance = 'high' AND trend_direction = 'up'""",
)
def _(spark, sf):
    return R.trend_alerts(digest(spark, sf).trends()).select("subject", "priority")

@plan(
    "h68_critical_messages",
    with_tables("docs", "scores")
    + f"""SELECT CAST(id AS VARCHAR) AS subject, '🚨 CRITICAL ALERT: ' || title || chr(10) || 'Priority: critical' || chr(10) || 'Component: ' || coalesce(component, 'unknown') || chr(10)
    || 'Impact: score ' || printf('%.2f', priority_score) || chr(10) || 'Next Steps: review and assign' AS message
    FROM docs d JOIN scores s ON document_id = id WHERE {_in(PERIOD, 'd.created_at')} AND priority_score >= 0.95""",
)
def _(spark, sf):
    docs, scores, *_ = _four(spark, sf)
    return R.critical_alerts(docs, scores, PERIOD).select("subject", "message")

@plan("a22_expired_reports", f"SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def _(spark, sf):
    reports = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return R.expired(reports, F.lit(AS_OF).cast("timestamp_ntz")).select("id")


# a report for each month and order status: the table that listings and files need
_REPORT_TYPES = {"F": "daily", "O": "hourly", "P": "executive"}
REPORTS = """WITH reports AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'daily' WHEN 'O' THEN 'hourly' ELSE 'executive' END AS report_type,
    date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS period_end, count(*) AS n FROM orders GROUP BY ALL),
    texts AS (SELECT *, 'Orders to ' || strftime(period_end, '%Y-%m-%d') AS title, '# Orders' || chr(10) || chr(10) || n || ' items' || chr(10) || 'to ' || strftime(period_end, '%Y-%m-%d') AS content FROM reports) """


def _reports(spark, sf):
    end = F.add_months(F.trunc("o_orderdate", "month"), 1)
    kind = F.create_map(*[F.lit(x) for pair in _REPORT_TYPES.items() for x in pair])[F.col("o_orderstatus")]
    counted = T.read(spark, sf, "orders").groupBy(kind.alias("report_type"), end.alias("day")).agg(F.count("*").alias("n"))
    day = F.date_format("day", "yyyy-MM-dd")
    return counted.select(
        "report_type", F.col("day").cast("timestamp_ntz").alias("period_end"), F.concat(F.lit("Orders to "), day).alias("title"),
        F.concat(F.lit("# Orders\n\n"), F.col("n").cast("string"), F.lit(" items\nto "), day).alias("content"), F.lit("markdown").alias("format"),
    )


@plan(
    "a21_report_files",
    REPORTS + "SELECT report_type || '_' || strftime(period_end, '%Y%m%d_%H%M%S') AS report, 'markdown' AS format, content FROM texts",
)
def _(spark, sf):
    import uuid

    from echoloom.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/reports/{uuid.uuid4().hex}"
    R.save_reports(_reports(spark, sf), path)
    return R.read_reports(spark, path)


@plan(
    "b19_report_listing",
    REPORTS + "SELECT report_type, title, content, (SELECT count(*) FROM texts WHERE report_type = 'daily') AS total FROM texts WHERE report_type = 'daily' ORDER BY period_end DESC, title LIMIT 10 OFFSET 10",
)
def _(spark, sf):
    return L.list_reports(_reports(spark, sf), "daily", number=2, size=10).select("report_type", "title", "content", "total")


@plan("a18_write_documents", with_tables("docs") + "SELECT id, title, md5(body) AS body_md5, author, source_type, processing_status, language, word_count FROM docs")
def _(spark, sf):
    """Documents written by source and read back."""
    import uuid

    from echoloom.session import ensure_checkpoint_dir
    from echoloom.sources import canonical

    path = f"{ensure_checkpoint_dir(spark)}/documents/{uuid.uuid4().hex}"
    docs = T.documents(spark, sf)
    canonical.append_documents(docs, path)
    back = spark.read.schema(docs.schema).parquet(path)
    return back.select("id", "title", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), "author", "source_type", "processing_status", "language", "word_count")
