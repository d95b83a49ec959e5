"""Reply parsing and classification plans. Replies are derived from documents, one per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import replies as R
from echoloom.operators import classify
from echoloom.operators.ordering import global_rank
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.scoring import case, contained
from echoloom.plans.tables import with_tables

_TYPES = K.FEEDBACK_TYPES + ["Bug report", "a new FEATURE", "slow page", "connect to api", "design", "no idea", ""]
_LEVELS = K.SEVERITY_LEVELS + ["urgent!!", "Important", "normal-ish", "trivial", "?", ""]
_COMPONENTS = K.COMPONENTS + ["Login page", "db layer", "checkout", "home screen", "config", "phone", "pc client", "??", ""]


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Every 7th reply has a trailing comma, every 11th single quotes, every 13th no JSON at all.
_FIELDS = f"""o_orderkey AS id, {_sql_list(_TYPES)}[o_orderkey % {len(_TYPES)} + 1] AS t, {_sql_list(_LEVELS)}[o_orderkey % {len(_LEVELS)} + 1] AS s,
    {_sql_list(_COMPONENTS)}[o_custkey % {len(_COMPONENTS)} + 1] AS c, o_orderkey % 13 = 12 AS bare, o_orderkey % 5 = 4 AS short,
    (o_orderkey % 10) / 10.0 AS tc, (o_orderkey % 7) / 5.0 AS sc, (o_custkey % 10) / 10.0 AS cc"""
FIELDS_SQL = f"SELECT {_FIELDS} FROM orders"


def reply_table(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    tenth = lambda k, m, d: ((k % m).cast("double") / F.lit(float(d))).cast("string")
    pair = lambda name, value: F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))
    number = lambda name, value: F.concat(F.lit(f', "{name}": '), value)
    labels = F.concat(
        pair("feedback_type", pick(_TYPES, key)), F.lit(", "), pair("severity_level", pick(_LEVELS, key)), F.lit(", "),
        pair("component", pick(_COMPONENTS, cust)),
    )
    confidences = F.concat(
        number("type_confidence", tenth(key, 10, 10)), number("severity_confidence", tenth(key, 7, 5)),
        number("component_confidence", tenth(cust, 10, 10)),
    )
    body = F.concat(F.lit("{"), labels, F.when(key % 5 == 4, F.lit("")).otherwise(confidences), F.when(key % 7 == 6, ",").otherwise(""), F.lit("}"))
    body = F.when(key % 11 == 10, F.replace(body, F.lit('"'), F.lit("'"))).otherwise(body)
    reply = F.when(key % 13 == 12, F.lit("I cannot say.")).otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone.")))
    return T.read(spark, sf, "orders").select(key.alias("id"), reply.alias("reply"))


def _label_sql(value: str, allowed, rules, default: str) -> str:
    v = f"trim(lower({value}))"
    return f"CASE WHEN {v} IN ({', '.join(repr(a) for a in allowed)}) THEN {v} WHEN {v} = '' THEN '{default}' ELSE {contained(v, rules, default)} END"


_T = _label_sql("t", K.FEEDBACK_TYPES, K.TYPE_RULES, "other")
_S = _label_sql("s", K.SEVERITY_LEVELS, K.SEVERITY_RULES, "medium")
_C = _label_sql("c", K.COMPONENTS, K.COMPONENT_RULES, "other")
CLASSIFIED_SQL = f"""WITH f AS ({FIELDS_SQL}), l AS (SELECT id, {_T} AS feedback_type, {_S} AS raw_severity, {_C} AS component,
    CAST(CASE WHEN short THEN 0.5 ELSE tc END AS DOUBLE) AS type_confidence, CAST(CASE WHEN short THEN 0.5 ELSE sc END AS DOUBLE) AS raw_conf,
    CAST(CASE WHEN short THEN 0.5 ELSE cc END AS DOUBLE) AS component_confidence FROM f WHERE NOT bare),
    a AS (SELECT *, CASE WHEN feedback_type = 'feature_request' AND raw_severity IN ('critical', 'high') THEN 'medium'
    WHEN feedback_type = 'bug' AND raw_severity = 'minimal' THEN 'low' ELSE raw_severity END AS severity_level,
    CASE WHEN feedback_type = 'feature_request' AND raw_severity IN ('critical', 'high') THEN least(raw_conf, 0.7)
    WHEN feedback_type = 'bug' AND raw_severity = 'minimal' THEN least(raw_conf, 0.6) ELSE raw_conf END AS severity_confidence FROM l),
    classified AS (SELECT *, (type_confidence + severity_confidence + component_confidence) / 3 AS overall_confidence,
    {case('severity_level', K.SEVERITY_SCORES, 0.5)} AS severity_score FROM a) """


def classified(spark, sf):
    return classify.classify_replies(reply_table(spark, sf))


@plan(
    "h24_json_span",
    f"SELECT id, NOT bare AS has_json FROM ({FIELDS_SQL})",
)
def _(spark, sf):
    return reply_table(spark, sf).select("id", (R.json_span(F.col("reply")) != "").alias("has_json"))


@plan("h25_repair_json", f"SELECT id, t AS feedback_type, s AS severity_level FROM ({FIELDS_SQL}) WHERE NOT bare")
def _(spark, sf):
    df = R.parse_columns(reply_table(spark, sf), "reply").where("reply_json IS NOT NULL")
    return df.select("id", "reply_json.feedback_type", "reply_json.severity_level")


@plan("h26_feedback_type", f"SELECT id, {_T} AS feedback_type FROM ({FIELDS_SQL}) WHERE NOT bare")
def _(spark, sf):
    return classified(spark, sf).select("id", "feedback_type")


def _labelled(spark, sf, values, key, fn, name):
    pick = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), fn(pick).alias(name))


@plan("h27_severity_level", f"SELECT id, {_S} AS severity_level FROM ({FIELDS_SQL})")
def _(spark, sf):
    return _labelled(spark, sf, _LEVELS, "o_orderkey", R.severity_level, "severity_level")


@plan("h28_component", f"SELECT id, {_C} AS component FROM ({FIELDS_SQL})")
def _(spark, sf):
    return _labelled(spark, sf, _COMPONENTS, "o_custkey", R.component, "component")


@plan(
    "h29_classify_replies",
    CLASSIFIED_SQL
    + """SELECT id, feedback_type, severity_level, component, type_confidence, severity_confidence, component_confidence,
    round(overall_confidence, 6) AS overall_confidence, severity_score FROM classified""",
)
def _(spark, sf):
    return classified(spark, sf).select(
        "id", "feedback_type", "severity_level", "component", "type_confidence", "severity_confidence",
        "component_confidence", F.round("overall_confidence", 6).alias("overall_confidence"), "severity_score",
    )


@plan(
    "h30_adjusted_replies",
    CLASSIFIED_SQL + "SELECT id, raw_severity, severity_level, severity_confidence FROM classified WHERE raw_severity <> severity_level",
)
def _(spark, sf):
    return classify.adjusted_replies(reply_table(spark, sf))


_ERRORS = ", ".join(
    [f"CASE WHEN NOT ({c} BETWEEN 0 AND 1) THEN '{n} confidence must be between 0.0 and 1.0' END" for n, c in (
        ("Type", "type_confidence"), ("Severity", "severity_confidence"), ("Component", "component_confidence"), ("Overall", "overall_confidence"))]
    + [
        "CASE WHEN overall_confidence < 0.3 THEN 'Overall confidence is very low, consider manual review' END",
        "CASE WHEN feedback_type = 'bug' AND severity_level = 'minimal' THEN 'Bug reports should not be minimal severity' END",
        "CASE WHEN feedback_type = 'feature_request' AND severity_level = 'critical' THEN 'Feature requests should not be critical severity' END",
    ]
)


@plan(
    "h31_validation",
    CLASSIFIED_SQL + f"SELECT id, array_to_string(list_filter([{_ERRORS}], lambda x: x IS NOT NULL), '|') AS errors FROM (SELECT * REPLACE (round(overall_confidence, 9) AS overall_confidence) FROM classified)",
)
def _(spark, sf):
    df = classified(spark, sf).withColumn("o", F.round("overall_confidence", 9))
    errors = R.validation_errors(
        F.col("feedback_type"), F.col("severity_level"), F.col("type_confidence"), F.col("severity_confidence"),
        F.col("component_confidence"), F.col("o"),
    )
    return df.select("id", F.array_join(errors, "|").alias("errors"))


@plan("h32_severity_to_score", with_tables("docs") + f"SELECT id, {case('severity', K.SEVERITY_SCORES, 0.5)} AS score FROM docs")
def _(spark, sf):
    return T.documents(spark, sf).select("id", R.severity_to_score(F.col("severity")).alias("score"))


_BATCH = 20


@plan(
    "h33_batch_alignment",
    f"SELECT id, t AS feedback_type FROM ({FIELDS_SQL})",
)
def _(spark, sf):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    key = F.col("o_orderkey")
    ranked = global_rank(T.read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    place = F.col("rank") - 1
    placed = ranked.select(
        key.alias("id"), F.floor(place / _BATCH).alias("batch_id"), (place % _BATCH).cast("int").alias("pos"), pick(_TYPES, key).alias("feedback_type")
    )
    item = F.struct("pos", F.struct("feedback_type", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("item_id")).alias("r"))
    replies = placed.groupBy("batch_id").agg(
        F.concat(F.lit("Result: "), F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]))).alias("reply")
    )
    out = classify.align_batch_replies(placed.select("batch_id", "pos", "id"), replies)
    return out.select("id", "item.feedback_type")


@plan(
    "h34_prompt_batches",
    with_tables("docs") + f"SELECT batch_id, count(*) AS items, min(id)::VARCHAR AS first_item FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // {_BATCH} AS batch_id FROM docs) GROUP BY 1",
)
def _(spark, sf):
    out = classify.render_batches(T.documents(spark, sf), _BATCH)
    return out.select("batch_id", "items", F.get_json_object("feedback_items", "$[0].item_id").alias("first_item"))


@plan(
    "h34_prompts",
    with_tables("docs") + "SELECT id, contains(title, 'Report') AS titled, coalesce(author, 'unknown') AS author FROM docs",
)
def _(spark, sf):
    out = classify.render_prompts(T.documents(spark, sf))
    return out.select(
        "id", F.col("prompt").contains("Title: Report").alias("titled"), F.regexp_extract("prompt", r"\nAuthor: (.*)\n", 1).alias("author")
    )


@plan(
    "h36_attach_classification",
    CLASSIFIED_SQL.rstrip() + ", " + with_tables("docs")[5:]
    + """SELECT d.id, coalesce(c.feedback_type, d.feedback_type) AS feedback_type, coalesce(c.component, d.component) AS component,
    c.severity_score, round(c.overall_confidence, 6) AS confidence_score, c.type_confidence FROM docs d LEFT JOIN classified c ON c.id = d.id""",
)
def _(spark, sf):
    out = classify.attach(T.documents(spark, sf), classified(spark, sf))
    return out.select(
        "id", "feedback_type", "component", "severity_score", F.round("confidence_score", 6).alias("confidence_score"),
        F.col("classification_metadata.type_confidence").alias("type_confidence"),
    )


@plan("b09_unclassified", with_tables("docs") + "SELECT id FROM docs WHERE feedback_type IS NULL")
def _(spark, sf):
    return classify.unclassified(T.documents(spark, sf)).select("id")


_AGG = "count(*) AS total, count(*) FILTER (WHERE round(overall_confidence, 9) > 0.5) AS successful, round(avg(overall_confidence), 6) AS average_confidence"


@plan(
    "d04_classification_metrics",
    CLASSIFIED_SQL
    + f"""SELECT 'all' AS dimension, '' AS value, {_AGG} FROM classified UNION ALL SELECT 'type', feedback_type, {_AGG} FROM classified GROUP BY feedback_type
    UNION ALL SELECT 'severity', severity_level, {_AGG} FROM classified GROUP BY severity_level
    UNION ALL SELECT 'component', component, {_AGG} FROM classified GROUP BY component""",
)
def _(spark, sf):
    df = classified(spark, sf).withColumn("overall_confidence", F.round("overall_confidence", 9))
    out = classify.classification_metrics(df)
    return out.select("dimension", "value", "total", "successful", F.round("average_confidence", 6).alias("average_confidence"))
