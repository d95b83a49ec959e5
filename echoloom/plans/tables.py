"""The engine's tables derived from the given parquet tables, once in Spark and once in SQL.

Only integer arithmetic is used, so both sides hold the same rows. `with_tables("docs", …)`
gives the WITH clause an oracle starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom import constants as K

AS_OF = "1998-08-02 00:00:00"
PERIOD_START = "1998-07-03 00:00:00"  # a 30 day period that ends at AS_OF


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of `orders` that one task turns into texts; a scan has about as many splits as the cluster has slots, whatever its size.
TASK_ROWS = 250_000


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Use all cores on a table whose scan has fewer splits than the cluster has slots, or than `task_rows` asks for.

    Only CPU-heavy text jobs ask for it; a table with enough splits is left alone.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        tasks = max(tasks, -(-df.count() // task_rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _author(key: Column) -> Column:
    prefix = _pick(["enterprise_", "pro_", "demo_", "user_"], F.least(key % 5, F.lit(3)))
    return F.when(key % 5 < 4, F.concat(prefix, key.cast("string")))


_AUTHOR_SQL = "CASE {k} % 5 WHEN 0 THEN 'enterprise_' || {k} WHEN 1 THEN 'pro_' || {k} WHEN 2 THEN 'demo_' || {k} WHEN 3 THEN 'user_' || {k} END"


def raw_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return raw_columns(spread(read(spark, sf, "documents")))


def raw_columns(d: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    return d.select(
        key.alias("id"),
        F.col("source").alias("source_type"),
        key.cast("string").alias("source_id"),
        F.concat(F.lit("https://example.org/"), key.cast("string")).alias("url"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        _author(key).alias("author"),
        F.lit("").alias("author_url"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"))).alias(
            "timestamp"
        ),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), F.col("n_chars").cast("string")).alias("raw_metadata"),
    )


def documents(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """processed_documents: classified, partly clustered. `wide` is for jobs that work on the texts."""
    o = read(spark, sf, "orders")
    o = spread(o, TASK_ROWS) if wide else o
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        key.alias("id"),
        F.concat(F.lit("Report "), key.cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("title"),
        F.concat(
            F.when(digit == 1, "Critical issue: can't work, app is down. ").when(digit == 2, "Error on page. ").otherwise("Idea. "),
            F.when(key % 3 == 0, "Steps to reproduce: open browser version 2, see error message and logs. ").otherwise(""),
            F.repeat(F.lit("word "), (key % 130).cast("int")),
        ).alias("body"),
        _author(cust).alias("author"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 11 < 10, _pick(K.FEEDBACK_TYPES, key % 9)).alias("feedback_type"),
        F.when(key % 13 < 12, _pick(K.COMPONENTS, cust % 15)).alias("component"),
        _pick(K.SEVERITY_LEVELS, digit - 1).alias("severity"),
        F.when(key % 4 != 0, cust).alias("cluster_id"),
        F.when(key % 50 == 49, "failed").otherwise("completed").alias("processing_status"),
        F.concat(F.lit("src"), (key % 5).cast("string")).alias("source_type"),
        F.when(key % 7 != 0, _pick(["en", "fr", "de"], key % 3)).alias("language"),
        (key % 200).cast("int").alias("word_count"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").where(F.col("o_orderkey") % 8 != 7)
    key = F.col("o_orderkey")
    score = ((key * 37) % 101).cast("double") / F.lit(100.0)
    level = F.lit(1)
    for step, name in reversed(K.LEVEL_STEPS):
        level = F.when(score >= step, K.PRIORITY_LEVELS[name]).otherwise(level)
    return o.select(
        key.alias("document_id"),
        score.alias("priority_score"),
        (((key % 5) + 1).cast("double") / F.lit(5.0)).alias("severity_score"),
        ((key % 10).cast("double") / F.lit(10.0)).alias("reach_score"),
        (((key * 3) % 10).cast("double") / F.lit(10.0)).alias("recency_score"),
        (((key * 7) % 10).cast("double") / F.lit(10.0)).alias("persona_weight"),
        level.alias("priority_level"),
        (key % 6 == 0).alias("is_revenue_critical"),
        F.when(key % 6 == 0, F.lit(1.15)).otherwise(F.lit(1.0)).alias("revenue_impact_multiplier"),
        F.col("o_orderdate").alias("created_at"),
    )


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").where(F.col("o_orderkey") % 3 == 0)
    key = F.col("o_orderkey")
    status = (
        F.when((F.col("o_orderstatus") == "F") & (key % 2 == 0), "closed")
        .when(F.col("o_orderstatus") == "F", "resolved")
        .when(F.col("o_orderstatus") == "O", "open")
        .otherwise("in_progress")
    )
    return o.select(
        key.alias("id"),
        key.alias("source_document_id"),
        F.when(key % 2 == 0, "jira").otherwise("github").alias("platform"),
        status.alias("status"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.concat(F.lit("Ticket "), key.cast("string")).alias("title"),
        F.when(key % 5 == 0, F.array(F.lit("bug"), F.lit("urgent"))).otherwise(F.array(F.lit("feedback"))).alias("labels"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (key % 900).cast("int"))).alias("updated_at"),
    )


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """One row per cluster of the document adapter; the first document represents it."""
    d = documents(spark, sf).where(F.col("cluster_id").isNotNull())
    severity = F.element_at(_severity_map(), F.col("severity"))
    return d.groupBy(F.col("cluster_id").alias("id")).agg(
        F.count("*").alias("member_count"),
        F.min("created_at").alias("created_at"),
        F.round(F.avg(severity), 6).alias("avg_severity"),
        F.min_by("component", F.when(F.col("component").isNotNull(), F.col("id"))).alias("component"),
        F.min("id").alias("representative_document_id"),
    ).withColumn("title", F.concat(F.lit("Cluster "), F.col("id").cast("string")))


def _severity_map() -> Column:
    return F.create_map(*[x for k, v in K.SEVERITY_SCORES.items() for x in (F.lit(k), F.lit(v))])


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").where(F.col("o_orderkey") % 4 != 0)
    return o.select(
        F.col("o_custkey").alias("cluster_id"),
        F.col("o_orderkey").alias("document_id"),
        (((F.col("o_orderkey") * 13) % 100).cast("double") / F.lit(100.0)).alias("similarity_score"),
    )


def executions(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("execution_id"),
        _pick(K.AGENTS, F.col("user_id") % 8).alias("agent_name"),
        F.concat(F.lit("flow_"), (F.col("user_id") % 3).cast("string")).alias("workflow_name"),
        (F.col("user_id") % 10).alias("job_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("ts").alias("started_at"),
        F.col("value").alias("duration_seconds"),
        (F.col("event_id") % 50).alias("items_processed"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("document_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


_SEV_CASE = "CASE severity " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in K.SEVERITY_SCORES.items()) + " END"
_LEVEL_CASE = (
    "CASE " + " ".join(f"WHEN priority_score >= {s} THEN {K.PRIORITY_LEVELS[n]}" for s, n in K.LEVEL_STEPS) + " ELSE 1 END"
)

SQL = {
    "raw": f"""SELECT doc_id AS id, source AS source_type, CAST(doc_id AS VARCHAR) AS source_id,
        'https://example.org/' || doc_id AS url, substring(text, 1, 80) AS title, text AS content,
        {_AUTHOR_SQL.format(k='doc_id')} AS author, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS timestamp,
        lang, n_chars FROM documents""",
    "docs": f"""SELECT o_orderkey AS id, 'Report ' || o_orderkey || ' ' || o_orderpriority AS title,
        (CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical issue: can''t work, app is down. '
         WHEN '2' THEN 'Error on page. ' ELSE 'Idea. ' END)
        || (CASE WHEN o_orderkey % 3 = 0 THEN 'Steps to reproduce: open browser version 2, see error message and logs. ' ELSE '' END)
        || repeat('word ', o_orderkey % 130) AS body,
        {_AUTHOR_SQL.format(k='o_custkey')} AS author, o_orderdate AS timestamp, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 11 < 10 THEN {_sql_list(K.FEEDBACK_TYPES)}[o_orderkey % 9 + 1] END AS feedback_type,
        CASE WHEN o_orderkey % 13 < 12 THEN {_sql_list(K.COMPONENTS)}[o_custkey % 15 + 1] END AS component,
        {_sql_list(K.SEVERITY_LEVELS)}[CAST(substring(o_orderpriority, 1, 1) AS INT)] AS severity,
        CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS cluster_id,
        CASE WHEN o_orderkey % 50 = 49 THEN 'failed' ELSE 'completed' END AS processing_status,
        'src' || (o_orderkey % 5) AS source_type,
        CASE WHEN o_orderkey % 7 <> 0 THEN ['en', 'fr', 'de'][o_orderkey % 3 + 1] END AS language,
        CAST(o_orderkey % 200 AS INT) AS word_count FROM orders""",
    "scores": f"""SELECT *, {_LEVEL_CASE} AS priority_level FROM (SELECT o_orderkey AS document_id,
        CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS priority_score,
        CAST(o_orderkey % 5 + 1 AS DOUBLE) / 5 AS severity_score, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS reach_score,
        CAST((o_orderkey * 3) % 10 AS DOUBLE) / 10 AS recency_score, CAST((o_orderkey * 7) % 10 AS DOUBLE) / 10 AS persona_weight,
        o_orderkey % 6 = 0 AS is_revenue_critical,
        CASE WHEN o_orderkey % 6 = 0 THEN CAST(1.15 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS revenue_impact_multiplier,
        o_orderdate AS created_at FROM orders WHERE o_orderkey % 8 <> 7)""",
    "tickets": """SELECT o_orderkey AS id, o_orderkey AS source_document_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'jira' ELSE 'github' END AS platform,
        CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'resolved'
             WHEN o_orderstatus = 'O' THEN 'open' ELSE 'in_progress' END AS status,
        6 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, 'Ticket ' || o_orderkey AS title,
        CASE WHEN o_orderkey % 5 = 0 THEN ['bug', 'urgent'] ELSE ['feedback'] END AS labels,
        o_orderdate AS created_at, o_orderdate + to_hours(o_orderkey % 900) AS updated_at
        FROM orders WHERE o_orderkey % 3 = 0""",
    "clusters": f"""SELECT cluster_id AS id, count(*) AS member_count, min(created_at) AS created_at,
        round(avg({_SEV_CASE}), 6) AS avg_severity, arg_min(component, id) FILTER (component IS NOT NULL) AS component,
        min(id) AS representative_document_id, 'Cluster ' || cluster_id AS title
        FROM docs WHERE cluster_id IS NOT NULL GROUP BY cluster_id""",
    "memberships": """SELECT o_custkey AS cluster_id, o_orderkey AS document_id,
        CAST((o_orderkey * 13) % 100 AS DOUBLE) / 100 AS similarity_score FROM orders WHERE o_orderkey % 4 <> 0""",
    "executions": f"""SELECT event_id AS execution_id, {_sql_list(K.AGENTS)}[user_id % 8 + 1] AS agent_name,
        'flow_' || (user_id % 3) AS workflow_name, user_id % 10 AS job_id,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS started_at,
        value AS duration_seconds, event_id % 50 AS items_processed FROM events""",
    "vectors": "SELECT vec_id AS document_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
}
_NEEDS = {"clusters": ["docs"]}


def with_tables(*names: str) -> str:
    """WITH clause that defines the named adapter tables."""
    order: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in order) + " "
