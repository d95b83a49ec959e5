"""scores → ticket payloads under rate caps, ticket statistics and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import scores as S
from echoloom.functions import tickets as TK


def candidates(
    docs: DataFrame, scores: DataFrame, clusters: DataFrame, tickets: DataFrame, threshold: float = K.TICKET_THRESHOLD
) -> DataFrame:
    """High scores without a ticket, with document and cluster facts."""
    high = scores.where(F.col("priority_score") >= threshold).join(
        tickets.select(F.col("source_document_id").alias("document_id")), "document_id", "left_anti"
    )
    facts = docs.select(
        F.col("id").alias("document_id"), "title", "body", F.coalesce("feedback_type", F.lit("bug")).alias("feedback_type"),
        "component", "author", F.col("url") if "url" in docs.columns else F.lit("").alias("url"), "timestamp", "cluster_id",
    )
    sizes = clusters.select(F.col("id").alias("cluster_id"), F.col("member_count").alias("cluster_members"))
    joined = high.join(facts, "document_id").join(sizes, "cluster_id", "left")
    return joined.withColumn("cluster_size", F.coalesce("cluster_members", F.lit(1))).drop("cluster_members")


def select_top(rows: DataFrame, limit: int = K.TICKETS_PER_DAY) -> DataFrame:
    """Best scores first, ties by document; the daily cap is the feature here."""
    return rows.orderBy(F.col("priority_score").desc(), "document_id").limit(limit)


def build_tickets(rows: DataFrame, platforms: tuple[str, ...] = ("jira", "github")) -> DataFrame:
    """Title, text, labels, priority and tracker payload for each selected row."""
    df = rows.withColumns(
        {
            "component": F.coalesce("component", F.lit("unknown")),
            "platform": TK.platform_for(F.col("priority_score"), platforms),
            "kind": TK.template_kind(F.col("feedback_type")),
            "reasoning": S.ticket_reasoning(
                F.col("severity_score"), F.col("reach_score"), F.col("recency_score"), F.col("persona_weight"),
                F.col("is_revenue_critical"), F.col("revenue_impact_multiplier"),
            ),
        }
    )
    pick = lambda value: TK.by_template(F.col("kind"), F.col("platform"), value)
    df = df.withColumns(
        {
            "ticket_title": pick(lambda k, p: F.format_string(TK.TITLE_FORMATS[k, p], F.coalesce("title", F.lit("Untitled")))),
            "description": pick(TK.description),
            "labels": pick(TK.labels),
            "ticket_type": pick(lambda k, p: F.lit(TK.TICKET_TYPES[k, p])),
            "priority": TK.ticket_priority(F.col("priority_score"), F.col("platform")),
            "story_points": TK.story_points(F.col("priority_score")),
        }
    )
    jira = TK.jira_payload(
        F.col("ticket_title"), F.col("description"), F.col("ticket_type"), F.col("priority"), F.col("labels"), F.col("component")
    )
    github = TK.github_payload(F.col("ticket_title"), F.col("description"), F.col("labels"))
    return df.select(
        F.col("document_id").alias("source_document_id"), "cluster_id", "platform", F.col("ticket_title").alias("title"),
        "description", F.lit("open").alias("status"), "priority", TK.priority_sign(F.col("priority")).alias("sign"), "ticket_type",
        "story_points", "labels", "reasoning", "priority_score",
        F.when(F.col("platform") == "jira", jira).otherwise(github).alias("payload"),
    )


def admit_by_caps(
    requests: DataFrame, time: str, id_col: str, score: str,
    per_hour: int = K.TICKETS_PER_HOUR, per_day: int = K.TICKETS_PER_DAY,
) -> DataFrame:
    """Best scores of each hour up to the hourly cap, then of each day up to the daily cap.

    Both are top-k per group, which Spark cuts per input partition before the shuffle, so a
    crowded hour sends at most `per_hour` rows per task.
    """
    order = [F.col(score).desc(), F.col(id_col)]
    hours = W.partitionBy(F.date_trunc("hour", F.col(time))).orderBy(*order)
    days = W.partitionBy(F.to_date(F.col(time))).orderBy(*order)
    in_hour = requests.withColumn("hour_rank", F.row_number().over(hours)).where(F.col("hour_rank") <= per_hour)
    return in_hour.withColumn("day_rank", F.row_number().over(days)).where(F.col("day_rank") <= per_day)


def ticket_statistics(tickets: DataFrame) -> DataFrame:
    """Counts by platform, status and priority from one pass, zero where nothing was found."""
    dims = ["platform", "status", "priority"]
    base = tickets.select("platform", "status", F.col("priority").cast("string").alias("priority"))
    rolled = base.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count("*").alias("n"), *[F.grouping(d).alias(f"__g_{d}") for d in dims]
    )
    kind = F.when(F.col("__g_platform") == 0, "platform").when(F.col("__g_status") == 0, "status").otherwise("priority")
    found = rolled.select(kind.alias("dimension"), F.coalesce(*dims).alias("value"), "n")
    known = [("platform", v) for v in K.TICKET_PLATFORMS] + [("status", v) for v in K.TICKET_STATUSES]
    known += [("priority", str(v)) for v in K.PRIORITY_LEVELS.values()]
    table = tickets.sparkSession.createDataFrame(known, "dimension string, value string")
    return table.join(found, ["dimension", "value"], "full").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("tickets"))


def feedback_tickets(tickets: DataFrame, as_of: Column, days: int = 7, label: str = "feedback", status: str | None = None) -> DataFrame:
    """Tickets with a label created in the last `days`, newest first."""
    rows = tickets.where(F.array_contains("labels", label) & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))))
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), "id")
