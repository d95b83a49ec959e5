"""Period analytics: trends, components, clusters, distributions, insights.

Each table is scanned once per question: the current and the previous period are two
conditional aggregates of the same pass, and the time filter reaches the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom import constants as K

REPORT_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "executive": 1, "technical": 1}


@dataclass(frozen=True)
class Period:
    """Half-open time range; `inclusive` also takes rows exactly at the end."""

    start: str
    end: str
    inclusive: bool = False

    def holds(self, name: str = "created_at") -> Column:
        at = lambda v: F.lit(v).cast("timestamp_ntz")
        last = F.col(name) <= at(self.end) if self.inclusive else F.col(name) < at(self.end)
        return (F.col(name) >= at(self.start)) & last


def report_start(report_type: str, end: Column) -> Column:
    """Hourly reports cover one hour, weekly 7 days, monthly 30 days, all others one day."""
    if report_type == "hourly":
        return end - F.expr("INTERVAL 1 HOUR")
    return end - F.make_dt_interval(F.lit(REPORT_DAYS.get(report_type, 1)))


def with_trend(df: DataFrame) -> DataFrame:
    """Add change, direction and significance to `current_value` and `previous_value`."""
    cur, prev = F.col("current_value"), F.col("previous_value")
    change = F.when(prev == 0, F.when(cur > 0, 100.0).otherwise(0.0)).otherwise((cur - prev) / prev * 100)
    df = df.withColumn("change_percentage", change)
    size = F.abs("change_percentage")
    direction = F.when(size < 5, "stable").when(F.col("change_percentage") > 0, "up").otherwise("down")
    significance = F.when(size >= 50, "high").when(size >= 20, "medium").otherwise("low")
    return df.withColumn("trend_direction", direction).withColumn("significance", significance)


def previous_period(period: Period, days: int) -> Period:
    from datetime import datetime, timedelta

    start = datetime.fromisoformat(period.start) - timedelta(days=days)
    return Period(start.isoformat(sep=" "), period.start, period.inclusive)


def component_activity(docs: DataFrame, scores: DataFrame, now: Period, before: Period) -> DataFrame:
    """Per component: documents, high scores and score sum now, documents and high scores before."""
    cur, prev = now.holds(), before.holds()
    rows = docs.where(cur | prev).select("id", "component", cur.alias("cur"), prev.alias("prev"))
    rows = rows.join(scores.select(F.col("document_id").alias("id"), "priority_score"), "id", "left")
    high = F.col("priority_score") >= 0.7
    scored = F.when(F.col("cur"), F.col("priority_score"))
    return rows.groupBy("component").agg(
        F.count_if("cur").alias("cur"),
        F.count_if("prev").alias("prev"),
        F.count_if(F.col("cur") & high).alias("cur_high"),
        F.count_if(F.col("prev") & high).alias("prev_high"),
        F.sum(scored).alias("score_sum"),
        F.count(scored).alias("scored"),
    )


def ticket_activity(tickets: DataFrame, now: Period, before: Period) -> DataFrame:
    """One row: tickets and resolution rate (percent), now and before."""
    cur, prev, done = now.holds(), before.holds(), F.col("status").isin(K.DONE_STATUSES)
    counts = tickets.where(cur | prev).agg(
        F.count_if(cur).alias("cur"),
        F.count_if(prev).alias("prev"),
        F.count_if(cur & done).alias("cur_done"),
        F.count_if(prev & done).alias("prev_done"),
    )
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(0.0)
    return counts.withColumn("cur_rate", rate("cur_done", "cur")).withColumn("prev_rate", rate("prev_done", "prev"))


def _metric(no: int, name: str, cur, prev, description: str) -> Column:
    number = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.struct(
        F.lit(no).alias("rule_no"), F.lit(name).alias("metric"), number(cur).alias("current_value"),
        number(prev).alias("previous_value"), F.lit(description).alias("description"),
    )


def analyze_trends(docs: DataFrame, scores: DataFrame, tickets: DataFrame, period: Period, comparison_days: int = 7) -> DataFrame:
    """Four overall metrics and one per component that also had documents before."""
    before = previous_period(period, comparison_days)
    parts = component_activity(docs, scores, period, before)
    total = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cur", "prev", "cur_high", "prev_high")])
    overall = total.select(
        F.inline(
            F.array(
                _metric(1, "Total Feedback", "cur", "prev", "Number of feedback items received"),
                _metric(2, "High Priority Feedback", "cur_high", "prev_high", "Number of high-priority feedback items"),
            )
        )
    )
    handled = ticket_activity(tickets, period, before).select(
        F.inline(
            F.array(
                _metric(3, "Tickets Created", "cur", "prev", "Number of tickets created from feedback"),
                _metric(4, "Resolution Rate", "cur_rate", "prev_rate", "Percentage of tickets resolved"),
            )
        )
    )
    named = parts.where(F.col("component").isNotNull() & (F.col("cur") > 0) & (F.col("prev") > 0)).select(
        F.lit(5).alias("rule_no"),
        F.concat("component", F.lit(" Feedback")).alias("metric"),
        F.col("cur").cast("double").alias("current_value"),
        F.col("prev").cast("double").alias("previous_value"),
        F.concat(F.lit("Number of feedback items for "), "component").alias("description"),
    )
    return with_trend(overall.unionByName(handled).unionByName(named))


def critical_trends(trends: DataFrame) -> DataFrame:
    return trends.where((F.col("significance") == "high") & (F.col("trend_direction") == "up"))


def component_titles(docs: DataFrame, period: Period, limit: int = 5) -> DataFrame:
    """Up to `limit` titles per component, first documents first.

    The rank filter is cut per input partition before the shuffle, so a component with a
    third of all rows still sends only `limit` rows per task.
    """
    order = W.partitionBy("component").orderBy("id")
    rows = docs.where(period.holds() & F.col("component").isNotNull()).select("component", "id", "title")
    top = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    titles = F.array_sort(F.collect_list(F.when(F.col("title") != "", F.struct("rn", "title"))))
    return top.groupBy("component").agg(F.transform(titles, lambda t: t["title"]).alias("top_issues"))


def component_resolution(docs: DataFrame, tickets: DataFrame, period: Period) -> DataFrame:
    """Percent of a component's tickets that are resolved or closed."""
    facts = docs.where(period.holds()).select(F.col("id").alias("source_document_id"), "component")
    joined = tickets.select("source_document_id", "status").join(facts, "source_document_id")
    rate = F.count_if(F.col("status").isin(K.DONE_STATUSES)) / F.count("*") * 100
    return joined.groupBy("component").agg(rate.alias("resolution_rate"))


def analyze_components(docs: DataFrame, scores: DataFrame, tickets: DataFrame, period: Period, comparison_days: int = 7) -> DataFrame:
    """Volume, priority, trend, titles and resolution per component, largest first."""
    parts = component_activity(docs, scores, period, previous_period(period, comparison_days))
    parts = parts.where(F.col("component").isNotNull() & (F.col("cur") > 0))
    mean = F.when(F.col("scored") > 0, F.col("score_sum") / F.col("scored")).otherwise(0.0)
    rows = parts.select(
        "component", F.col("cur").alias("total_feedback"), F.col("cur_high").alias("high_priority_count"),
        mean.alias("avg_priority_score"), F.col("cur").cast("double").alias("current_value"),
        F.col("prev").cast("double").alias("previous_value"),
    )
    rows = with_trend(rows).join(component_titles(docs, period), "component", "left")
    rows = rows.join(component_resolution(docs, tickets, period), "component", "left")
    rows = rows.withColumn("resolution_rate", F.coalesce("resolution_rate", F.lit(0.0)))
    return rows.orderBy(F.col("total_feedback").desc(), "component")


def analyze_clusters(clusters: DataFrame, period: Period, top: int = 5) -> DataFrame:
    """One row: count, mean size, largest, `top` clusters, efficiency in percent."""
    rows = clusters.where(period.holds()).select("id", "title", "member_count", "avg_severity", "component")
    order = F.struct(-F.col("member_count"), F.col("id"))  # ids of any kind: the largest, of equals the least id
    facts = F.struct("id", "title", F.col("member_count").alias("size"), "avg_severity", "component")
    summary = rows.agg(
        F.count("*").alias("total_clusters"),
        F.coalesce(F.avg("member_count"), F.lit(0.0)).alias("avg_cluster_size"),
        F.min_by(facts, order).alias("largest_cluster"),
        F.coalesce(F.count("*") / F.nullif(F.sum("member_count"), F.lit(0)) * 100, F.lit(0.0)).alias("clustering_efficiency"),
    )
    best = rows.orderBy(F.col("member_count").desc(), "id").limit(top)
    listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("member_count")).alias("o"), "id", facts.alias("c")))).alias("l"))
    listed = listed.select(F.transform("l", lambda x: x["c"]).alias("top_clusters"), F.lit(1).alias("one"))
    return summary.withColumn("one", F.lit(1)).join(listed, "one", "left").drop("one")


def priority_distribution(scores: DataFrame, period: Period) -> DataFrame:
    """Counts and percentages of critical, high, medium and low (two lowest levels)."""
    level = F.col("priority_level")
    parts = {"critical": level == 5, "high": level == 4, "medium": level == 3, "low": level <= 2}
    counts = scores.where(period.holds()).agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in parts.items()])
    share = lambda n: F.when(F.col("total") > 0, F.round(F.col(n) / F.col("total") * 100, 1)).otherwise(0.0)
    return counts.select("total", *parts, *[share(n).alias(f"{n}_percentage") for n in parts])


def classification_breakdown(docs: DataFrame, period: Period) -> DataFrame:
    """Counts and shares of four types among all classified documents."""
    kinds = ["bug", "feature_request", "performance", "other"]
    rows = docs.where(period.holds() & F.col("feedback_type").isNotNull())
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("feedback_type") == k).alias(k) for k in kinds])
    share = lambda k: F.when(F.col("total") > 0, F.round(F.col(k) / F.col("total") * 100, 1)).otherwise(0.0)
    return counts.select("total", *kinds, *[share(k).alias(f"{k}_percentage") for k in kinds])


def processing_funnel(docs: DataFrame, scores: DataFrame, tickets: DataFrame, period: Period) -> DataFrame:
    """Processed → classified → clustered → prioritised documents with rates, and tickets."""
    rows = docs.where(period.holds()).select("id", "feedback_type", "cluster_id")
    scored = scores.select(F.col("document_id").alias("id"), F.lit(True).alias("scored"))
    counts = rows.join(scored, "id", "left").agg(
        F.count("*").alias("total_processed"),
        F.count("feedback_type").alias("classified_count"),
        F.count("cluster_id").alias("clustered_count"),
        F.count("scored").alias("prioritized_count"),
    )
    rate = lambda c: F.when(F.col("total_processed") > 0, F.round(F.col(c) / F.col("total_processed") * 100, 1)).otherwise(0.0)
    counts = counts.withColumns(
        {
            "classification_rate": rate("classified_count"),
            "clustering_rate": rate("clustered_count"),
            "prioritization_rate": rate("prioritized_count"),
        }
    )
    made = tickets.where(period.holds()).agg(F.count("*").alias("tickets_created"))
    return counts.withColumn("one", F.lit(1)).join(made.withColumn("one", F.lit(1)), "one").drop("one")


def high_titles(docs: DataFrame, scores: DataFrame, period: Period, least: float, limit: int) -> DataFrame:
    """Best-scored documents of a period from a score upwards, ties by document."""
    high = scores.where(F.col("priority_score") >= least).select(F.col("document_id").alias("id"), "priority_score")
    rows = docs.where(period.holds()).select("id", "title").join(high, "id")
    return rows.orderBy(F.col("priority_score").desc(), "id").limit(limit)


def top_components(docs: DataFrame, period: Period, limit: int = 5) -> DataFrame:
    rows = docs.where(period.holds() & F.col("component").isNotNull())
    return rows.groupBy("component").agg(F.count("*").alias("items")).orderBy(F.col("items").desc(), "component").limit(limit)


def _pct(col: Column) -> Column:
    return F.format_string("%.1f", col)


def insights(trends: DataFrame, components: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rule findings in a fixed order (rule_no, then subject): trends, components, clusters, advice."""
    text = lambda no, sub, value: F.struct(F.lit(no).alias("rule_no"), sub.alias("subject"), value.alias("insight"))
    size = _pct(F.abs("change_percentage"))
    subject = F.concat(F.col("rule_no").cast("string"), F.lit(" "), "metric")
    up, down = F.col("trend_direction") == "up", F.col("trend_direction") == "down"
    from_trends = trends.where((F.col("significance") == "high") & (up | down)).select(
        F.inline(
            F.array(
                text(
                    1, subject,
                    F.when(up, F.concat(F.lit("🚨 "), "metric", F.lit(" has increased significantly by "), size, F.lit("% - requires immediate attention")))
                    .otherwise(F.concat(F.lit("✅ "), "metric", F.lit(" has decreased by "), size, F.lit("% - positive trend"))),
                )
            )
        )
    )
    rising = critical_trends(trends).agg(F.count("*").alias("n")).where("n > 0").select(
        F.inline(F.array(text(6, F.lit(""), F.lit("🚨 High priority feedback is increasing - consider increasing development resources"))))
    )
    order = F.struct(-F.col("total_feedback"), F.col("component"))
    facts = components.agg(
        F.min_by(F.struct("component", "total_feedback", "high_priority_count"), order).alias("top"),
        F.count_if((F.col("high_priority_count") > 5) & (F.col("total_feedback") > 10)).alias("pressed"),
    )
    number = lambda c: F.col(c).cast("string")
    from_components = facts.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("top.total_feedback") > 10,
                        text(2, F.lit(""), F.concat(F.lit("🔧 "), "top.component", F.lit(" is the most affected component with "), number("top.total_feedback"), F.lit(" feedback items"))),
                    ),
                    F.when(
                        F.col("pressed") > 0,
                        text(3, F.lit(""), F.concat(F.lit("⚠️ "), number("pressed"), F.lit(" components have high priority issues requiring immediate attention"))),
                    ),
                    F.when(
                        F.col("top.high_priority_count") > 10,
                        text(7, F.lit(""), F.concat(F.lit("🔧 Focus on "), "top.component", F.lit(" - has "), number("top.high_priority_count"), F.lit(" high-priority issues"))),
                    ),
                )
            )
        )
    )
    some = F.col("total_clusters") > 0
    from_clusters = clusters.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        some & (F.col("avg_cluster_size") > 5),
                        text(4, F.lit(""), F.concat(F.lit("📊 Average cluster size is "), _pct(F.col("avg_cluster_size")), F.lit(" - good clustering efficiency"))),
                    ),
                    F.when(
                        some & (F.col("largest_cluster.size") > 10),
                        text(5, F.lit(""), F.concat(F.lit("🔍 Large cluster detected: "), "largest_cluster.title", F.lit(" with "), number("largest_cluster.size"), F.lit(" items - consider breaking down into sub-issues"))),
                    ),
                    F.when(F.col("avg_cluster_size") > 8, text(8, F.lit(""), F.lit("🔍 Large clusters detected - consider breaking down into smaller, more specific issues"))),
                    F.when(F.col("clustering_efficiency") < 10, text(9, F.lit(""), F.lit("📊 Low clustering efficiency - review clustering parameters and feedback quality"))),
                )
            )
        )
    )
    out = from_trends.unionByName(from_components).unionByName(from_clusters).unionByName(rising)
    return out.orderBy("rule_no", "subject")


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def source_distribution(docs: DataFrame, raw: DataFrame) -> DataFrame:
    facts = raw.select(F.col("id").alias("raw_feedback_id"), "source_type")
    return docs.select("raw_feedback_id").join(facts, "raw_feedback_id").groupBy("source_type").agg(F.count("*").alias("documents"))
