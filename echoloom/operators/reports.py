"""Report rows, texts in four formats, alert messages, and the report sink.

A report is one row of named fields. Blocks are gathered as (field, value) rows and turned
into columns by one aggregation, so that no two tables are ever multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.operators import analytics as A

NAMES = {
    "executive": "Executive Summary", "technical": "Technical Summary", "hourly": "Hourly Digest",
    "daily": "Daily Summary", "weekly": "Weekly Summary", "monthly": "Monthly Summary",
}
DEFAULT_FORMATS = {
    "executive": "html", "technical": "markdown", "hourly": "text", "daily": "html", "weekly": "html", "monthly": "html",
}
# heading → fields, in the order they appear in the report
LAYOUTS = {
    "executive": [
        ("Overview", ["start_date", "end_date", "total_feedback", "high_priority_count", "tickets_created", "resolution_rate"]),
        ("Key insights", ["key_insights"]),
        ("Priority distribution", [
            "critical_count", "critical_percentage", "high_count", "high_percentage",
            "medium_count", "medium_percentage", "low_count", "low_percentage",
        ]),
        ("Components", ["top_components"]),
        ("Trends", ["trend_analysis"]),
        ("Critical issues", ["critical_issues"]),
        ("Recommendations", ["recommendations"]),
    ],
    "technical": [
        ("Processing", [
            "start_date", "end_date", "total_processed", "classified_count", "classification_rate", "clustered_count",
            "clustering_rate", "prioritized_count", "prioritization_rate", "tickets_created",
        ]),
        ("Classification", [
            "bug_count", "bug_percentage", "feature_count", "feature_percentage",
            "performance_count", "performance_percentage", "other_count", "other_percentage",
        ]),
        ("Clusters", ["cluster_count", "avg_cluster_size", "largest_cluster_title", "largest_cluster_size", "top_clusters"]),
        ("Components", ["component_analysis"]),
    ],
    "hourly": [
        ("Summary", ["hour", "new_feedback_count", "high_priority_count", "tickets_created", "critical_issues_count"]),
        ("Top priorities", ["top_priorities"]),
        ("Critical alerts", ["critical_alerts"]),
        ("Trends", ["trends"]),
        ("Affected components", ["affected_components"]),
        ("Actions", ["actions_taken"]),
    ],
    "daily": [
        ("Metrics", ["date", "total_feedback", "high_priority", "tickets_created", "resolved_tickets"]),
        ("Priorities", [
            "critical_count", "critical_percentage", "high_count", "high_percentage",
            "medium_count", "medium_percentage", "low_count", "low_percentage",
        ]),
        ("Components", ["component_breakdown"]),
        ("Comparison", ["trend_comparison"]),
        ("Critical issues", ["critical_issues"]),
        ("Recommendations", ["recommendations"]),
    ],
}
LAYOUTS["weekly"] = LAYOUTS["daily"]
LAYOUTS["monthly"] = LAYOUTS["daily"]


def fields(df: DataFrame, **columns: Column) -> DataFrame:
    """A one-row table as (field, value) rows."""
    pairs = [F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in columns.items()]
    return df.select(F.inline(F.array(*pairs)))


def lines(
    df: DataFrame, field: str, line: Column, order: list[Column],
    head: str = "", tail: str = "", sep: str = "\n", limit: int = 5, skip: int = 0, empty: str = "",
) -> DataFrame:
    """Up to `limit` rows of an ordered listing as one text field; `order` sorts ascending."""
    keys = [f"o{i}" for i in range(len(order))]
    rows = df.select(line.alias("line"), *[c.alias(k) for c, k in zip(order, keys)]).orderBy(*keys).offset(skip).limit(limit)
    packed = rows.agg(F.array_sort(F.collect_list(F.struct(*keys, "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(F.lit(head), x["line"], F.lit(tail))), sep)
    return packed.select(F.lit(field).alias("field"), F.when(F.size("l") == 0, F.lit(empty)).otherwise(text).alias("value"))


def one_row(parts: list[DataFrame], names: list[str]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])


def field_names(report_type: str) -> list[str]:
    return [name for _, names in LAYOUTS[report_type] for name in names]


def trend_sentence(trends: DataFrame) -> DataFrame:
    """The first three trends: "<metric> increased by 1.0%"."""
    verb = F.when(F.col("trend_direction") == "up", " increased by ").otherwise(" decreased by ")
    line = F.concat("metric", verb, F.format_string("%.1f", F.abs("change_percentage")), F.lit("%"))
    return lines(trends, "trend_analysis", line, [F.col("rule_no"), F.col("metric")], sep="; ", limit=3, empty="No significant trends detected.")


def trend_summary(trends: DataFrame) -> DataFrame:
    n = F.col("n")
    counted = trends.agg(F.count("*").alias("all"), F.count_if(F.col("significance").isin("high", "medium")).alias("n"))
    text = F.when(F.col("all") == 0, "No significant trends in the last hour.").when(n == 0, "Stable trends detected.")
    return fields(counted, trends=text.otherwise(F.concat(n.cast("string"), F.lit(" significant trend(s) detected."))))


def trend_comparison(trends: DataFrame) -> DataFrame:
    counted = trends.agg(
        F.count("*").alias("all"),
        F.count_if(F.col("trend_direction") == "up").alias("up"),
        F.count_if(F.col("trend_direction") == "down").alias("down"),
    )
    text = F.format_string("Previous day: %d increasing trends, %d decreasing trends.", F.col("up"), F.col("down"))
    return fields(counted, trend_comparison=F.when(F.col("all") == 0, "No previous data for comparison.").otherwise(text))


class Digest:
    """The tables and the period a report is built from; every method is a lazy plan."""

    def __init__(self, docs, scores, tickets, clusters, period: A.Period):
        self.docs, self.scores, self.tickets, self.clusters, self.period = docs, scores, tickets, clusters, period

    def trends(self) -> DataFrame:
        return A.analyze_trends(self.docs, self.scores, self.tickets, self.period)

    def components(self) -> DataFrame:
        return A.analyze_components(self.docs, self.scores, self.tickets, self.period)

    def cluster_facts(self) -> DataFrame:
        return A.analyze_clusters(self.clusters, self.period)

    def insights(self) -> DataFrame:
        return A.insights(self.trends(), self.components(), self.cluster_facts())

    def _counts(self, **names: str) -> DataFrame:
        """Documents, high and critical scores of the period, under the given field names."""
        rows = self.docs.where(self.period.holds()).select("id")
        scores = self.scores.select(F.col("document_id").alias("id"), "priority_score")
        counts = rows.join(scores, "id", "left").agg(
            F.count("*").alias("total"),
            F.count_if(F.col("priority_score") >= 0.7).alias("high"),
            F.count_if(F.col("priority_score") >= 0.9).alias("critical"),
        )
        return fields(counts, **{field: F.col(source) for source, field in names.items()})

    def _tickets(self, **names: str) -> DataFrame:
        facts = A.ticket_activity(self.tickets, self.period, A.previous_period(self.period, 7))
        facts = facts.withColumn("cur_rate", F.round("cur_rate", 1))
        return fields(facts, **{field: F.col(source) for source, field in names.items()})

    def _priorities(self) -> DataFrame:
        kinds = ["critical", "high", "medium", "low"]
        facts = A.priority_distribution(self.scores, self.period)
        return fields(facts, **{f"{k}_count": F.col(k) for k in kinds}, **{f"{k}_percentage": F.col(f"{k}_percentage") for k in kinds})

    def _titles(self, field: str, least: float, limit: int, head: str, tail: str = "") -> DataFrame:
        rows = A.high_titles(self.docs, self.scores, self.period, least, limit).where(F.col("title") != "")
        return lines(rows, field, F.col("title"), [-F.col("priority_score"), F.col("id")], head, tail, limit=limit)

    def _advice(self, field: str, skip: int = 0) -> DataFrame:
        return lines(self.insights(), field, F.col("insight"), [F.col("rule_no"), F.col("subject")], "<li>", "</li>", skip=skip)

    def _dates(self) -> DataFrame:
        row = self.docs.sparkSession.range(1)
        return fields(row, start_date=F.lit(self.period.start[:10]), end_date=F.lit(self.period.end[:10]))

    def executive(self) -> DataFrame:
        by_volume = [-F.col("total_feedback"), F.col("component")]
        item = F.concat("component", F.lit(": "), F.col("total_feedback").cast("string"), F.lit(" items"))
        parts = [
            self._dates(),
            self._counts(total="total_feedback", high="high_priority_count"),
            self._tickets(cur="tickets_created", cur_rate="resolution_rate"),
            self._advice("key_insights"),
            self._priorities(),
            lines(self.components(), "top_components", item, by_volume, "<li>", "</li>"),
            trend_sentence(self.trends()),
            self._titles("critical_issues", 0.9, 5, "<li>", "</li>"),
            self._advice("recommendations", skip=5),
        ]
        return one_row(parts, field_names("executive"))

    def technical(self) -> DataFrame:
        funnel = A.processing_funnel(self.docs, self.scores, self.tickets, self.period)
        kinds = {"bug": "bug", "feature_request": "feature", "performance": "performance", "other": "other"}
        types = A.classification_breakdown(self.docs, self.period)
        clusters = self.cluster_facts()
        named = lambda c: F.concat(F.lit("• "), c["title"], F.lit(": "), c["size"].cast("string"), F.lit(" items"))
        listed = F.array_join(F.transform("top_clusters", named), "\n")
        item = F.concat("component", F.lit(": "), F.col("items").cast("string"), F.lit(" items"))
        parts = [
            self._dates(),
            fields(funnel, **{c: F.col(c) for c in funnel.columns}),
            fields(types, **{f"{v}_count": F.col(k) for k, v in kinds.items()}, **{f"{v}_percentage": F.col(f"{k}_percentage") for k, v in kinds.items()}),
            fields(
                clusters,
                cluster_count=F.col("total_clusters"),
                avg_cluster_size=F.round("avg_cluster_size", 1),
                largest_cluster_title=F.coalesce("largest_cluster.title", F.lit("N/A")),
                largest_cluster_size=F.coalesce("largest_cluster.size", F.lit(0)),
                top_clusters=F.when(F.coalesce(F.size("top_clusters"), F.lit(0)) <= 0, "No clusters found.").otherwise(listed),
            ),
            lines(A.top_components(self.docs, self.period), "component_analysis", item, [-F.col("items"), F.col("component")], "• ", empty="No component data available."),
        ]
        return one_row(parts, field_names("technical"))

    def hourly(self) -> DataFrame:
        by_volume = [-F.col("total_feedback"), F.col("component")]
        start = F.lit(self.period.start).cast("timestamp_ntz")
        parts = [
            fields(self.docs.sparkSession.range(1), hour=F.date_format(start, "HH:00")),
            self._counts(total="new_feedback_count", high="high_priority_count", critical="critical_issues_count"),
            self._tickets(cur="tickets_created"),
            self._titles("top_priorities", 0.7, 5, "• "),
            self._titles("critical_alerts", 0.95, 3, "• "),
            trend_summary(self.trends()),
            lines(self.components(), "affected_components", F.col("component"), by_volume, sep=", "),
        ]
        names = [n for n in field_names("hourly") if n != "actions_taken"]
        actions = F.concat(
            F.lit("Created "), "tickets_created", F.lit(" tickets, processed "), "new_feedback_count", F.lit(" feedback items")
        )
        return one_row(parts, names).withColumn("actions_taken", actions)

    def daily(self) -> DataFrame:
        """Also serves the weekly and monthly summaries over their longer periods."""
        by_volume = [-F.col("total_feedback"), F.col("component")]
        item = F.concat(
            F.lit("• "), "component", F.lit(": "), F.col("total_feedback").cast("string"), F.lit(" items ("),
            F.col("high_priority_count").cast("string"), F.lit(" high-priority)"),
        )
        before = Digest(self.docs, self.scores, self.tickets, self.clusters, A.previous_period(self.period, 1))
        parts = [
            fields(self.docs.sparkSession.range(1), date=F.lit(self.period.start[:10])),
            self._counts(total="total_feedback", high="high_priority"),
            self._tickets(cur="tickets_created", cur_done="resolved_tickets"),
            self._priorities(),
            lines(self.components(), "component_breakdown", item, by_volume, empty="No component data available."),
            trend_comparison(before.trends()),
            self._titles("critical_issues", 0.9, 5, "<li>", "</li>"),
            self._advice("recommendations"),
        ]
        return one_row(parts, field_names("daily"))

    def data(self, report_type: str) -> DataFrame:
        makers = {"executive": self.executive, "technical": self.technical, "hourly": self.hourly}
        return makers.get(report_type, self.daily)()

    def daily_totals(self) -> DataFrame:
        parts = [
            self._counts(total="total_feedback", high="high_priority"),
            self._tickets(cur="tickets_created", cur_done="resolved"),
            self._titles("top_issues", 0.7, 5, "• "),
            self._titles("critical_alerts", 0.95, 3, "• "),
            fields(self.docs.sparkSession.range(1), date=F.lit(self.period.start[:10])),
        ]
        return one_row(parts, ["date", "total_feedback", "high_priority", "tickets_created", "resolved", "top_issues", "critical_alerts"])


def _label(name: str) -> str:
    return name.replace("_", " ").capitalize()


def render(data: DataFrame, report_type: str, fmt: str | None = None) -> DataFrame:
    """Add the report text: html, markdown, text, or the fields as JSON."""
    fmt = fmt or DEFAULT_FORMATS[report_type]
    if fmt not in ("html", "markdown", "text", "json"):
        raise ValueError(f"no such report format: {fmt}")
    if fmt == "json":
        return data.withColumn("content", F.to_json(F.struct(*field_names(report_type))))
    value = lambda n: F.coalesce(F.col(n), F.lit(""))
    title = NAMES[report_type]
    parts: list[Column] = []
    if fmt == "html":
        parts.append(F.lit(f"<!DOCTYPE html>\n<html>\n<head><title>{title}</title></head>\n<body>\n<h1>{title}</h1>\n"))
        for heading, names in LAYOUTS[report_type]:
            parts.append(F.lit(f"<h2>{heading}</h2>\n"))
            for n in names:
                parts += [F.lit(f"<div><b>{_label(n)}</b> "), value(n), F.lit("</div>\n")]
        parts.append(F.lit("</body>\n</html>\n"))
    else:
        mark = "# " if fmt == "markdown" else ""
        parts.append(F.lit(f"{mark}{title}\n"))
        for heading, names in LAYOUTS[report_type]:
            parts.append(F.lit(f"\n{mark and '## '}{heading}\n"))
            for n in names:
                parts += [F.lit(f"- {_label(n)}: "), value(n), F.lit("\n")]
    return data.withColumn("content", F.concat(*parts))


def summary_line(report_type: str) -> Column:
    c = lambda n: F.col(n)
    if report_type == "executive":
        return F.concat(F.lit("Executive summary covering "), c("total_feedback"), F.lit(" feedback items with "), c("high_priority_count"), F.lit(" high-priority issues."))
    if report_type == "technical":
        return F.concat(F.lit("Technical summary showing "), c("total_processed"), F.lit(" items processed with "), c("classification_rate"), F.lit("% classification rate."))
    if report_type == "hourly":
        return F.concat(F.lit("Hourly digest: "), c("new_feedback_count"), F.lit(" new items, "), c("tickets_created"), F.lit(" tickets created."))
    if report_type == "daily":
        return F.concat(F.lit("Daily summary: "), c("total_feedback"), F.lit(" feedback items, "), c("tickets_created"), F.lit(" tickets created, "), c("resolved_tickets"), F.lit(" resolved."))
    return F.lit(f"{report_type.title()} report generated successfully.")


def report_rows(digest: Digest, report_type: str, fmt: str | None = None) -> DataFrame:
    """One digest_reports row."""
    out = render(digest.data(report_type), report_type, fmt)
    return out.select(
        F.lit(report_type).alias("report_type"),
        F.lit(f"{NAMES[report_type]} - {digest.period.end[:16]}").alias("title"),
        summary_line(report_type).alias("summary"),
        "content",
        F.lit(digest.period.start).cast("timestamp_ntz").alias("period_start"),
        F.lit(digest.period.end).cast("timestamp_ntz").alias("period_end"),
        F.lit(fmt or DEFAULT_FORMATS[report_type]).alias("format"),
    )


def save_reports(reports: DataFrame, path: str) -> None:
    """One folder per type and period, named like `daily_19980802_000000`, one text file each."""
    name = F.concat_ws("_", "report_type", F.date_format("period_end", "yyyyMMdd_HHmmss"))
    rows = reports.select(name.alias("report"), F.col("format"), F.col("content").alias("value"))
    rows.write.mode("append").partitionBy("report", "format").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, format, content) of saved reports; a report is one file, so its text comes back whole."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("report").cast("string"), F.col("format").cast("string"), F.regexp_replace("value", r"\n\z", "").alias("content"))


def expired(reports: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return reports.where(F.col("created_at") < as_of - F.make_dt_interval(F.lit(days)))


def alert_priority(change: Column) -> Column:
    return F.when(F.abs(change) >= 50, "high").when(F.abs(change) >= 20, "medium").otherwise("low")


def trend_alerts(trends: DataFrame) -> DataFrame:
    """A message row per critical trend."""
    rows = A.critical_trends(trends)
    number = lambda c: F.format_string("%.1f", F.col(c))
    message = F.concat(
        F.lit("📈 TREND ALERT: "), "metric", F.lit("\nCurrent Value: "), number("current_value"), F.lit("\nPrevious Value: "),
        number("previous_value"), F.lit("\nChange: "), number("change_percentage"), F.lit("%\nDescription: "), "description",
        F.lit("\nRecommendation: Immediate action required for "), "metric",
    )
    return rows.select(
        F.lit("trend").alias("alert_type"), F.col("metric").alias("subject"),
        alert_priority(F.col("change_percentage")).alias("priority"), message.alias("message"),
    )


def critical_alerts(docs: DataFrame, scores: DataFrame, period: A.Period, least: float = 0.95) -> DataFrame:
    """A message row per document of the period with a critical score."""
    high = scores.where(F.col("priority_score") >= least).select(F.col("document_id").alias("id"), "priority_score")
    rows = docs.where(period.holds()).join(high, "id")
    message = F.concat(
        F.lit("🚨 CRITICAL ALERT: "), "title", F.lit("\nPriority: critical\nComponent: "), F.coalesce("component", F.lit("unknown")),
        F.lit("\nImpact: score "), F.format_string("%.2f", F.col("priority_score")), F.lit("\nNext Steps: review and assign"),
    )
    return rows.select(
        F.lit("critical").alias("alert_type"), F.col("id").cast("string").alias("subject"), F.lit("critical").alias("priority"),
        message.alias("message"),
    )


def daily_message(totals: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("📅 Daily Feedback Summary - "), "date", F.lit("\nTotal Feedback: "), "total_feedback", F.lit("\nHigh Priority: "),
        "high_priority", F.lit("\nTickets Created: "), "tickets_created", F.lit("\nResolved: "), "resolved",
        F.lit("\nTop Issues:\n"), "top_issues", F.lit("\nCritical Alerts:\n"), "critical_alerts",
    )
    return totals.select(
        F.lit("daily").alias("alert_type"), F.col("date").alias("subject"), F.lit("medium").alias("priority"), message.alias("message")
    )
