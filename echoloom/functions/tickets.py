"""Ticket priority, texts and tracker payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions.steps import at_least, lookup

# Title formats and labels per kind and platform are fixed values.
TITLE_FORMATS = {
    ("bug", "jira"): "[BUG] %s", ("feature_request", "jira"): "[FEATURE] %s", ("performance", "jira"): "[PERFORMANCE] %s",
    ("bug", "github"): "🐛 %s", ("feature_request", "github"): "✨ %s", ("performance", "github"): "⚡ %s",
}
TICKET_TYPES = {
    ("bug", "jira"): "bug", ("feature_request", "jira"): "story", ("performance", "jira"): "task",
    ("bug", "github"): "issue", ("feature_request", "github"): "enhancement", ("performance", "github"): "issue",
}
LABELS = {
    ("bug", "jira"): ["bug", "feedback", "high-priority"],
    ("feature_request", "jira"): ["feature", "feedback", "enhancement"],
    ("performance", "jira"): ["performance", "feedback", "optimization"],
    ("bug", "github"): ["bug", "feedback", "high-priority", "{component}"],
    ("feature_request", "github"): ["enhancement", "feedback", "feature-request", "{component}"],
    ("performance", "github"): ["performance", "feedback", "optimization", "{component}"],
}
# sections of the description: heading and what stands there when the feedback has no such field
SECTIONS = {
    "bug": [("Steps to Reproduce", "Not provided"), ("Expected Behavior", "Not specified"), ("Actual Behavior", "Not specified")],
    "feature_request": [("Business Value", "Not specified"), ("Acceptance Criteria", "Not specified")],
    "performance": [("Performance Impact", "Not specified"), ("Metrics", "Not available")],
}


def ticket_priority(score: Column, platform: Column) -> Column:
    return F.when(platform == "jira", at_least(score, K.JIRA_STEPS, "lowest")).otherwise(
        at_least(score, K.GITHUB_STEPS, "lowest")
    )


def priority_sign(priority: Column) -> Column:
    return lookup(priority, K.PRIORITY_SIGNS, "⚪")


def story_points(score: Column) -> Column:
    return at_least(score, K.STORY_POINTS, 1)


def platform_for(score: Column, enabled: tuple[str, ...] = ("jira", "github")) -> Column:
    if "jira" in enabled and "github" in enabled:
        return F.when(score >= 0.9, "jira").otherwise("github")
    if not enabled:
        raise ValueError("no ticket platform is enabled")
    return F.lit("jira" if "jira" in enabled else enabled[0])


def template_kind(feedback_type: Column) -> Column:
    return F.when(feedback_type.isin("feature_request", "performance"), feedback_type).otherwise("bug")


def by_template(kind: Column, platform: Column, value) -> Column:
    """`value(kind, platform)` for the template a row uses."""
    out = None
    for key in TITLE_FORMATS:
        test = (kind == key[0]) & (platform == key[1])
        out = F.when(test, value(*key)) if out is None else out.when(test, value(*key))
    return out


def description(kind: str, platform: str) -> Column:
    """Markdown body with the fields a tracker needs, one heading per section."""
    head = (lambda t: f"## {t}\n") if platform == "github" else (lambda t: f"**{t}:**\n")
    parts = [F.lit(head("Description")), F.col("body")]
    for title, missing in SECTIONS[kind]:
        parts.append(F.lit(f"\n\n{head(title)}{missing}"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    facts = [
        ("Component", text("component")), ("Priority Score", text("priority_score")), ("Feedback Type", text("feedback_type")),
        ("User Count", text("cluster_size")), ("Cluster Size", text("cluster_size")),
    ]
    origin = [("Title", text("title")), ("Author", text("author")), ("URL", text("url")), ("Timestamp", text("timestamp"))]
    for title, rows in (("Environment", facts), ("Original Feedback", origin)):
        parts.append(F.lit(f"\n\n{head(title)}"))
        for i, (name, value) in enumerate(rows):
            parts += [F.lit(("\n" if i else "") + f"- {name}: "), value]
    parts += [F.lit(f"\n\n{head('Priority Reasoning')}"), F.array_join("reasoning", ", ")]
    return F.concat(*parts)


def labels(kind: str, platform: str) -> Column:
    return F.array(*[F.col("component") if x == "{component}" else F.lit(x) for x in LABELS[kind, platform]])


def jira_payload(title, text, ticket_type, priority, label_list, component, project: str = "FEED") -> Column:
    paragraph = F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    fields = F.struct(
        F.struct(F.lit(project).alias("key")).alias("project"),
        title.alias("summary"),
        F.struct(F.lit("doc").alias("type"), F.lit(1).alias("version"), F.array(paragraph).alias("content")).alias("description"),
        F.struct(lookup(ticket_type, K.JIRA_ISSUE_TYPES, "Bug").alias("name")).alias("issuetype"),
        F.struct(lookup(priority, K.JIRA_PRIORITIES, "Medium").alias("name")).alias("priority"),
        label_list.alias("labels"),
        F.array(F.struct(component.alias("name"))).alias("components"),
    )
    return F.to_json(F.struct(fields.alias("fields")))


def github_payload(title, text, label_list, assignee: Column | None = None) -> Column:
    people = F.array().cast("array<string>") if assignee is None else F.array_compact(F.array(assignee))
    return F.to_json(F.struct(title.alias("title"), text.alias("body"), label_list.alias("labels"), people.alias("assignees")))
