"""Priority scoring of one document, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions.steps import any_contained, at_least, at_most, compact, first_contained, lookup
from echoloom.functions.text import let, text_or_empty, word_count


def severity_score(severity: Column) -> Column:
    return lookup(F.lower(severity), K.SEVERITY_SCORES, 0.2)


def severity_boost(feedback_type: Column, component: Column) -> Column:
    return (
        F.when(component == "security", 1.2)
        .when(feedback_type == "bug", 1.1)
        .when(feedback_type == "feature_request", 0.9)
        .otherwise(1.0)
    )


def reach_score(user_count: Column, segment: Column, component: Column) -> Column:
    base = at_most(user_count, K.REACH_STEPS, K.REACH_TOP)
    factor = F.when(component.isin(K.REACH_CRITICAL), K.REACH_CRITICAL_FACTOR).otherwise(1.0)
    return F.least(base * lookup(segment, K.SEGMENT_REACH, K.SEGMENT_REACH["unknown"]) * factor, F.lit(1.0))


def hours_between(start: Column, end: Column) -> Column:
    """Hours as a double, microsecond exact."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(3_600_000_000.0)


def recency_score(timestamp: Column, as_of: Column) -> Column:
    return at_most(hours_between(timestamp, as_of), K.RECENCY_STEPS, K.RECENCY_OLD)


def trend_boost(frequency_trend: Column) -> Column:
    return F.when(frequency_trend > 0.5, 1.2).when(frequency_trend > 0.2, 1.1).otherwise(1.0)


def persona_score(segment: Column, user_value: Column, quality: Column) -> Column:
    base = lookup(segment, K.SEGMENT_PERSONA, K.SEGMENT_PERSONA["unknown"])
    return F.least(
        base * at_least(user_value, K.VALUE_STEPS, 1.0) * lookup(F.lower(quality), K.QUALITY_FACTORS, 1.0), F.lit(1.0)
    )


def user_segment(author: Column) -> Column:
    known = first_contained(F.lower(author), K.SEGMENT_WORDS, "individual")
    return F.when(author.isNull() | (author == ""), "unknown").otherwise(known)


def quality_points(text: Column, count: Column) -> Column:
    """Points of a lower-cased text of `count` words: quality words, less 2 under 10 words, plus 1 over 100."""
    total = F.when(count < 10, -2).when(count > 100, 1).otherwise(0)
    for word in K.QUALITY_WORDS:
        total = total + text.contains(word).cast("int")
    return total


def quality_level(text: Column, points: Column) -> Column:
    return F.when(text == "", "low").when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")


def feedback_quality(body: Column) -> Column:
    """Level by the number of quality words, less 2 under 10 words, plus 1 over 100."""
    judged = lambda text: let(quality_points(text, word_count(text)), lambda p: quality_level(text, p))
    return let(F.lower(text_or_empty(body)), judged)


def cluster_quality(similarity: Column, coherence: Column, diversity: Column) -> Column:
    half = F.lit(0.5)
    return (F.coalesce(similarity, half) + F.coalesce(coherence, half) + F.coalesce(diversity, half)) / 3.0


def amplification(size: Column, quality: Column, min_size: int = 2, factor: float = 0.1) -> Column:
    grown = (1 + (size - 1) * F.lit(factor)) * F.least(quality, F.lit(1.0))
    return F.when(size < min_size, 1.0).otherwise(grown)


def urgency_text(title: Column, body: Column) -> Column:
    return F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(body)))


def urgency_found(text: Column) -> Column:
    """Indicators in a lower-cased text."""
    words = [F.when(text.contains(w), F.lit(w)) for w in K.URGENCY_WORDS]
    # "." stays on one line; a line ends at a line feed only
    patterns = [F.when(text.rlike("(?d)" + p), F.lit("pattern: " + p)) for p in K.URGENCY_PATTERNS]
    return compact(*words, *patterns)


def urgency_indicators(title: Column, body: Column) -> Column:
    return let(urgency_text(title, body), urgency_found)


def urgency_boost(indicators: Column) -> Column:
    strong = F.exists(indicators, lambda i: any_contained(i, K.URGENCY_STRONG))
    boost = 1.0 + F.size(indicators) * F.lit(0.1) + F.when(strong, 0.2).otherwise(0.0)
    return F.when(F.size(indicators) == 0, 1.0).otherwise(F.least(boost, F.lit(1.5)))


def revenue_boost(component: Column, components=K.REVENUE_COMPONENTS, factor: float = K.REVENUE_FACTOR) -> Column:
    return F.when(component.isin(list(components)), factor).otherwise(1.0)


def priority_level(score: Column) -> Column:
    return at_least(score, K.LEVEL_STEPS, "minimal")


def level_number(level: Column) -> Column:
    return lookup(level, K.PRIORITY_LEVELS, 1)


def level_name(number: Column) -> Column:
    return lookup(number, {v: k for k, v in K.PRIORITY_LEVELS.items()}, "minimal")


def normalized(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(weights)


def score_reasoning(severity, severity_value, users, amp, size, urgency, revenue, component) -> Column:
    text = lambda c: c.cast("string")
    return compact(
        F.when(severity_value >= 0.8, F.concat(F.lit("High severity ("), severity, F.lit(")"))),
        F.when(users > 10, F.concat(F.lit("Affects "), text(users), F.lit(" users"))),
        F.when(amp > 1.1, F.concat(F.lit("Multiple reports ("), text(size), F.lit(" similar issues)"))),
        F.when(urgency > 1.1, F.lit("Contains urgency indicators")),
        F.when(revenue > 1.1, F.concat(F.lit("Revenue-critical component ("), component, F.lit(")"))),
    )


def ticket_reasoning(severity, reach, recency, persona, critical, multiplier) -> Column:
    return compact(
        F.when(severity >= 0.8, "High severity impact").when(severity >= 0.6, "Medium severity impact"),
        F.when(reach >= 0.8, "Affects many users").when(reach >= 0.6, "Moderate user impact"),
        F.when(recency >= 0.8, "Recent feedback"),
        F.when(persona >= 0.8, "High-value user segment"),
        F.when(critical, "Revenue-critical issue"),
        F.when(multiplier > 1.0, F.concat(F.lit("Revenue impact: "), F.format_number(multiplier, 1), F.lit("x"))),
    )
