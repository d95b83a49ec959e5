"""tickets + scores + documents → outcomes, quality metrics, weights and advice."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import outcomes as O
from echoloom.functions import scores as S
from echoloom.functions.steps import clamp
from echoloom.operators.analytics import Period
from echoloom.operators.ordering import global_rank, rolling

# metric, threshold below which it is reported, kind, priority, title, what it means, what to do
RULES = [
    ("overall_accuracy", 0.7, "accuracy_improvement", "high", "Improve Overall Accuracy", "Accuracy", "Review classification algorithms and training data quality"),
    ("classification_accuracy", 0.8, "classification_improvement", "medium", "Improve Classification Accuracy", "Classification accuracy", "Update classification templates and rules"),
    ("clustering_accuracy", 0.7, "clustering_improvement", "medium", "Improve Clustering Accuracy", "Clustering accuracy", "Review clustering parameters and similarity calculations"),
    ("resolution_time_improvement", 0.6, "resolution_time_improvement", "high", "Improve Resolution Times", "Resolution time improvement", "Optimize ticket routing and escalation procedures"),
    ("user_satisfaction", 0.7, "user_satisfaction_improvement", "high", "Improve User Satisfaction", "User satisfaction", "Implement user satisfaction tracking and feedback collection"),
    ("processing_speed", 0.5, "processing_speed_improvement", "medium", "Improve Processing Speed", "Processing speed", "Review processing algorithms and system resources"),
    ("learning_rate", 0.1, "learning_rate_improvement", "low", "Increase Learning Rate", "Learning rate", "Increase learning rate or provide more diverse training data"),
]
METRICS = [
    "overall_accuracy", "precision", "recall", "f1_score", "classification_accuracy", "clustering_accuracy",
    "prioritization_accuracy", "resolution_time_improvement", "user_satisfaction", "business_impact", "processing_speed",
    "error_rate", "uptime", "learning_rate", "adaptation_speed", "weight_stability",
]


def analyze_outcomes(tickets: DataFrame, docs: DataFrame, scores: DataFrame, clusters: DataFrame, period: Period) -> DataFrame:
    """One row per finished ticket of the period whose document has a score."""
    done = tickets.where(period.holds() & F.col("status").isin(K.DONE_STATUSES)).select(
        F.col("source_document_id").alias("id"), "status", "created_at", "updated_at"
    )
    facts = docs.select("id", "feedback_type", "component", "body", "cluster_id")
    predicted = scores.select(F.col("document_id").alias("id"), F.col("priority_score").alias("predicted_priority"))
    sizes = clusters.select(F.col("id").alias("cluster_id"), F.coalesce("member_count", F.lit(1)).alias("cluster_size"))
    rows = done.join(facts, "id").join(predicted, "id").join(sizes, "cluster_id", "left")
    rows = rows.withColumn("resolution_time", O.resolution_hours(F.col("status"), F.col("created_at"), F.col("updated_at")))
    hours, status, kind, part = F.col("resolution_time"), F.col("status"), F.col("feedback_type"), F.col("component")
    return rows.select(
        F.col("id").alias("feedback_id"),
        "component",
        "predicted_priority",
        O.actual_priority(hours, status, kind).alias("actual_priority"),
        "resolution_time",
        O.resolution_quality(hours, status, kind).alias("resolution_quality"),
        O.satisfaction(hours, status).alias("user_satisfaction"),
        O.business_impact(hours, kind, part).alias("business_impact"),
        O.classification_accuracy(kind, F.col("body")).alias("classification_accuracy"),
        O.clustering_accuracy(F.col("cluster_size")).alias("clustering_accuracy"),
        F.coalesce("updated_at", "created_at").alias("outcome_timestamp"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def performance_metrics(outcomes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Error, precision/recall/F1, time and satisfaction scores in one aggregation."""
    p, a = F.col("predicted_priority"), F.col("actual_priority")
    zero = F.lit(0.0)
    m = outcomes.agg(
        F.coalesce(F.avg(F.abs(p - a)), zero).alias("mean_absolute_error"),
        F.coalesce(F.sqrt(F.avg((p - a) * (p - a))), zero).alias("root_mean_square_error"),
        F.count_if((p >= threshold) & (a >= threshold)).alias("tp"),
        F.count_if((p >= threshold) & (a < threshold)).alias("fp"),
        F.count_if((p < threshold) & (a >= threshold)).alias("fn"),
        F.coalesce(F.avg(F.when(F.col("resolution_time").isNotNull(), O.time_accuracy(F.col("resolution_time")))), zero).alias("resolution_time_accuracy"),
        F.coalesce(F.avg("user_satisfaction"), zero).alias("user_satisfaction_score"),
        F.coalesce(F.avg("business_impact"), zero).alias("business_impact_score"),
        F.coalesce(F.avg("classification_accuracy"), zero).alias("__classification"),
        F.coalesce(F.avg("clustering_accuracy"), zero).alias("__clustering"),
        F.count("*").alias("total_predictions"),
        F.count_if(F.abs(p - a) < 0.2).alias("successful_predictions"),
    )
    m = m.withColumn("precision_score", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    m = m.withColumn("recall_score", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision_score") + F.col("recall_score")
    m = m.withColumn("f1_score", _ratio(2 * F.col("precision_score") * F.col("recall_score"), both))
    overall = (
        F.greatest(zero, 1 - F.col("mean_absolute_error")) * 0.3 + F.col("__classification") * 0.2 + F.col("__clustering") * 0.2
        + F.col("resolution_time_accuracy") * 0.15 + F.col("user_satisfaction_score") * 0.1 + F.col("business_impact_score") * 0.05
    )
    m = m.withColumn("accuracy_score", F.when(F.col("total_predictions") > 0, overall).otherwise(zero))
    return m.drop("tp", "fp", "fn", "__classification", "__clustering")


def weight_adjustments(
    outcomes: DataFrame, weights: DataFrame, rate: float = 0.1, sign: int = 1, min_total: int = 10,
    min_component: int = 5, min_confidence: float = 0.7,
) -> DataFrame:
    """Bias and error corrections per component, largest impact first.

    `sign` is 1 for the fixed formula, where over-prediction raises a weight; −1 turns it.
    """
    p, a = F.col("predicted_priority"), F.col("actual_priority")
    per = outcomes.groupBy(F.coalesce("component", F.lit("general")).alias("component")).agg(
        F.count("*").alias("n"), F.avg(F.abs(p - a)).alias("err"), F.avg(p - a).alias("bias")
    )
    total = outcomes.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    per = per.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")  # one row
    per = per.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 20.0))
    per = per.where((F.col("total") >= min_total) & (F.col("n") >= min_component) & (F.col("confidence") >= min_confidence))
    per = per.join(weights.select("component", "weight"), "component", "left").withColumn("old_weight", F.coalesce("weight", F.lit(1.0)))
    bounded = lambda c: F.greatest(F.lit(0.1), F.least(F.lit(2.0), c))
    by_bias = bounded(F.col("old_weight") * (1 + F.col("bias") * rate * sign))
    by_error = bounded(F.col("old_weight") * (1 - F.col("err") * rate * 0.5))
    row = lambda no, new, reason, impact: F.struct(
        F.lit(no).alias("step"), new.alias("new_weight"), reason.alias("adjustment_reason"), impact.alias("impact_score")
    )
    changes = F.array_compact(
        F.array(
            F.when(
                (F.abs("bias") > 0.1) & (F.abs(by_bias - F.col("old_weight")) > 0.05),
                row(1, by_bias, F.format_string("Bias correction: %.3f", F.col("bias")), F.abs("bias") * F.col("err")),
            ),
            F.when(
                (F.col("err") > 0.3) & (F.abs(by_error - F.col("old_weight")) > 0.05),
                row(2, by_error, F.format_string("Error reduction: %.3f", F.col("err")), F.col("err")),
            ),
        )
    )
    out = per.select("component", "old_weight", "confidence", F.inline(changes))
    return out.orderBy(F.col("impact_score").desc(), "component", "step")


def apply_adjustments(weights: DataFrame, adjustments: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """New weight table; of several confident changes the last in impact order stands."""
    confident = adjustments.where(F.col("confidence") >= min_confidence)
    last = confident.groupBy("component").agg(F.min_by("new_weight", F.struct("impact_score", -F.col("step"))).alias("new_weight"))
    return weights.join(last, "component", "full").select("component", F.coalesce("new_weight", "weight").alias("weight"))


def valid_weights(weights: DataFrame) -> DataFrame:
    return weights.where(F.col("weight").between(0, 2))


def adapted_learning_rate(accuracy: Column, rate: Column) -> Column:
    slower, faster = F.greatest(F.lit(0.05), rate * 0.9), F.least(F.lit(0.2), rate * 1.1)
    return F.when(accuracy < 0.7, faster).when(accuracy > 0.9, slower).otherwise(rate)


def weights_from_feedback(feedback: DataFrame, weights: dict[str, float] | None = None, rate: float = 0.1) -> DataFrame:
    """Add rate/10 per successful row that was high in a factor, then normalise to 1."""
    base = weights or K.WEIGHTS
    hits = feedback.where("resolution_successful").agg(*[F.count_if(f"high_{k}").alias(k) for k in base])
    grown = hits.select(*[(F.lit(v) + F.col(k) * F.lit(rate * 0.1)).alias(k) for k, v in base.items()])
    total = sum((F.col(k) for k in base), F.lit(0.0))
    return grown.select(*[(F.col(k) / total).alias(k) for k in base])


def learning_rate_metric(scores: DataFrame) -> DataFrame:
    """|mean of the later half − mean of the earlier half| by time."""
    ranked = global_rank(scores.select("created_at", "document_id", "priority_score"), ["created_at", "document_id"])
    total = ranked.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    early = F.col("rank") <= F.floor(F.col("n") / 2)
    halves = ranked.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").agg(  # one row
        F.avg(F.when(early, F.col("priority_score"))).alias("a"), F.avg(F.when(~early, F.col("priority_score"))).alias("b")
    )
    return halves.select(F.coalesce(F.least(F.lit(1.0), F.abs(F.col("b") - F.col("a"))), F.lit(0.0)).alias("learning_rate"))


def adaptation_speed_metric(scores: DataFrame) -> DataFrame:
    """1 − 2 × mean sample variance over all windows of min(10, n div 3) scores by time."""
    ranked = global_rank(scores.select("created_at", "document_id", "priority_score"), ["created_at", "document_id"])
    width = min(10, ranked.count() // 3)  # one number sets the frame
    if width < 2:
        return scores.sparkSession.range(1).select(F.lit(0.0).alias("adaptation_speed"))
    windows = rolling(ranked, width, "variance", F.var_samp("priority_score"))
    return windows.agg(F.coalesce(clamp(1 - F.avg("variance") * 2), F.lit(0.0)).alias("adaptation_speed"))


def system_metrics(docs: DataFrame, scores: DataFrame, tickets: DataFrame, clusters: DataFrame, period: Period) -> DataFrame:
    """All quality metrics of a period as (metric, value) rows."""
    docs = docs.where(period.holds())
    mine = scores.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    tickets = tickets.where(period.holds())
    hours = (datetime.fromisoformat(period.end) - datetime.fromisoformat(period.start)).total_seconds() / 3600
    zero = F.lit(0.0)
    score = F.col("priority_score")
    s = mine.agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.count_if(score >= 0.7).alias("high"),
        F.var_samp(score).alias("var"), F.stddev_samp(score).alias("sd"),
    )
    precision = _ratio(F.col("high"), F.col("n"))
    of_scores = {
        "overall_accuracy": F.coalesce(clamp(F.col("mean")), zero),
        "precision": precision,
        "recall": precision,
        "f1_score": precision,
        "prioritization_accuracy": F.when(F.col("n") == 0, 0.0).when(F.col("n") < 2, 1.0).otherwise(clamp(1 - F.col("var") * 2)),
        "weight_stability": F.when((F.col("n") < 2) | (F.col("mean") == 0), 1.0).otherwise(clamp(1 - F.col("sd") / F.col("mean"))),
    }
    found = clusters.where(period.holds()).agg(F.count("*").alias("clusters")).withColumn("one", F.lit(1))
    d = docs.agg(
        F.count("*").alias("n"), F.count("feedback_type").alias("classified"), F.count("cluster_id").alias("clustered"),
        F.count_if(F.col("processing_status") == "failed").alias("failed"),
    ).withColumn("one", F.lit(1)).join(found, "one")
    efficiency = F.least(F.lit(1.0), F.col("clusters") / F.col("n") * 0.1)
    of_docs = {
        "classification_accuracy": _ratio(F.col("classified"), F.col("n")),
        "clustering_accuracy": F.when((F.col("n") > 0) & (F.col("clusters") > 0), clamp(F.col("clustered") / F.col("n") * (1 - efficiency))).otherwise(0.0),
        "processing_speed": F.least(F.lit(1.0), F.col("n") / F.lit(hours) / 100.0) if hours > 0 else zero,
        "error_rate": F.when(F.col("n") > 0, 1 - F.col("failed") / F.col("n")).otherwise(0.0),
        "uptime": F.lit(0.999),
    }
    done = F.col("status").isin(K.DONE_STATUSES)
    took = O.resolution_hours(F.col("status"), F.col("created_at"), F.col("updated_at"))
    t = tickets.agg(
        F.avg(took).alias("hours"), F.avg(F.when(done, O.ticket_satisfaction(took, F.col("status")))).alias("satisfaction")
    )
    of_tickets = {
        "resolution_time_improvement": F.coalesce(clamp(1 - F.col("hours") / 24.0), zero),
        "user_satisfaction": F.coalesce("satisfaction", zero),
    }
    facts = docs.select(F.col("id").alias("source_document_id"), "feedback_type", "component")
    impact = tickets.join(facts, "source_document_id").agg(
        F.coalesce(F.avg(O.ticket_impact(F.col("feedback_type"), F.col("component"))), zero).alias("business_impact")
    )
    rate, speed = learning_rate_metric(mine), adaptation_speed_metric(mine)
    rows = lambda df, m: df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in m.items()])))
    out = rows(s, of_scores).unionByName(rows(d, of_docs)).unionByName(rows(t, of_tickets))
    for name, df in (("business_impact", impact), ("learning_rate", rate), ("adaptation_speed", speed)):
        out = out.unionByName(rows(df, {name: F.col(name)}))
    return out


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice for each metric below its threshold; the rule table is a fixed, tiny side."""
    rules = metrics.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(RULES, 1)],
        "rule_no int, metric string, threshold double, type string, priority string, title string, subject string, action string",
    )
    hits = metrics.join(F.broadcast(rules), "metric").where(F.col("value") < F.col("threshold"))
    text = F.concat("subject", F.lit(" is "), F.format_string("%.3f", F.col("value")), F.lit("."))
    return hits.select("rule_no", "type", "priority", "title", text.alias("description"), "action").orderBy("rule_no")


def retained(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return history.where(F.col("measured_at") >= as_of - F.make_dt_interval(F.lit(days)))


def metric_trends(history: DataFrame) -> DataFrame:
    """Last minus first value of each metric in a (metric, measured_at, value) history."""
    ends = history.groupBy("metric").agg(
        F.max_by("value", "measured_at").alias("last"), F.min_by("value", "measured_at").alias("first"),
        F.count_distinct("measured_at").alias("points"),
    )
    return ends.where(F.col("points") >= 2).select("metric", (F.col("last") - F.col("first")).alias("trend"))
