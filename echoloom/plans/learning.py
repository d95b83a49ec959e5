"""Outcome, metric, weight and experiment plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.operators import experiments as X
from echoloom.operators import learning as op
from echoloom.operators.analytics import Period
from echoloom.operators.ordering import global_rank
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.tables import AS_OF, with_tables

PERIOD = Period("1998-01-01 00:00:00", AS_OF)
_IN = f"created_at >= TIMESTAMP '{PERIOD.start}' AND created_at < TIMESTAMP '{PERIOD.end}'"
def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")



def _outcomes(spark, sf):
    return op.analyze_outcomes(T.tickets(spark, sf), T.documents(spark, sf), T.scores(spark, sf), T.clusters(spark, sf), PERIOD)


D = lambda v: f"CAST({v} AS DOUBLE)"
_CLAMP = lambda e: f"least({D(1)}, greatest({D(0)}, {e}))"
OUTCOMES = with_tables("docs", "scores", "tickets", "clusters").rstrip() + f""", o AS (SELECT d.id, d.component, d.feedback_type AS kind, d.body, status, priority_score AS predicted, member_count,
    (epoch_us(updated_at) - epoch_us(t.created_at)) / {D(3600000000)} AS h FROM tickets t JOIN docs d ON d.id = t.source_document_id JOIN scores s ON s.document_id = d.id
    LEFT JOIN clusters c ON c.id = d.cluster_id WHERE status IN ('resolved', 'closed') AND {_IN.replace('created_at', 't.created_at')}),
    outcomes AS (SELECT id AS feedback_id, component, predicted AS predicted_priority, h AS resolution_time,
    {_CLAMP(f"(CASE WHEN h < 1 THEN {D(.9)} WHEN h < 24 THEN {D(.7)} WHEN h < 168 THEN {D(.5)} ELSE {D(.3)} END) * (CASE status WHEN 'closed' THEN {D(1)} ELSE {D(.9)} END) * (CASE kind WHEN 'bug' THEN {D(1.2)} WHEN 'feature_request' THEN {D(.8)} WHEN 'performance' THEN {D(1.1)} ELSE {D(1)} END)")} AS actual_priority,
    {_CLAMP(f"{D(.5)} + CASE status WHEN 'closed' THEN {D(.3)} ELSE {D(.2)} END + CASE WHEN h < 24 THEN {D(.2)} WHEN h > 168 THEN {D(-.1)} ELSE {D(0)} END + CASE WHEN kind = 'bug' AND h <> 0 AND h < 48 THEN {D(.1)} WHEN kind = 'bug' AND h > 168 THEN {D(-.1)} ELSE {D(0)} END")} AS resolution_quality,
    {_CLAMP(f"CASE WHEN h < 24 THEN {D(.8)} WHEN h < 168 THEN {D(.6)} ELSE {D(.4)} END + CASE status WHEN 'closed' THEN {D(.1)} ELSE {D(.05)} END")} AS user_satisfaction,
    {_CLAMP(f"{D(.5)} + CASE kind WHEN 'bug' THEN {D(.2)} WHEN 'performance' THEN {D(.1)} WHEN 'feature_request' THEN {D(-.1)} ELSE {D(0)} END + CASE WHEN h < 24 THEN {D(-.1)} WHEN h > 168 THEN {D(.1)} ELSE {D(0)} END + CASE WHEN component IN ('authentication', 'payment', 'core') THEN {D(.1)} WHEN component IN ('ui', 'ux') THEN {D(-.05)} ELSE {D(0)} END")} AS business_impact,
    CASE WHEN kind IS NULL THEN {D(0)} WHEN length(body) > 200 THEN {D(.8)} WHEN length(body) > 100 THEN {D(.6)} ELSE {D(.4)} END AS classification_accuracy,
    CASE WHEN member_count IS NULL THEN {D(0)} WHEN member_count > 5 THEN {D(.8)} WHEN member_count > 2 THEN {D(.6)} ELSE {D(.4)} END AS clustering_accuracy FROM o) """

_R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
_ESTIMATES = [
    "resolution_time", "actual_priority", "resolution_quality", "user_satisfaction", "business_impact",
    "classification_accuracy", "clustering_accuracy",
]


@plan("j08_outcomes", OUTCOMES + f"SELECT feedback_id, predicted_priority, {_R(*_ESTIMATES)} FROM outcomes")
def _(spark, sf):
    return _outcomes(spark, sf).select("feedback_id", "predicted_priority", *[F.round(c, 6).alias(c) for c in _ESTIMATES])


def _single(name: str, column: str) -> None:
    @plan(name, OUTCOMES + f"SELECT feedback_id, {_R(column)} FROM outcomes")
    def _(spark, sf):
        return _outcomes(spark, sf).select("feedback_id", F.round(column, 6).alias(column))


for _name, _column in zip(
    ["j01_resolution_time", "j02_actual_priority", "j03_resolution_quality", "j04_satisfaction", "j05_business_impact",
     "j06_classification_accuracy", "j07_clustering_accuracy"],
    _ESTIMATES,
):
    _single(_name, _column)


@plan("c03_finished_tickets", OUTCOMES + "SELECT count(*) AS outcomes, count(DISTINCT component) AS components FROM outcomes")
def _(spark, sf):
    return _outcomes(spark, sf).agg(F.count("*").alias("outcomes"), F.count_distinct("component").alias("components"))


_PERF = ["mean_absolute_error", "root_mean_square_error", "precision_score", "recall_score", "f1_score", "resolution_time_accuracy", "user_satisfaction_score", "business_impact_score", "accuracy_score"]
_TA = f"CASE WHEN resolution_time <= 4 THEN {D(1)} WHEN resolution_time <= 24 THEN {D(.8)} WHEN resolution_time <= 168 THEN {D(.6)} WHEN resolution_time <= 720 THEN {D(.4)} ELSE {D(.2)} END"


@plan(
    "j09_performance",
    OUTCOMES + f"""SELECT {_R(*_PERF)}, n AS total_predictions, ok AS successful_predictions FROM (SELECT *, coalesce(2 * precision_score * recall_score / nullif(precision_score + recall_score, 0), 0) AS f1_score,
    greatest(0, 1 - mean_absolute_error) * 0.3 + ca * 0.2 + cl * 0.2 + resolution_time_accuracy * 0.15 + user_satisfaction_score * 0.1 + business_impact_score * 0.05 AS accuracy_score
    FROM (SELECT avg(abs(p - a)) AS mean_absolute_error, sqrt(avg((p - a) * (p - a))) AS root_mean_square_error,
    coalesce(count(*) FILTER (WHERE p >= 0.7 AND a >= 0.7) / nullif(count(*) FILTER (WHERE p >= 0.7), 0), 0) AS precision_score, coalesce(count(*) FILTER (WHERE p >= 0.7 AND a >= 0.7) / nullif(count(*) FILTER (WHERE a >= 0.7), 0), 0) AS recall_score,
    avg({_TA}) AS resolution_time_accuracy, avg(user_satisfaction) AS user_satisfaction_score, avg(business_impact) AS business_impact_score, avg(classification_accuracy) AS ca, avg(clustering_accuracy) AS cl,
    count(*) AS n, count(*) FILTER (WHERE round(abs(p - a), 9) < 0.2) AS ok FROM (SELECT *, predicted_priority AS p, round(actual_priority, 9) AS a FROM outcomes)))""",
)
def _(spark, sf):
    rows = _outcomes(spark, sf).withColumn("actual_priority", F.round("actual_priority", 9))
    m = op.performance_metrics(rows)
    exact = rows.agg(F.count_if(F.round(F.abs(F.col("predicted_priority") - F.col("actual_priority")), 9) < 0.2).alias("ok"))
    m = m.drop("successful_predictions").withColumn("one", F.lit(1)).join(exact.withColumn("one", F.lit(1)), "one")
    return m.select(*[F.round(c, 6).alias(c) for c in _PERF], "total_predictions", F.col("ok").alias("successful_predictions"))


def _weights(spark, sf):
    """Current weights: one per component, from the parts table's sizes."""
    sizes = T.read(spark, sf, "part").groupBy((F.col("p_partkey") % 15).alias("k")).agg(F.avg("p_size").alias("s"))
    names = F.array(*[F.lit(c) for c in K.COMPONENTS])
    return sizes.select(F.element_at(names, (F.col("k") + 1).cast("int")).alias("component"), F.least(F.lit(1.9), F.round(F.col("s") / 20, 4)).alias("weight"))


_WEIGHTS = "w AS (SELECT [" + ", ".join(f"'{c}'" for c in K.COMPONENTS) + "][k + 1] AS component, least(1.9, round(s / 20, 4)) AS weight FROM (SELECT p_partkey % 15 AS k, avg(p_size) AS s FROM part GROUP BY 1))"
ADJUST = OUTCOMES.rstrip() + f""", {_WEIGHTS}, per AS (SELECT coalesce(component, 'general') AS component, count(*) AS n, avg(abs(predicted_priority - actual_priority)) AS err,
    avg(predicted_priority - actual_priority) AS bias FROM outcomes GROUP BY 1), p2 AS (SELECT p.*, coalesce(weight, 1) AS old FROM per p LEFT JOIN w USING (component) WHERE n >= 5 AND n / 20.0 >= 0.7 AND (SELECT count(*) FROM outcomes) >= 10),
    p3 AS (SELECT *, greatest({D(.1)}, least({D(2)}, old * (1 + bias * {D(.1)}))) AS nb, greatest({D(.1)}, least({D(2)}, old * (1 - err * {D(.05)}))) AS ne FROM p2),
    adj AS (SELECT component, old AS old_weight, nb AS new_weight, least(1, n / 20.0) AS confidence, 1 AS step, abs(bias) * err AS impact_score, 'Bias correction: ' || printf('%.3f', bias) AS adjustment_reason FROM p3 WHERE abs(bias) > 0.1 AND abs(nb - old) > 0.05
    UNION ALL SELECT component, old, ne, least(1, n / 20.0), 2, err, 'Error reduction: ' || printf('%.3f', err) FROM p3 WHERE err > 0.3 AND abs(ne - old) > 0.05) """


@plan("j10_weight_adjustments", ADJUST + "SELECT component, adjustment_reason, round(old_weight, 6) AS old_weight, round(new_weight, 6) AS new_weight, round(confidence, 6) AS confidence, round(impact_score, 6) AS impact_score FROM adj")
def _(spark, sf):
    out = op.weight_adjustments(_outcomes(spark, sf), _weights(spark, sf))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("component", "adjustment_reason", r("old_weight"), r("new_weight"), r("confidence"), r("impact_score"))


@plan("f09_adjustments_by_impact", ADJUST + "SELECT row_number() OVER (ORDER BY impact_score DESC, component, step) AS place, component, step FROM adj")
def _(spark, sf):
    from pyspark.sql import Window as W

    out = op.weight_adjustments(_outcomes(spark, sf), _weights(spark, sf))
    place = F.row_number().over(W.orderBy(F.col("impact_score").desc(), "component", "step")).cast("bigint")
    return out.select(place.alias("place"), "component", "step")


@plan(
    "j11_applied_weights",
    ADJUST + """SELECT component, round(coalesce(nw, weight), 6) AS weight FROM w FULL JOIN (SELECT component, arg_min(new_weight, impact_score) AS nw FROM adj WHERE confidence >= 0.7 GROUP BY component) USING (component)""",
)
def _(spark, sf):
    weights = _weights(spark, sf)
    out = op.apply_adjustments(weights, op.weight_adjustments(_outcomes(spark, sf), weights))
    return out.select("component", F.round("weight", 6).alias("weight"))


@plan("j14_valid_weights", "SELECT p_partkey AS id, p_size / CAST(20 AS DOUBLE) AS weight FROM part WHERE p_size / CAST(20 AS DOUBLE) BETWEEN 0 AND 2")
def _(spark, sf):
    return op.valid_weights(T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 20).alias("weight")))


@plan(
    "j12_learning_rates",
    with_tables("scores")
    + f"SELECT document_id, round(CASE WHEN priority_score < 0.7 THEN least({D(.2)}, {D(.1)} * 1.1) WHEN priority_score > 0.9 THEN greatest({D(.05)}, {D(.1)} * 0.9) ELSE {D(.1)} END, 9) AS rate FROM scores",
)
def _(spark, sf):
    return T.scores(spark, sf).select("document_id", F.round(op.adapted_learning_rate(F.col("priority_score"), F.lit(0.1)), 9).alias("rate"))


@plan(
    "j13_weights_from_feedback",
    with_tables("tickets", "scores")
    + f"""SELECT round(s / (s + r + c + p), 9) AS severity, round(r / (s + r + c + p), 9) AS reach, round(c / (s + r + c + p), 9) AS recency, round(p / (s + r + c + p), 9) AS persona FROM (
    SELECT {D(.35)} + {D(.01)} * count(*) FILTER (WHERE severity_score >= 0.8) AS s, {D(.25)} + {D(.01)} * count(*) FILTER (WHERE reach_score >= 0.8) AS r,
    {D(.2)} + {D(.01)} * count(*) FILTER (WHERE recency_score >= 0.8) AS c, {D(.2)} + {D(.01)} * count(*) FILTER (WHERE persona_weight >= 0.8) AS p
    FROM tickets JOIN scores ON document_id = source_document_id WHERE status IN ('resolved', 'closed'))""",
)
def _(spark, sf):
    done = T.tickets(spark, sf).select(F.col("source_document_id").alias("document_id"), F.col("status").isin(K.DONE_STATUSES).alias("resolution_successful"))
    cols = {"severity": "severity_score", "reach": "reach_score", "recency": "recency_score", "persona": "persona_weight"}
    rows = done.join(T.scores(spark, sf), "document_id").select("resolution_successful", *[(F.col(c) >= 0.8).alias(f"high_{k}") for k, c in cols.items()])
    out = op.weights_from_feedback(rows)
    return out.select(*[F.round(k, 9).alias(k) for k in cols])


_RANKED = "r AS (SELECT priority_score AS v, row_number() OVER (ORDER BY created_at, document_id) AS i, count(*) OVER () AS n FROM mine)"
_LRATE = f"(SELECT least(1, abs(avg(v) FILTER (WHERE i > n // 2) - avg(v) FILTER (WHERE i <= n // 2))) FROM r)"
_SPEED = "(SELECT least(1, greatest(0, 1 - 2 * avg(x))) FROM (SELECT i, var_samp(v) OVER (ORDER BY i ROWS 9 PRECEDING) AS x FROM r) WHERE i >= 10)"
_ALL = with_tables("scores").rstrip() + f", mine AS (SELECT * FROM scores), {_RANKED} "


@plan("g02_learning_rate", _ALL + f"SELECT round({_LRATE}, 9) AS learning_rate")
def _(spark, sf):
    return op.learning_rate_metric(T.scores(spark, sf)).select(F.round("learning_rate", 9).alias("learning_rate"))


@plan("g01_adaptation_speed", _ALL + f"SELECT round({_SPEED}, 9) AS adaptation_speed")
def _(spark, sf):
    return op.adaptation_speed_metric(T.scores(spark, sf)).select(F.round("adaptation_speed", 9).alias("adaptation_speed"))


@plan("g04_global_rank", with_tables("scores") + "SELECT document_id, row_number() OVER (ORDER BY priority_score, document_id) AS rank FROM scores")
def _(spark, sf):
    rows = T.scores(spark, sf).select("document_id", "priority_score")
    return global_rank(rows, ["priority_score", "document_id"]).select("document_id", "rank")


_HOURS = (
    "((epoch_us(TIMESTAMP '" + PERIOD.end + "') - epoch_us(TIMESTAMP '" + PERIOD.start + "')) / 3600000000.0)"
)
SYSTEM = with_tables("docs", "scores", "tickets", "clusters").rstrip() + f""", pd AS (SELECT * FROM docs WHERE {_IN}), pt AS (SELECT * FROM tickets WHERE {_IN}), pc AS (SELECT * FROM clusters WHERE {_IN}),
    mine AS (SELECT s.* FROM scores s JOIN pd ON pd.id = s.document_id), {_RANKED}, h AS (SELECT *, CASE WHEN status IN ('resolved', 'closed') THEN (epoch_us(updated_at) - epoch_us(created_at)) / 3600000000.0 END AS h FROM pt),
    system AS (SELECT 'overall_accuracy' AS metric, avg(priority_score) AS value FROM mine UNION ALL SELECT unnest(['precision', 'recall', 'f1_score']), count(*) FILTER (WHERE priority_score >= 0.7) / count(*) FROM mine
    UNION ALL SELECT 'prioritization_accuracy', greatest(0, 1 - 2 * var_samp(priority_score)) FROM mine UNION ALL SELECT 'weight_stability', greatest(0, 1 - stddev_samp(priority_score) / avg(priority_score)) FROM mine
    UNION ALL SELECT 'classification_accuracy', count(feedback_type) / count(*) FROM pd UNION ALL SELECT 'clustering_accuracy', count(cluster_id) / count(*) * (1 - least(1, (SELECT count(*) FROM pc) / count(*) * 0.1)) FROM pd
    UNION ALL SELECT 'processing_speed', least(1, count(*) / {_HOURS} / 100) FROM pd UNION ALL SELECT 'error_rate', 1 - count(*) FILTER (WHERE processing_status = 'failed') / count(*) FROM pd UNION ALL SELECT 'uptime', 0.999
    UNION ALL SELECT 'resolution_time_improvement', greatest(0, 1 - avg(h) / 24) FROM h UNION ALL SELECT 'user_satisfaction', avg(least({D(1)}, greatest({D(0)}, {D(.5)} + CASE WHEN h < 24 THEN {D(.3)} WHEN h < 168 THEN {D(.1)} ELSE {D(-.1)} END + CASE status WHEN 'closed' THEN {D(.2)} ELSE {D(0)} END))) FROM h WHERE h IS NOT NULL
    UNION ALL SELECT 'business_impact', avg(least({D(1)}, greatest({D(0)}, {D(.5)} + CASE feedback_type WHEN 'bug' THEN {D(.2)} WHEN 'performance' THEN {D(.1)} WHEN 'feature_request' THEN {D(-.1)} ELSE {D(0)} END + CASE WHEN component IN ('authentication', 'payment', 'core') THEN {D(.1)} ELSE {D(0)} END))) FROM pt JOIN pd ON pd.id = pt.source_document_id
    UNION ALL SELECT 'learning_rate', {_LRATE} UNION ALL SELECT 'adaptation_speed', {_SPEED}) """


def _system(spark, sf):
    return op.system_metrics(T.documents(spark, sf), T.scores(spark, sf), T.tickets(spark, sf), T.clusters(spark, sf), PERIOD)


@plan("j21_system_metrics", SYSTEM + "SELECT metric, round(value, 6) AS value FROM system")
def _(spark, sf):
    return _system(spark, sf).select("metric", F.round("value", 6).alias("value"))


def _metrics_of(name: str, *metrics: str) -> None:
    wanted = ", ".join(f"'{m}'" for m in metrics)

    @plan(name, SYSTEM + f"SELECT metric, round(value, 6) AS value FROM system WHERE metric IN ({wanted})")
    def _(spark, sf):
        return _system(spark, sf).where(F.col("metric").isin(*metrics)).select("metric", F.round("value", 6).alias("value"))


_metrics_of("j15_overall_accuracy", "overall_accuracy")
_metrics_of("j16_precision_recall", "precision", "recall", "f1_score")
_metrics_of("j17_component_accuracies", "classification_accuracy", "clustering_accuracy", "prioritization_accuracy")
_metrics_of("j18_business_metrics", "resolution_time_improvement", "user_satisfaction", "business_impact")
_metrics_of("j19_speed_and_errors", "processing_speed", "error_rate")
_metrics_of("j20_weight_stability", "weight_stability")


@plan(
    "c09_ticket_impact",
    SYSTEM + "SELECT count(*) AS tickets FROM pt JOIN pd ON pd.id = pt.source_document_id",
)
def _(spark, sf):
    docs = T.documents(spark, sf).where(PERIOD.holds()).select(F.col("id").alias("source_document_id"))
    return T.tickets(spark, sf).where(PERIOD.holds()).join(docs, "source_document_id").agg(F.count("*").alias("tickets"))


_RULES = ", ".join(f"({i}, '{r[0]}', {r[1]}, '{r[2]}', '{r[3]}', '{r[5]}')" for i, r in enumerate(op.RULES, 1))


@plan(
    "j22_recommendations",
    SYSTEM + f"""SELECT rule_no, type, priority, subject || ' is ' || printf('%.3f', value) || '.' AS description
    FROM system JOIN (VALUES {_RULES}) r(rule_no, metric, threshold, type, priority, subject) USING (metric) WHERE value < threshold""",
)
def _(spark, sf):
    return op.recommendations(_system(spark, sf)).select("rule_no", "type", "priority", "description")


_HISTORY = """history AS (SELECT o_orderpriority AS metric, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS measured_at, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"""


def _history(spark, sf):
    week = F.date_trunc("week", F.col("o_orderdate")).cast("timestamp_ntz")
    return T.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric"), week.alias("measured_at")).agg(F.avg("o_totalprice").alias("value"))


@plan("g07_metric_trends", f"WITH {_HISTORY} SELECT metric, round(arg_max(value, measured_at) - arg_min(value, measured_at), 4) AS trend FROM history GROUP BY metric")
def _(spark, sf):
    return op.metric_trends(_history(spark, sf)).select("metric", F.round("trend", 4).alias("trend"))


@plan("g08_metric_retention", f"WITH {_HISTORY} SELECT metric, count(*) AS points FROM history WHERE measured_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY metric")
def _(spark, sf):
    return op.retained(_history(spark, sf), _as_of()).groupBy("metric").agg(F.count("*").alias("points"))


# --- experiments -----------------------------------------------------------------------
_BUCKET = "(CAST('0x' || substring(md5('checkout_' || user_id), 1, 8) AS BIGINT) % 100)"
_ARM = f"CASE WHEN {_BUCKET} < 50 THEN 'treatment' ELSE 'control' END"


def _exposures(spark, sf):
    e = T.read(spark, sf, "events")
    return e.select(
        F.concat(F.lit("test_"), F.col("event_id") % 3).alias("test_name"), F.col("user_id").alias("user"), X.assign_group("checkout", F.col("user_id")).alias("arm"),
        (F.col("event_type") == "purchase").alias("success"), F.col("ts").alias("exposed_at"),
    )


@plan("j23_assignment", f"SELECT user_id, {_ARM} AS arm FROM events GROUP BY user_id")
def _(spark, sf):
    return T.read(spark, sf, "events").select("user_id", X.assign_group("checkout", F.col("user_id")).alias("arm")).distinct()


_Z = 1.959963984540054
_PVAL = f"""(SELECT least(1, greatest(0, (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))))
    FROM (SELECT z / sqrt({D(2)}) AS x, 1 / (1 + {D(0.3275911)} * z / sqrt({D(2)})) AS t))"""
ABTEST = f"""WITH x AS (SELECT 'test_' || (event_id % 3) AS test_name, {_ARM} AS arm, bool_or(event_type = 'purchase') AS success, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, user_id),
    g AS (SELECT test_name, CAST(count(*) FILTER (WHERE arm = 'control') AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE arm = 'treatment') AS DOUBLE) AS n1, count(*) FILTER (WHERE arm = 'control' AND success) AS s0, count(*) FILTER (WHERE arm = 'treatment' AND success) AS s1,
    date_diff('day', CAST(min(first_ts) AS DATE), CAST(max(last_ts) AS DATE)) AS duration_days FROM x GROUP BY 1),
    z AS (SELECT *, s0 / n0 AS c, s1 / n1 AS t1, abs(s1 / n1 - s0 / n0) / nullif(sqrt((s0 + s1) / (n0 + n1) * (1 - (s0 + s1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 0) AS z FROM g),
    r AS (SELECT *, CASE WHEN z IS NULL THEN 1 ELSE {_PVAL} END AS p FROM z)"""


@plan(
    "j24_ab_analysis",
    ABTEST + f"""SELECT test_name, round(c, 6) AS control_metric, round(t1, 6) AS treatment_metric, round(t1 - c, 6) AS effect_size, round(p, 6) AS p_value,
    round(t1 - c - {_Z} * sqrt(c * (1 - c) / n0 + t1 * (1 - t1) / n1), 6) AS ci_low, round(t1 - c + {_Z} * sqrt(c * (1 - c) / n0 + t1 * (1 - t1) / n1), 6) AS ci_high,
    p < 0.05 AS is_significant, CASE WHEN p < 0.05 AND t1 > c THEN 'Implement treatment' ELSE 'Keep control' END AS recommendation, CAST(n0 + n1 AS BIGINT) AS sample_size, duration_days FROM r""",
)
def _(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return X.analyze(_exposures(spark, sf)).select(
        "test_name", r("control_metric"), r("treatment_metric"), r("effect_size"), r("p_value"), r("ci_low"), r("ci_high"),
        "is_significant", "recommendation", "sample_size", "duration_days",
    )


@plan(
    "j25_due_tests",
    f"""SELECT test_name FROM (SELECT 'test_' || o_orderkey AS test_name, o_orderkey % 2 = 0 AS is_active, o_orderdate, 30 + o_orderkey % 60 AS d FROM orders)
    WHERE is_active AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) // 86400000000 >= d""",
)
def _(spark, sf):
    tests = T.read(spark, sf, "orders").select(
        F.concat(F.lit("test_"), F.col("o_orderkey")).alias("test_name"), (F.col("o_orderkey") % 2 == 0).alias("is_active"),
        F.col("o_orderdate").alias("created_at"), (30 + F.col("o_orderkey") % 60).alias("max_duration_days"),
    )
    return X.due(tests, _as_of()).select("test_name")


@plan("j25_stopped_tests", ABTEST + "SELECT test_name, p >= 0.05 AS is_active FROM r")
def _(spark, sf):
    exposures = _exposures(spark, sf)
    tests = exposures.select("test_name").distinct().withColumn("is_active", F.lit(True))
    return X.stop_significant(tests, X.analyze(exposures)).select("test_name", "is_active")
