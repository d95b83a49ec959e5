"""Execution health and admission limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.operators import health as H
from echoloom.operators import limits as L
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.tables import with_tables

_END = "2024-01-15 00:00:00"
def _as_of():
    return F.lit(_END).cast("timestamp_ntz")

_HOURS = 24
_NAMES = ", ".join(f"('{a}')" for a in K.AGENTS)
METRICS = with_tables("executions").rstrip() + f""", recent AS (SELECT * FROM executions WHERE started_at >= TIMESTAMP '{_END}' - INTERVAL {_HOURS} HOUR),
    metrics AS (SELECT a.agent_name, count(execution_id) AS executions, coalesce(avg(duration_seconds) FILTER (WHERE status = 'completed'), 0) AS avg_execution_time,
    coalesce(count(*) FILTER (WHERE status = 'completed') / nullif(count(execution_id), 0), 0) AS success_rate, CAST(coalesce(sum(items_processed), 0) AS BIGINT) AS items_processed,
    count(*) FILTER (WHERE status = 'failed') AS errors, max(started_at) AS last_execution FROM (VALUES {_NAMES}) a(agent_name) LEFT JOIN recent r ON r.agent_name = a.agent_name GROUP BY 1),
    health AS (SELECT *, CASE WHEN executions = 0 THEN 'unknown' WHEN success_rate >= 0.9 THEN 'healthy' WHEN success_rate >= 0.7 THEN 'degraded' ELSE 'unhealthy' END AS status FROM metrics) """


def _metrics(spark, sf):
    return H.agent_metrics(T.executions(spark, sf), _as_of(), _HOURS)


@plan(
    "d19_agent_metrics",
    METRICS + "SELECT agent_name, executions, round(avg_execution_time, 6) AS avg_execution_time, round(success_rate, 6) AS success_rate, items_processed, errors, epoch_us(last_execution) AS last_us FROM metrics",
)
def _(spark, sf):
    return _metrics(spark, sf).select(
        "agent_name", "executions", F.round("avg_execution_time", 6).alias("avg_execution_time"), F.round("success_rate", 6).alias("success_rate"),
        "items_processed", "errors", F.unix_micros(F.col("last_execution").cast("timestamp")).alias("last_us"),
    )


@plan("d20_agent_health", METRICS + "SELECT agent_name, status FROM health")
def _(spark, sf):
    return H.agent_health(_metrics(spark, sf)).select("agent_name", "status")


@plan(
    "d21_overall_health",
    METRICS + "SELECT CASE WHEN count(*) FILTER (WHERE status = 'unhealthy') > 0 THEN 'unhealthy' WHEN count(*) FILTER (WHERE status = 'degraded') > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM health",
)
def _(spark, sf):
    return H.overall_health(H.agent_health(_metrics(spark, sf)))


@plan(
    "d22_workflow_metrics",
    with_tables("executions")
    + """SELECT workflow_name, count(*) AS total_executions, count(*) FILTER (WHERE status = 'completed') AS successful_executions, count(*) FILTER (WHERE status = 'failed') AS failed_executions,
    round(count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS success_rate, round(avg(duration_seconds), 6) AS average_duration FROM executions GROUP BY 1""",
)
def _(spark, sf):
    out = H.workflow_metrics(T.executions(spark, sf))
    return out.withColumn("success_rate", F.round("success_rate", 6)).withColumn("average_duration", F.round("average_duration", 6))


@plan(
    "d23_job_metrics",
    with_tables("executions")
    + """SELECT count(*) AS total_jobs, count(*) FILTER (WHERE enabled) AS enabled_jobs, CAST(sum(n) AS BIGINT) AS total_executions, CAST(sum(ok) AS BIGINT) AS successful_executions, round(sum(ok) / sum(n), 6) AS success_rate
    FROM (SELECT n_nationkey AS id, n_nationkey % 3 <> 0 AS enabled FROM nation) LEFT JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS ok FROM executions GROUP BY 1) ON job_id = id""",
)
def _(spark, sf):
    jobs = T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    return H.job_metrics(jobs, T.executions(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@plan(
    "g09_recent_requests",
    "SELECT event_id, 20 - least(20, n) AS remaining, n AS current_requests FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events)",
)
def _(spark, sf):
    out = L.rate_info(L.recent_requests(T.read(spark, sf, "events"), "event_type", "ts"), 20)
    return out.select("event_id", "remaining", "current_requests")


# The greedy rule in SQL: walk each key's events in order, carrying the last admitted time.
@plan(
    "j26_alert_cooldown",
    f"""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT event_id, event_type, i, t AS last, true AS admitted FROM e WHERE i = 1 UNION ALL
    SELECT e.event_id, e.event_type, e.i, CASE WHEN e.t >= w.last + {K.ALERT_COOLDOWN_SECONDS}000000 THEN e.t ELSE w.last END, e.t >= w.last + {K.ALERT_COOLDOWN_SECONDS}000000
    FROM w JOIN e ON e.event_type = w.event_type AND e.i = w.i + 1) SELECT event_id, admitted FROM w""",
)
def _(spark, sf):
    return L.admit(T.read(spark, sf, "events"), "event_type", "ts", "event_id", L.Cooldown(K.ALERT_COOLDOWN_SECONDS))


@plan(
    "j28_notification_cap",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT event_id, event_type, i, t + 3600000000 AS until, 1 AS n, true AS admitted FROM e WHERE i = 1 UNION ALL
    SELECT e.event_id, e.event_type, e.i, CASE WHEN e.t >= w.until THEN e.t + 3600000000 ELSE w.until END, CASE WHEN e.t >= w.until THEN 1 ELSE least(w.n + 1, 3) END,
    e.t >= w.until OR w.n < 2 FROM w JOIN e ON e.event_type = w.event_type AND e.i = w.i + 1) SELECT event_id, admitted FROM w""",
)
def _(spark, sf):
    return L.admit(T.read(spark, sf, "events"), "event_type", "ts", "event_id", L.HourlyCap(2))


def _log_oracle(key: str, limit: int, seconds: int) -> str:
    """The last `limit` admitted times in order, oldest first; a request is admitted when the oldest is `seconds` old."""
    wait, last = seconds * 1_000_000, [f"a{k}" for k in range(limit)]
    ok = f"(w.a0 IS NULL OR w.a0 <= e.t - {wait})"
    moved = ", ".join(f"CASE WHEN {ok} THEN {following} ELSE w.{mine} END" for mine, following in zip(last, [*[f"w.{a}" for a in last[1:]], "e.t"]))
    first = ", ".join([*["NULL::BIGINT AS " + a for a in last[:-1]], f"t AS {last[-1]}"])
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT event_id, key, i, {first}, true AS admitted FROM e WHERE i = 1 UNION ALL
    SELECT e.event_id, e.key, e.i, {moved}, {ok} FROM w JOIN e ON e.key IS NOT DISTINCT FROM w.key AND e.i = w.i + 1) SELECT event_id, admitted FROM w"""


@plan("k04_request_admission", _log_oracle("event_type", 2, 3600))
def _(spark, sf):
    return L.admit(T.read(spark, sf, "events"), "event_type", "ts", "event_id", L.SlidingLog(2, 3600))


@plan("k04_request_admission_by_user", _log_oracle("user_id", 1, 86400))
def _(spark, sf):
    return L.admit(T.read(spark, sf, "events"), "user_id", "ts", "event_id", L.SlidingLog(1, 86400))


_CLASSES = {"click": "workflow", "view": "report", "purchase": "admin"}
_CLASS_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in _CLASSES.items()) + " ELSE 'default' END"
_LIMIT_SQL = f"CASE {_CLASS_SQL} " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in K.REQUEST_LIMITS.items()) + " END"


@plan(
    "k04_documented_limits",
    f"""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS t, {_LIMIT_SQL} AS lim, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT event_id, event_type, i, [t] AS log, true AS admitted, lim, t FROM e WHERE i = 1 UNION ALL
    SELECT e.event_id, e.event_type, e.i, CASE WHEN len(list_filter(w.log, lambda x: x > e.t - 86400000000)) < e.lim THEN list_append(list_filter(w.log, lambda x: x > e.t - 86400000000), e.t)
    ELSE list_filter(w.log, lambda x: x > e.t - 86400000000) END, len(list_filter(w.log, lambda x: x > e.t - 86400000000)) < e.lim, e.lim, e.t FROM w JOIN e ON e.event_type = w.event_type AND e.i = w.i + 1)
    SELECT event_id, admitted, lim AS "limit", CASE WHEN admitted THEN lim - max(len(log)) OVER (PARTITION BY event_type, t) ELSE 0 END AS remaining FROM w""",
)
def _(spark, sf):
    """The documented limits by class of endpoint, per day so that the test events reach them."""
    events = T.read(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for pair in _CLASSES.items() for x in pair])
    return L.admit_by_class(events.withColumn("class", kinds[F.col("event_type")]), "event_type", "class", "ts", "event_id", K.REQUEST_LIMITS, 86400)
