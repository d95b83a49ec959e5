"""Health of the jobs from their execution tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom import constants as K

_RANK = {"healthy": 1, "unknown": 1, "degraded": 2, "unhealthy": 3}


def agent_metrics(executions: DataFrame, as_of: Column, hours: int = 1, agents=K.AGENTS) -> DataFrame:
    """Runs, mean duration of good runs, success rate, items, last run, errors; zeros for idle agents."""
    recent = executions.where(F.col("started_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    ok = F.col("status") == "completed"
    found = recent.groupBy("agent_name").agg(
        F.count("*").alias("executions"),
        F.count_if(ok).alias("successes"),
        F.avg(F.when(ok, F.coalesce("duration_seconds", F.lit(0.0)))).alias("avg_execution_time"),
        F.sum(F.coalesce("items_processed", F.lit(0))).alias("items_processed"),
        F.max("started_at").alias("last_execution"),
        F.count_if(F.col("status") == "failed").alias("errors"),
    )
    names = executions.sparkSession.createDataFrame([(a,) for a in agents], "agent_name string")
    out = names.join(found, "agent_name", "left").na.fill(0, ["executions", "successes", "avg_execution_time", "items_processed", "errors"])
    rate = F.when(F.col("executions") > 0, F.col("successes") / F.col("executions")).otherwise(0.0)
    return out.withColumn("success_rate", rate).drop("successes")


def agent_health(metrics: DataFrame) -> DataFrame:
    rate = F.col("success_rate")
    status = F.when(F.col("executions") == 0, "unknown").when(rate >= 0.9, "healthy").when(rate >= 0.7, "degraded").otherwise("unhealthy")
    return metrics.select("agent_name", status.alias("status"), "success_rate", "executions")


def overall_health(checks: DataFrame) -> DataFrame:
    """The worst status counts; unknown agents count as healthy, no checks at all as unknown."""
    rank = F.create_map(*[x for k, v in _RANK.items() for x in (F.lit(k), F.lit(v))])
    worst = checks.agg(F.max(rank[F.col("status")]).alias("r"))
    return worst.select(F.when(F.col("r") == 3, "unhealthy").when(F.col("r") == 2, "degraded").when(F.col("r") == 1, "healthy").otherwise("unknown").alias("status"))


def workflow_metrics(executions: DataFrame) -> DataFrame:
    return executions.groupBy("workflow_name").agg(
        F.count("*").alias("total_executions"),
        F.count_if(F.col("status") == "completed").alias("successful_executions"),
        F.count_if(F.col("status") == "failed").alias("failed_executions"),
        (F.count_if(F.col("status") == "completed") / F.count("*")).alias("success_rate"),
        F.avg("duration_seconds").alias("average_duration"),
    )


def job_metrics(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs, enabled jobs, runs, good runs and success rate."""
    per_job = runs.groupBy("job_id").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("good"))
    joined = jobs.join(per_job, jobs["id"] == per_job["job_id"], "left")
    out = joined.agg(
        F.count("*").alias("total_jobs"),
        F.count_if("enabled").alias("enabled_jobs"),
        F.coalesce(F.sum("runs"), F.lit(0)).alias("total_executions"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("successful_executions"),
    )
    rate = F.when(F.col("total_executions") > 0, F.col("successful_executions") / F.col("total_executions")).otherwise(0.0)
    return out.withColumn("success_rate", rate)
