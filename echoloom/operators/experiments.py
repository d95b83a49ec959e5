"""A/B assignment and analysis."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_group(test: str, user: Column, split: float = 0.5, active: bool = True) -> Column:
    """Stable arm: the first 32 bits of md5(test_user) modulo 100 against the split."""
    if not active:
        return F.lit("control")
    digest = F.md5(F.encode(F.concat(F.lit(test + "_"), user.cast("string")), "UTF-8"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return F.when(bucket < split * 100, "treatment").otherwise("control")


def _two_sided_p(z: Column) -> Column:
    """2·(1 − Φ(z)) by the rational approximation 7.1.26 of Abramowitz and Stegun (error < 2e-7)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), poly * t * F.exp(-x * x)))


def analyze(exposures: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Two-proportion z test per test over (test_name, user, arm, success, exposed_at) rows.

    Users are the units: one counts once for each test, as a success if any exposure was one.
    """
    exposures = exposures.groupBy("test_name", "user", "arm").agg(
        F.bool_or("success").alias("success"), F.min("exposed_at").alias("first"), F.max("exposed_at").alias("last"),
    )
    treated, success = F.col("arm") == "treatment", F.col("success")
    n = exposures.groupBy("test_name").agg(
        F.count_if(~treated).alias("n0"), F.count_if(treated).alias("n1"),
        F.count_if(~treated & success).alias("s0"), F.count_if(treated & success).alias("s1"),
        F.datediff(F.max("last"), F.min("first")).alias("duration_days"),
    ).where((F.col("n0") > 0) & (F.col("n1") > 0))
    n = n.withColumn("control_metric", F.col("s0") / F.col("n0")).withColumn("treatment_metric", F.col("s1") / F.col("n1"))
    n = n.withColumn("effect_size", F.col("treatment_metric") - F.col("control_metric"))
    pooled = (F.col("s0") + F.col("s1")) / (F.col("n0") + F.col("n1"))
    pooled_error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n0") + 1 / F.col("n1")))
    spread = lambda p, k: F.col(p) * (1 - F.col(p)) / F.col(k)
    margin = F.lit(NormalDist().inv_cdf(0.5 + confidence / 2)) * F.sqrt(spread("control_metric", "n0") + spread("treatment_metric", "n1"))
    z = F.abs("effect_size") / F.nullif(pooled_error, F.lit(0.0))
    n = n.withColumn("p_value", F.when(z.isNull(), 1.0).otherwise(_two_sided_p(z))).withColumn("margin", margin)
    n = n.withColumn("is_significant", F.col("p_value") < 1 - confidence)
    win = F.col("is_significant") & (F.col("effect_size") > 0)
    return n.select(
        "test_name", "control_metric", "treatment_metric", "effect_size",
        (F.col("effect_size") - F.col("margin")).alias("ci_low"), (F.col("effect_size") + F.col("margin")).alias("ci_high"),
        "p_value", "is_significant", F.when(win, "Implement treatment").otherwise("Keep control").alias("recommendation"),
        (F.col("n0") + F.col("n1")).alias("sample_size"), "duration_days",
    )


def due(tests: DataFrame, as_of: Column) -> DataFrame:
    """Active tests that ran for their full duration."""
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400_000_000))
    return tests.where(F.col("is_active") & (age >= F.col("max_duration_days")))


def stop_significant(tests: DataFrame, results: DataFrame) -> DataFrame:
    """Due tests with a significant result become inactive."""
    stopped = results.where("is_significant").select("test_name", F.lit(True).alias("__stop"))
    out = tests.join(stopped, "test_name", "left")
    return out.withColumn("is_active", F.col("is_active") & F.col("__stop").isNull()).drop("__stop")
