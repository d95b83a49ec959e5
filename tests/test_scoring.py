from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echoloom.functions import scores as S
from echoloom.operators import scoring


@pytest.mark.parametrize("severity, want", [("critical", 1.0), ("HIGH", 0.8), ("medium", 0.6), ("low", 0.4), ("minimal", 0.2), ("unknown", 0.2)])
def test_severity(one, severity, want):
    assert one(s=severity)(S.severity_score(F.col("s"))) == want


@pytest.mark.parametrize("kind, part, want", [("bug", "security", 1.2), ("bug", "ui", 1.1), ("feature_request", "ui", 0.9), ("other", "ui", 1.0)])
def test_severity_boost(one, kind, part, want):
    assert one(k=kind, p=part)(S.severity_boost(F.col("k"), F.col("p"))) == want


@pytest.mark.parametrize("users, want", [(0, 0.0), (1, 0.1), (10, 0.3), (50, 0.5), (100, 0.7), (500, 0.8), (1000, 0.9)])
def test_reach(one, users, want):
    assert one(u=users)(S.reach_score(F.col("u"), F.lit("individual"), F.lit("ui"))) == want


def test_reach_is_capped_and_unknown_segments_do_not_fail(one):
    assert one(u=1000)(S.reach_score(F.col("u"), F.lit("enterprise"), F.lit("api"))) == 1.0
    assert one(u=1000)(S.reach_score(F.col("u"), F.lit("martian"), F.lit("ui"))) == pytest.approx(0.81)


def test_recency_steps(one):
    now = datetime(2024, 1, 31)
    got = [one(t=now - timedelta(hours=h))(S.recency_score(F.col("t"), F.lit(now))) for h in (0, 1, 24, 25, 72, 168, 720, 721)]
    assert got == [1.0, 1.0, 0.9, 0.7, 0.7, 0.5, 0.3, 0.1]


@pytest.mark.parametrize("trend, want", [(0.6, 1.2), (0.3, 1.1), (0.1, 1.0), (None, 1.0)])
def test_trend_boost(one, trend, want):
    assert one(t=F.lit(trend).cast("double"))(S.trend_boost(F.col("t"))) == want


@pytest.mark.parametrize("segment, want", [("enterprise", 0.9), ("professional", 0.7), ("individual", 0.5), ("trial", 0.3), ("unknown", 0.4)])
def test_persona(one, segment, want):
    none = F.lit(None)
    assert one(s=segment)(S.persona_score(F.col("s"), none.cast("double"), none.cast("string"))) == want


@pytest.mark.parametrize("size, least, want", [(1, 2, 1.0), (2, 3, 1.0), (10, 2, 1.9)])
def test_amplification(one, size, least, want):
    assert one(n=size)(S.amplification(F.col("n"), F.lit(1.0), least)) == pytest.approx(want)


def test_cluster_quality(one):
    assert one(a=0.8)(S.cluster_quality(F.col("a"), F.lit(0.7), F.lit(0.6))) == pytest.approx(0.7)


def test_urgency(one):
    row = one(t="Critical and urgent", b="blocking us")
    found = row(S.urgency_indicators(F.col("t"), F.col("b")))
    assert {"critical", "urgent", "blocking"} <= set(found)
    assert one(t="nice", b="thing")(S.urgency_indicators(F.col("t"), F.col("b"))) == []


@pytest.mark.parametrize("part, want", [("authentication", 1.15), ("payment", 1.15), ("ui", 1.0)])
def test_revenue(one, part, want):
    assert one(c=part)(S.revenue_boost(F.col("c"))) == want


@pytest.mark.parametrize("author, want", [("Big_Corp", "enterprise"), ("prof", "professional"), ("tester", "trial"), ("bob", "individual"), ("", "unknown"), (None, "unknown")])
def test_segment(one, author, want):
    assert one(a=F.lit(author).cast("string"))(S.user_segment(F.col("a"))) == want


def test_coherence_equals_the_pair_definition(spark):
    import itertools
    import random

    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = [(c, base + timedelta(seconds=rng.choice([0, 60, 3599, 3600, 7300, rng.randrange(20000)]))) for c in range(6) for _ in range(c * 4 + 1)]
    got = {r["cluster_id"]: r["temporal_coherence"] for r in scoring.temporal_coherence(spark.createDataFrame(rows, "cluster_id int, timestamp timestamp_ntz")).collect()}
    for c in range(6):
        times = [t for k, t in rows if k == c]
        diffs = [abs((a - b).total_seconds()) for a, b in itertools.product(times, times) if a != b]
        want = 0.5 if len(times) < 2 else max(0, 1 - (sum(diffs) / len(diffs) if diffs else 0) / 86400)
        assert got[c] == pytest.approx(want)


def test_documents_without_cluster_are_scored_in_all_tasks(spark):
    """They have one join key, NULL, and used to meet in one task; the others keep their cluster's facts."""
    rows = [(i, None if i < 400 else i % 3, "t", "slow page" if i else None, "bob") for i in range(430)]
    docs = spark.createDataFrame(rows, "id int, cluster_id int, title string, body string, author string").selectExpr(
        "*", "timestamp_ntz '2024-01-01' AS timestamp", "'ui' AS component", "'bug' AS feedback_type", "'low' AS severity"
    )
    stats = spark.createDataFrame([(0, 20, 0.5), (1, 30, 1.0), (None, 99, 1.0)], "cluster_id int, size bigint, quality double")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = scoring.score_documents(docs, stats, F.lit(datetime(2024, 1, 2))).select("document_id", "cluster_id", "cluster_amplification", F.spark_partition_id().alias("task")).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(out) == 430 and all(r["cluster_id"] == rows[r["document_id"]][1] for r in out)
    want = {None: 1.0, 0: 2.9 * 0.5, 1: 3.9, 2: 1.0}
    assert all(r["cluster_amplification"] == pytest.approx(want[r["cluster_id"]]) for r in out)
    tasks = [r["task"] for r in out if r["cluster_id"] is None]
    assert max(tasks.count(t) for t in set(tasks)) < 250


def test_large_tables_get_tasks_of_bounded_size(spark):
    from echoloom.plans import tables as T

    rows = spark.range(1000).coalesce(1)
    slots = spark.sparkContext.defaultParallelism
    assert T.spread(rows).rdd.getNumPartitions() == slots and T.spread(rows, 10).rdd.getNumPartitions() == 100
    assert T.spread(rows, 10_000).rdd.getNumPartitions() == slots
