"""documents (+ clusters) → priority scores, ranking and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import scores as S
from echoloom.functions.text import compute_once, text_or_empty, word_count


def scorable(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Classified, completed and not yet scored."""
    ready = docs.where(F.col("feedback_type").isNotNull() & (F.col("processing_status") == "completed"))
    return ready.join(scores.select(F.col("document_id").alias("id")), "id", "left_anti")


def temporal_coherence(members: DataFrame) -> DataFrame:
    """Per cluster: 1 − mean |Δt| / day over pairs with different times, not below 0.

    The pair sum comes from counts, never from pairs. Equal times are added up first.
    The sum then splits in two levels: pairs inside one hour and pairs across hours, so
    that no task ever sorts a whole cluster; one holding a third of all rows is spread
    over its hours, and the window across hours runs over one row per hour.
    """
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    points = (
        members.where(F.col("timestamp").isNotNull())
        .groupBy("cluster_id", micros.alias("t"))
        .agg(F.count("*").alias("m"))
        .withColumn("hour", F.floor(F.col("t") / F.lit(3_600_000_000)))
        # seconds since the hour, so that the squares stay small and exact
        .withColumn("x", (F.col("t") - F.col("hour") * F.lit(3_600_000_000)) / F.lit(1e6))
    )
    before = W.partitionBy("cluster_id", "hour").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    inside = points.withColumn("lower", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn(
        "lower_x", F.coalesce(F.sum(F.col("m") * F.col("x")).over(before), F.lit(0.0))
    )
    hours = inside.groupBy("cluster_id", "hour").agg(
        F.sum("m").alias("n"),
        F.sum(F.col("m") * F.col("x")).alias("sx"),
        F.sum(F.col("m") * (F.col("x") * F.col("lower") - F.col("lower_x"))).alias("within"),
        F.sum(F.col("m") * F.col("m")).alias("ties"),
    )
    hours = hours.withColumn("s", F.col("sx") + F.col("n") * F.col("hour") * F.lit(3600.0))
    earlier = W.partitionBy("cluster_id").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    across = hours.withColumn("n0", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn(
        "s0", F.coalesce(F.sum("s").over(earlier), F.lit(0.0))
    )
    total = across.groupBy("cluster_id").agg(
        F.sum(F.col("within") + F.col("s") * F.col("n0") - F.col("n") * F.col("s0")).alias("pair_sum"),
        F.sum("n").alias("n"),
        F.sum("ties").alias("ties"),
    )
    pairs = F.col("n") * F.col("n") - F.col("ties")
    mean = F.when(pairs > 0, 2 * F.col("pair_sum") / pairs).otherwise(0.0)
    coherence = F.greatest(F.lit(0.0), 1 - mean / F.lit(86400.0))
    return total.select("cluster_id", F.when(F.col("n") > 1, coherence).otherwise(0.5).alias("temporal_coherence"))


def cluster_stats(docs: DataFrame, memberships: DataFrame) -> DataFrame:
    """Size, mean similarity, temporal coherence, user diversity and quality per cluster."""
    members = memberships.join(docs.select(F.col("id").alias("document_id"), "timestamp", "author"), "document_id", "left")
    found = F.col("timestamp").isNotNull()
    # two steps: distinct authors first, so that one hot cluster is counted in parallel
    similarity = F.when(F.col("similarity_score") != 0, F.col("similarity_score"))
    by_author = members.groupBy("cluster_id", "author").agg(
        F.count("*").alias("size"),
        F.count_if(found).alias("found"),
        F.sum(similarity).alias("sim_sum"),
        F.count(similarity).alias("sim_n"),
    )
    sized = by_author.groupBy("cluster_id").agg(
        F.sum("size").alias("size"),
        F.sum("found").alias("found"),
        F.sum("sim_sum").alias("sim_sum"),
        F.sum("sim_n").alias("sim_n"),
        F.count_if(F.col("author").isNotNull() & (F.col("author") != "")).alias("authors"),
    )
    stats = sized.join(temporal_coherence(members), "cluster_id", "left").select(
        "cluster_id",
        "size",
        F.when(F.col("sim_n") > 0, F.col("sim_sum") / F.col("sim_n")).otherwise(0.5).alias("avg_similarity"),
        F.coalesce("temporal_coherence", F.lit(0.5)).alias("temporal_coherence"),
        F.when(F.col("found") > 0, F.col("authors") / F.col("found")).otherwise(0.5).alias("user_diversity"),
    )
    return stats.withColumn(
        "quality", S.cluster_quality(F.col("avg_similarity"), F.col("temporal_coherence"), F.col("user_diversity"))
    )


def text_facts(docs: DataFrame) -> DataFrame:
    """`feedback_quality` and `urgency` in place of the body.

    Each step is a column of its own: a value that many expressions use is computed once, in generated code.
    """
    df = compute_once(docs, "__body", F.lower(text_or_empty(F.col("body"))))
    df = compute_once(df, "__words", word_count(F.col("__body")))
    df = compute_once(df, "__points", S.quality_points(F.col("__body"), F.col("__words")))
    df = compute_once(df, "feedback_quality", S.quality_level(F.col("__body"), F.col("__points")))
    df = compute_once(df, "__all", S.urgency_text(F.col("title"), F.col("body")))
    df = compute_once(df, "urgency", S.urgency_found(F.col("__all")))
    return df.drop("body", "__body", "__words", "__points", "__all")


def with_cluster(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Left join on `cluster_id`; documents without a cluster are dealt over all tasks by their id."""
    deal = F.when(F.col("cluster_id").isNull(), 1 + F.pmod(F.xxhash64("id"), F.lit(1 << 20))).otherwise(F.lit(0).cast("bigint"))
    left = docs.withColumn("__key", F.struct(F.col("cluster_id").alias("c"), deal.alias("deal")))
    right = facts.withColumn("__key", F.struct(F.col("cluster_id").alias("c"), F.lit(0).cast("bigint").alias("deal"))).drop("cluster_id")
    return left.join(right, "__key", "left").drop("__key")


def score_documents(
    docs: DataFrame,
    stats: DataFrame | None,
    as_of: Column,
    weights: dict[str, float] | None = None,
    severity_col: str = "severity",
    min_cluster_size: int = 2,
    revenue_components=K.REVENUE_COMPONENTS,
    context_boost: bool = False,
    max_score: float = 1.0,
) -> DataFrame:
    """One score row per document; cluster statistics join on `cluster_id`."""
    w = S.normalized(weights or K.WEIGHTS)
    df = text_facts(docs)  # before the join: the bodies stay where they are read
    if stats is not None:
        facts = stats.select("cluster_id", F.col("size").alias("cluster_size"), F.col("quality").alias("cluster_quality"))
        df = with_cluster(df, facts)
    else:
        df = df.withColumn("cluster_size", F.lit(None).cast("bigint")).withColumn("cluster_quality", F.lit(None).cast("double"))
    value = F.col("user_value") if "user_value" in df.columns else F.lit(None).cast("double")
    df = df.withColumns(
        {
            "component": F.coalesce("component", F.lit("other")),
            "severity": F.coalesce(F.col(severity_col), F.lit("low")),
            "user_segment": S.user_segment(F.col("author")),
            "user_count": F.coalesce("cluster_size", F.lit(1)),
        }
    )
    severity_value = S.severity_score(F.col("severity"))
    if context_boost:
        severity_value = F.least(severity_value * S.severity_boost(F.col("feedback_type"), F.col("component")), F.lit(1.0))
    amp = S.amplification(F.col("cluster_size"), F.col("cluster_quality"), min_cluster_size)
    df = df.withColumns(
        {
            "severity_score": severity_value,
            "reach_score": S.reach_score(F.col("user_count"), F.col("user_segment"), F.col("component")),
            "recency_score": S.recency_score(F.col("timestamp"), as_of),
            "persona_weight": S.persona_score(F.col("user_segment"), value, F.col("feedback_quality")),
            "cluster_amplification": F.when(F.col("cluster_size").isNull(), 1.0).otherwise(amp),
            "urgency_boost": S.urgency_boost(F.col("urgency")),
            "revenue_impact_multiplier": S.revenue_boost(F.col("component"), revenue_components),
        }
    )
    overall = (
        F.col("severity_score") * F.lit(w["severity"])
        + F.col("reach_score") * F.lit(w["reach"])
        + F.col("recency_score") * F.lit(w["recency"])
        + F.col("persona_weight") * F.lit(w["persona"])
    )
    boosted = overall * F.col("cluster_amplification") * F.col("urgency_boost") * F.col("revenue_impact_multiplier")
    df = df.withColumn("priority_score", F.least(boosted, F.lit(max_score)))
    level = S.priority_level(F.col("priority_score"))
    return df.select(
        F.col("id").alias("document_id"),
        F.col("cluster_id"),
        "title",
        "component",
        "severity_score",
        "reach_score",
        "recency_score",
        "persona_weight",
        "cluster_amplification",
        "urgency_boost",
        "revenue_impact_multiplier",
        (F.col("revenue_impact_multiplier") > 1.0).alias("is_revenue_critical"),
        "priority_score",
        level.alias("priority_name"),
        S.level_number(level).alias("priority_level"),
        S.score_reasoning(
            F.col("severity"), F.col("severity_score"), F.col("user_count"), F.col("cluster_amplification"),
            F.coalesce("cluster_size", F.lit(1)), F.col("urgency_boost"), F.col("revenue_impact_multiplier"), F.col("component"),
        ).alias("reasoning"),
    )


def ranking(scores: DataFrame, docs: DataFrame, limit: int = 100) -> DataFrame:
    """Top scores with their documents, numbered; the top-k runs before the join."""
    top = scores.orderBy(F.col("priority_score").desc(), "document_id").limit(limit)
    top = top.withColumn("rank", F.row_number().over(W.orderBy(F.col("priority_score").desc(), "document_id")))
    facts = docs.select(F.col("id").alias("document_id"), "title", "component")
    # `limit` bounds the broadcast side
    top = top.drop("title", "component")
    joined = F.broadcast(top).join(facts, "document_id") if limit <= 10_000 else top.join(facts, "document_id")
    return joined.orderBy("rank")


def level_distribution(scores: DataFrame) -> DataFrame:
    """Count per level, levels without scores included."""
    spark = scores.sparkSession
    levels = spark.createDataFrame([(v, k) for k, v in K.PRIORITY_LEVELS.items()], "priority_level int, level string")
    counts = scores.groupBy("priority_level").agg(F.count("*").alias("n"))
    return levels.join(counts, "priority_level", "left").select("level", F.coalesce("n", F.lit(0)).alias("documents"))


def prioritization_stats(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Count and mean score, overall (component NULL) and per component."""
    joined = scores.select("document_id", "priority_score").join(
        docs.select(F.col("id").alias("document_id"), "component"), "document_id"
    )
    per = joined.groupBy("component").agg(F.count("*").alias("scores"), F.sum("priority_score").alias("s"))
    total = scores.agg(F.count("*").alias("scores"), F.sum("priority_score").alias("s"))
    mean = (F.col("s") / F.col("scores")).alias("average_priority_score")
    return per.select(F.coalesce("component", F.lit("(none)")).alias("component"), "scores", mean).unionByName(
        total.select(F.lit("(all)").alias("component"), "scores", mean)
    )


def replace_by_key(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows win over current rows with the same key."""
    kept = current.join(incoming.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)
