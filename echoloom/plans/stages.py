"""Composed jobs with taken and skipped stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.operators.stages import Stage, run_stages
from echoloom.plans import tables as T
from echoloom.plans.registry import plan


def _composed(spark, sf, least: int) -> DataFrame:
    """Counts by source: short texts leave, and where texts repeat more than `least` times only the first of each stays."""
    docs = T.read(spark, sf, "documents").select("doc_id", "source", "text")
    counted = lambda df: df.groupBy("source").agg(F.count("*").alias("items"), F.sum("doc_id").alias("ids"))
    first = lambda df: df.groupBy("text").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("r")).select("r.doc_id", "r.source", "text")
    repeats = F.count("*") - F.count_distinct("text") > least
    stages = [
        Stage("long_texts", lambda df: df, valid=F.length("text") >= 20),
        Stage("first_copies", first, condition=repeats, after=("long_texts",)),
        Stage("by_source", counted, condition=F.count("*") > 0, finish=lambda df: df.withColumn("mean_id", F.round(F.col("ids") / F.col("items"), 6)).drop("ids")),
        Stage("never", lambda df: df.limit(0), enabled=False),
    ]
    out, said = run_stages(docs, stages)
    return out.withColumn("first_copies", F.lit(said["first_copies"]))


_LONG = "long_ones AS (SELECT doc_id, source, text FROM documents WHERE length(text) >= 20)"
_COUNTS = "SELECT source, count(*) AS items, round(sum(doc_id) / count(*), 6) AS mean_id, '{0}' AS first_copies FROM {1} GROUP BY source"


@plan("l01_stage_taken", f"WITH {_LONG}, firsts AS (SELECT arg_min(source, doc_id) AS source, min(doc_id) AS doc_id FROM long_ones GROUP BY text) " + _COUNTS.format("taken", "firsts"))
def _(spark, sf):
    return _composed(spark, sf, least=0)


@plan("l02_stage_skipped", f"WITH {_LONG} " + _COUNTS.format("skipped", "long_ones"))
def _(spark, sf):
    return _composed(spark, sf, least=1 << 40)
