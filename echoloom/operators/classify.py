"""documents ⋈ model replies → classified documents and classification metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions import replies as R
from echoloom.functions.text import text_or_empty
from echoloom.operators.ordering import global_rank


def unclassified(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("feedback_type").isNull())


def render_prompts(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """One request text per document; the allowed labels come from the fixed enums."""
    head = (
        "Classify one piece of product feedback and answer with one JSON object with the keys "
        "feedback_type, severity_level, component, type_confidence, severity_confidence, component_confidence, "
        "version, keywords, sentiment, urgency_indicators.\n"
        f"feedback_type: {', '.join(K.FEEDBACK_TYPES)}\nseverity_level: {', '.join(K.SEVERITY_LEVELS)}\n"
        f"component: {', '.join(K.COMPONENTS)}\n"
    )
    prompt = F.concat(
        F.lit(head + "Title: "), text_or_empty(F.col("title")), F.lit("\nContent: "), text_or_empty(F.col("body")),
        F.lit("\nAuthor: "), F.coalesce("author", F.lit("unknown")), F.lit("\nSource: processed_document"),
    )
    return docs.select(F.col(id_col).alias("id"), prompt.alias("prompt"))


def render_batches(docs: DataFrame, size: int = 20) -> DataFrame:
    """Requests for `size` documents each, in the order of their ids: batch number and the JSON list of items.

    All batches but the last hold exactly `size` documents, whatever the ids look like.
    """
    item = F.struct(
        F.col("id").cast("string").alias("item_id"), "title", F.col("body").alias("content"),
        F.coalesce("author", F.lit("unknown")).alias("author"), F.lit("processed_document").alias("source_type"),
    )
    ranked = global_rank(docs.select("id", item.alias("item")), ["id"])
    keyed = ranked.select(F.floor((F.col("rank") - 1) / size).alias("batch_id"), "id", "item")
    return keyed.groupBy("batch_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"])).alias("feedback_items"),
        F.count("*").alias("items"),
    )


def ask(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Run a user-supplied model over the prompts, one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "reply": model(batch["prompt"].tolist())})

    return prompts.mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, reply string")


def align_batch_replies(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """The i-th reply of a batch belongs to its i-th document; an item_id in it wins.

    `batches` holds (batch_id, pos, id), `replies` (batch_id, reply) with a JSON list.
    """
    spans = replies.withColumn("span", R.repair_steps(R.json_span(F.col("reply"), "[", "]"))[0])
    items = spans.select("batch_id", F.posexplode(F.from_json("span", f"array<struct<{_ddl_to_struct(R.REPLY)}>>")).alias("pos", "item"))
    placed = items.join(batches, ["batch_id", "pos"])
    own = F.col("item.item_id").cast(batches.schema["id"].dataType)
    return placed.select(F.coalesce(own, F.col("id")).alias("id"), F.col("item"))


def _ddl_to_struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ", 1) for part in ddl.split(", ")))


def classify_replies(replies: DataFrame) -> DataFrame:
    """(id, reply text) → one classified row per usable reply."""
    df = R.parse_columns(replies, "reply").where(F.col("reply_json").isNotNull())
    return classify_parsed(df.select("id", F.col("reply_json").alias("item")))


def adjusted_replies(replies: DataFrame) -> DataFrame:
    """(id, raw_severity, severity_level, severity_confidence) of the usable replies whose level the rules changed; one pass."""
    df = R.parse_columns(replies, "reply").where(F.col("reply_json").isNotNull())
    df = _labelled(df.select("id", F.col("reply_json").alias("item")))
    return df.select("id", "raw_severity", "severity_level", "severity_confidence").where("raw_severity <> severity_level")


def _labelled(parsed: DataFrame) -> DataFrame:
    """Labels as given (severity) and after the adjustment rules, and the confidences."""
    names = ["type_confidence", "severity_confidence", "component_confidence"]
    number = lambda name: F.col(f"item.{name}").try_cast("double")
    for name in names:  # a confidence that is no number makes the reply unusable
        parsed = parsed.where(F.col(f"item.{name}").isNull() | number(name).isNotNull())
    confidence = lambda name: F.coalesce(number(name), F.lit(0.5))
    df = parsed.select(
        "id",
        "item",
        R.feedback_type(F.coalesce("item.feedback_type", F.lit("other"))).alias("feedback_type"),
        R.severity_level(F.coalesce("item.severity_level", F.lit("medium"))).alias("raw_severity"),
        R.component(F.coalesce("item.component", F.lit("other"))).alias("component"),
        confidence("type_confidence").alias("type_confidence"),
        confidence("severity_confidence").alias("raw_severity_confidence"),
        confidence("component_confidence").alias("component_confidence"),
    )
    kind, level = F.col("feedback_type"), F.col("raw_severity")
    df = df.withColumn("severity_level", R.adjusted_severity(kind, level)).withColumn(
        "severity_confidence", R.adjusted_severity_confidence(kind, level, F.col("raw_severity_confidence"))
    )
    return df.withColumn(
        "overall_confidence",
        R.mean_confidence(F.col("type_confidence"), F.col("severity_confidence"), F.col("component_confidence")),
    )


def classify_parsed(parsed: DataFrame) -> DataFrame:
    """Normalise the labels, apply the adjustment rules, list what fails validation."""
    kind = F.col("feedback_type")
    return _labelled(parsed).select(
        "id", "feedback_type", "severity_level", "component", "type_confidence", "severity_confidence",
        "component_confidence", "overall_confidence",
        R.severity_to_score(F.col("severity_level")).alias("severity_score"),
        F.col("item.version").alias("version"),
        F.coalesce("item.keywords", F.array().cast("array<string>")).alias("keywords"),
        F.col("item.sentiment").alias("sentiment"),
        F.coalesce("item.urgency_indicators", F.array().cast("array<string>")).alias("urgency_indicators"),
        R.validation_errors(
            kind, F.col("severity_level"), F.col("type_confidence"), F.col("severity_confidence"),
            F.col("component_confidence"), F.col("overall_confidence"),
        ).alias("validation_errors"),
    )


def attach(docs: DataFrame, classified: DataFrame, model_version: str = "1.0") -> DataFrame:
    """Classification columns and metadata on the documents that have a reply."""
    facts = classified.select(
        "id",
        F.struct(
            "feedback_type", "component", "severity_score", "version", F.col("overall_confidence").alias("confidence_score"),
            F.struct(
                "type_confidence", "severity_confidence", "component_confidence", "keywords", "sentiment",
                "urgency_indicators", F.lit(model_version).alias("model_version"),
            ).alias("classification_metadata"),
        ).alias("c"),
    )
    joined = docs.join(facts, "id", "left")
    old = lambda name: F.col(name) if name in docs.columns else F.lit(None)
    names = ["feedback_type", "component", "severity_score", "version", "confidence_score", "classification_metadata"]
    updated = {n: F.coalesce(F.col(f"c.{n}"), old(n)) if n in docs.columns else F.col(f"c.{n}") for n in names}
    return joined.withColumns(updated).drop("c")


def classification_metrics(classified: DataFrame, time_col: str | None = None) -> DataFrame:
    """Totals and the type, severity and component distributions from one pass."""
    dims = ["feedback_type", "severity_level", "component"]
    millis = F.col(time_col) if time_col else F.lit(0.0)
    base = classified.select(*dims, "overall_confidence", millis.alias("__ms"))
    rolled = base.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("overall_confidence") > 0.5).alias("successful"),
        F.avg("overall_confidence").alias("average_confidence"),
        F.avg("__ms").alias("average_processing_time_ms"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
    )
    kind = F.when(F.col("__g_feedback_type") == 0, "type").when(F.col("__g_severity_level") == 0, "severity")
    kind = kind.when(F.col("__g_component") == 0, "component").otherwise("all")
    return rolled.select(
        kind.alias("dimension"),
        F.coalesce(*dims, F.lit("")).alias("value"),
        "total",
        "successful",
        (F.col("total") - F.col("successful")).alias("failed"),
        (F.col("successful") / F.col("total")).alias("success_rate"),
        "average_confidence",
        "average_processing_time_ms",
    )
