"""raw_feedback → processed_documents: one narrow chain of projections per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.functions import language, pii, text


def pending(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Raw rows without a processed document."""
    done = processed.select(F.col("raw_feedback_id").alias("id"))
    return raw.join(done, "id", "left_anti")


def normalize_documents(
    raw: DataFrame,
    scrub: bool = True,
    min_words: int = 5,
    max_words: int = 10000,
    default_language: str = "en",
) -> DataFrame:
    """Clean, mask, detect the language, drop too short texts and cut too long ones."""
    df = text.clean_html_columns(raw, "title", "__t")
    df = df.withColumn("__t", text.cut_title(F.col("__t")))
    df = text.clean_html_columns(df, "content", "__b")
    if scrub:
        df = pii.scrub_columns(df, "__t", "tp")
        df = pii.scrub_columns(df, "__b", "bp")
        df = df.withColumn("pii_detected", F.concat("tp_detected", "bp_detected"))
        df = df.drop("__t", "__b").withColumnsRenamed({"tp_text": "__t", "bp_text": "__b"})
    else:
        df = df.withColumn("pii_detected", F.array().cast("array<string>"))
    df = text.compute_once(df, "__words", text.word_count(F.col("__b")))
    df = df.where(F.col("__words") >= max(2, min_words))
    df = df.withColumn("__full", F.concat_ws(" ", "__t", "__b"))
    df = language.detect_columns(df, "__full", default_language)
    return df.select(
        F.col("id").alias("raw_feedback_id"),
        F.col("source_type"),
        F.col("__t").alias("title"),
        text.truncate_words(F.col("__b"), max_words, F.col("__words")).alias("body"),
        F.col("author"),
        F.col("timestamp"),
        F.col("url"),
        F.col("lang.language").alias("language"),
        F.least(F.col("__words"), F.lit(max_words)).alias("word_count"),
        F.lit("completed").alias("processing_status"),
        F.col("pii_detected"),
        F.col("lang.confidence").alias("language_confidence"),
        F.struct(
            F.lit(True).alias("html_cleaned"),
            F.lit(scrub).alias("pii_scrubbed"),
            F.col("lang.method").alias("language_detected"),
            F.length(text.text_or_empty(F.col("title"))).alias("original_title_length"),
            F.length(text.text_or_empty(F.col("content"))).alias("original_content_length"),
        ).alias("processing_metadata"),
    )


def filter_by_language(docs: DataFrame, target: str = "en", unsure_below: float = 0.3) -> DataFrame:
    """Keep the target language and everything the detector is unsure about."""
    return docs.where((F.col("language") == target) | (F.col("language_confidence") < unsure_below))


def processing_stats(docs: DataFrame) -> DataFrame:
    """Total, mean word count, and counts by language and source in one pass."""
    language_name = F.coalesce("language", F.lit("unknown"))
    base = docs.select(language_name.alias("language"), "source_type", "word_count")
    rolled = base.groupingSets([[F.col("language")], [F.col("source_type")], []], "language", "source_type").agg(
        F.count("*").alias("documents"),
        F.avg(F.coalesce("word_count", F.lit(0))).alias("average_word_count"),
        F.grouping("language").alias("__gl"),
        F.grouping("source_type").alias("__gs"),
    )
    kind = F.when(F.col("__gl") == 0, "language").when(F.col("__gs") == 0, "source").otherwise("total")
    return rolled.select(
        kind.alias("dimension"),
        F.coalesce("language", "source_type", F.lit("")).alias("value"),
        "documents",
        F.round("average_word_count", 6).alias("average_word_count"),
    )


def language_stats(docs: DataFrame) -> DataFrame:
    """Distribution, mean confidence and the most common language (ties: first by name)."""
    counts = docs.groupBy("language").agg(F.count("*").alias("n"), F.sum("language_confidence").alias("s"))
    return counts.agg(
        F.sum("n").alias("total_items"),
        (F.sum("s") / F.sum("n")).alias("average_confidence"),
        F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("most_common_language"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("language_distribution"),
    )
