"""Browse any table: filters, search, one page and the total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.text import text_or_empty

MAX_PAGE = 100


@dataclass(frozen=True)
class FeedbackFilter:
    feedback_type: str | None = None
    source: str | None = None
    cluster_id: object | None = None
    date_from: str | None = None
    date_to: str | None = None
    search: str | None = None


def _like(text: str) -> str:
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_ignoring_case(col: Column, text: str) -> Column:
    return F.ilike(col, F.lit(_like(text)))


def filter_feedback(docs: DataFrame, f: FeedbackFilter) -> DataFrame:
    """Every filter that is set must hold; plain comparisons reach the scan."""
    if f.feedback_type is not None:
        docs = docs.where(F.col("feedback_type") == f.feedback_type)
    if f.source is not None:
        docs = docs.where(F.col("source_type") == f.source)
    if f.cluster_id is not None:
        docs = docs.where(F.col("cluster_id") == f.cluster_id)
    if f.date_from is not None:
        docs = docs.where(F.col("created_at") >= F.lit(f.date_from).cast(docs.schema["created_at"].dataType))
    if f.date_to is not None:
        docs = docs.where(F.col("created_at") <= F.lit(f.date_to).cast(docs.schema["created_at"].dataType))
    if f.search:
        docs = docs.where(contains_ignoring_case(F.col("body"), f.search))
    return docs


def page(df: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """One page of a fully ordered listing; pages count from 1 and hold at most 100 rows."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("pages start at 1 and hold 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_summary(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return total.select(
        "total",
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        (F.lit(number * size) < F.col("total")).alias("has_next"),
        F.lit(number > 1).alias("has_previous"),
    )


def search(docs: DataFrame, query: str, filters: FeedbackFilter = FeedbackFilter()) -> DataFrame:
    """Matching rows with a relevance: occurrences of the query per 100 characters, capped at 1."""
    hits = filter_feedback(docs, filters).where(contains_ignoring_case(F.col("body"), query))
    body, needle = F.lower(text_or_empty(F.col("body"))), query.lower()
    count = (F.length(body) - F.length(F.replace(body, F.lit(needle), F.lit("")))) / F.lit(float(len(needle)))
    return hits.withColumn("relevance", F.least(F.lit(1.0), count * 100 / F.greatest(F.length(body), F.lit(1))))


def clusters_with_representative(clusters: DataFrame, docs: DataFrame, title: str | None = None) -> DataFrame:
    """Clusters, filtered by title, each with its first document.

    min_by combines on the map side, so a huge cluster sends one row per task.
    """
    if title:
        clusters = clusters.where(contains_ignoring_case(F.col("title"), title))
    first = docs.where(F.col("cluster_id").isNotNull()).groupBy(F.col("cluster_id").alias("id")).agg(
        F.min_by(F.struct(F.col("id").alias("document_id"), F.col("title").alias("document_title")), "id").alias("first")
    )
    return clusters.join(first, "id", "left").select(clusters["*"], "first.document_id", "first.document_title")


def filter_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values; a None value is not a filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def list_reports(reports: DataFrame, report_type: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """One page of the reports of a type (or of all), newest first, with the number of all that match."""
    wanted = filter_equal(reports, report_type=report_type)
    total = wanted.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    rows = page(wanted, [F.col("period_end").desc(), F.col("title")], number, size).withColumn("one", F.lit(1))
    return rows.join(F.broadcast(total), "one").drop("one")  # the total is one row


def distinct_keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by `order`."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(key, *[F.col(f"r.{c}") for c in rest])
