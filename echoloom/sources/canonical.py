"""Source rows → raw_feedback records, and the keyed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["source_type", "source_id", "url", "title", "content", "author", "author_url", "timestamp", "raw_metadata"]
KEY = ["source_type", "source_id"]


def _text(col: Column, kind) -> Column:
    return F.to_json(col) if kind in ("array", "struct", "map") else col.cast("string")


def _metadata(df: DataFrame, names: list[str], **renamed: Column) -> Column:
    """Text map of the named columns that are not NULL."""
    pairs = [(n, _text(F.col(n), df.schema[n].dataType.typeName())) for n in names] + list(renamed.items())
    every = F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])
    return F.map_filter(every, lambda _, v: v.isNotNull())


def _record(df: DataFrame, source: str, url: Column, title: Column, content: str, author_url: Column, time: str, metadata: Column) -> DataFrame:
    return df.select(
        F.lit(source).alias("source_type"), F.col("id").cast("string").alias("source_id"), url.alias("url"), title.alias("title"),
        F.col(content).alias("content"), "author", author_url.alias("author_url"), F.col(time).alias("timestamp"),
        metadata.alias("raw_metadata"),
    )


def from_github_issues(df: DataFrame) -> DataFrame:
    meta = _metadata(df, ["number", "labels", "state", "comments_count", "assignees", "updated_at", "milestone", "locked", "reactions", "node_id"])
    return _record(df, "github_issue", F.col("url"), F.col("title"), "body", F.col("author_url"), "created_at", meta)


def from_github_discussions(df: DataFrame) -> DataFrame:
    meta = _metadata(df, ["number", "labels", "state", "comments_count", "updated_at", "category", "answer_chosen_at", "answer_chosen_by", "node_id"])
    return _record(df, "github_discussion", F.col("url"), F.col("title"), "body", F.col("author_url"), "created_at", meta)


def from_hacker_news(df: DataFrame) -> DataFrame:
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    person = F.concat(F.lit("https://news.ycombinator.com/user?id="), "author")
    meta = _metadata(df, ["score", "descendants", "type", "kids", "parent", "parts", "deleted", "dead"])
    return _record(df, "hacker_news", F.coalesce(F.nullif("url", F.lit("")), page), F.col("title"), "text", person, "time", meta)


def from_exa(df: DataFrame) -> DataFrame:
    meta = _metadata(df, ["score", "domain", "language", "type", "publishedDate"])
    return _record(df, "exa_blog", F.col("url"), F.col("title"), "content", F.lit(""), "published_date", meta)


def from_tweets(df: DataFrame) -> DataFrame:
    title = F.concat(F.lit("@"), "author_username", F.lit(": "), F.substring("text", 1, 100), F.lit("..."))
    names = ["retweet_count", "like_count", "reply_count", "quote_count", "is_retweet", "is_reply", "hashtags", "mentions", "author_verified", "author_followers", "lang"]
    return _record(df, "twitter_post", F.col("url"), title, "text", F.col("author_url"), "created_at", _metadata(df, names))


def from_reddit_posts(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c not in ("id", "title", "content", "author", "author_url", "url", "created_at")]
    return _record(df, "reddit", F.col("url"), F.col("title"), "content", F.col("author_url"), "created_at", _metadata(df, names))


def union_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def with_ids(records: DataFrame, as_of: Column) -> DataFrame:
    """Stable id from the natural key, so that a rerun writes the same rows."""
    return records.withColumns(
        {"id": F.sha2(F.encode(F.concat_ws("\u0001", *KEY), "UTF-8"), 256), "created_at": as_of, "updated_at": as_of}
    )


def latest_per_key(records: DataFrame, order: str = "timestamp") -> DataFrame:
    """One record per key, the latest; max_by combines on the map side."""
    rest = [c for c in records.columns if c not in KEY]
    best = records.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64("content"))).alias("r"))
    return best.select(*KEY, *[F.col(f"r.{c}") for c in rest])


def upsert(current: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Known keys take the new title, content, metadata and update time; new keys are added."""
    new = with_ids(latest_per_key(incoming), as_of)
    keys = new.select(*KEY)
    untouched = current.join(keys, KEY, "left_anti")
    fresh = F.struct("title", "content", "raw_metadata", "updated_at").alias("n")
    changed = current.drop("title", "content", "raw_metadata", "updated_at").join(new.select(*KEY, fresh), KEY)
    changed = changed.select("*", "n.*").drop("n")
    added = new.join(current.select(*KEY), KEY, "left_anti")
    return untouched.unionByName(changed).unionByName(added, allowMissingColumns=True)


def ingest_summary(records: DataFrame) -> DataFrame:
    """Per source: items, and how many have the key and time a stored row needs."""
    good = F.col("source_id").isNotNull() & F.col("timestamp").isNotNull()
    return records.groupBy("source_type").agg(
        F.count("*").alias("items"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed")
    )


def append_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").partitionBy("source_type").parquet(path)


def write_tickets(tickets: DataFrame, path: str) -> None:
    tickets.write.mode("append").partitionBy("platform").parquet(path)
