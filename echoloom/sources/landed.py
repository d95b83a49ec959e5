"""Landed source records → flat rows, one parser per source, plus the source filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions.text import text_or_empty
from echoloom.schemas import LANDED, TABLES

NTZ = "timestamp_ntz"


def read_landed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """JSON lines with a fixed schema: nothing is inferred, nothing is read twice."""
    return spark.read.schema(LANDED[kind]).json(path)


def stream_landed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.readStream.schema(LANDED[kind]).json(path)


def parse_text(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The same records from a text column."""
    return lines.select(F.from_json(column, LANDED[kind]).alias("r")).select("r.*")


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(path)


def iso_time(col: Column) -> Column:
    """ISO text, a trailing Z means UTC."""
    return F.try_to_timestamp(col).cast(NTZ)


def epoch_time(col: Column) -> Column:
    return F.timestamp_micros((col * F.lit(1_000_000)).cast("bigint")).cast(NTZ)


def _or(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


def github_issues(df: DataFrame) -> DataFrame:
    """Issues only: a record with a `pull_request` is dropped."""
    rows = df.where(F.col("pull_request").isNull()) if "pull_request" in df.columns else df
    return rows.select(
        "id", "number", "title", text_or_empty(F.col("body")).alias("body"), F.col("user.login").alias("author"),
        F.col("user.html_url").alias("author_url"), F.col("html_url").alias("url"),
        iso_time(F.col("created_at")).alias("created_at"), iso_time(F.col("updated_at")).alias("updated_at"),
        F.transform("labels", lambda x: x["name"]).alias("labels"), "state", F.col("comments").alias("comments_count"),
        F.transform("assignees", lambda x: x["login"]).alias("assignees"), "milestone",
        _or("locked", False).alias("locked"), "reactions", "node_id",
    )


def github_discussions(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "number", "title", text_or_empty(F.col("body")).alias("body"), F.col("user.login").alias("author"),
        F.col("user.html_url").alias("author_url"), F.col("html_url").alias("url"),
        iso_time(F.col("created_at")).alias("created_at"), iso_time(F.col("updated_at")).alias("updated_at"),
        F.transform("labels", lambda x: x["name"]).alias("labels"), "state", F.col("comments").alias("comments_count"),
        F.array().cast("array<string>").alias("assignees"), "category", "answer_chosen_at", "answer_chosen_by", "node_id",
    )


def filter_issues(issues: DataFrame, since: str | None = None, state: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """Updated since, in a state, with all of the labels."""
    if since:
        issues = issues.where(F.col("updated_at") >= F.lit(since).cast(NTZ))
    if state and state != "all":
        issues = issues.where(F.col("state") == state)
    for label in labels or []:
        issues = issues.where(F.array_contains("labels", label))
    return issues


def _hn(df: DataFrame, title: Column, url: Column) -> DataFrame:
    return df.select(
        "id", title.alias("title"), text_or_empty(F.col("text")).alias("text"), _or("by", "unknown").alias("author"), url.alias("url"),
        _or("score", 0).alias("score"), epoch_time(F.col("time")).alias("time"), _or("descendants", 0).alias("descendants"), "type",
        F.coalesce("kids", F.array().cast("array<bigint>")).alias("kids"), "parent",
        F.coalesce("parts", F.array().cast("array<bigint>")).alias("parts"), _or("deleted", False).alias("deleted"),
        _or("dead", False).alias("dead"),
    )


def hn_stories(df: DataFrame) -> DataFrame:
    return _hn(df.where(F.col("type") == "story"), text_or_empty(F.col("title")), text_or_empty(F.col("url")))


def hn_comments(stories: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """The first `limit` kids of each story that are comments, with the story's id."""
    kids = stories.select(F.col("id").alias("story_id"), F.posexplode(F.slice("kids", 1, limit)).alias("pos", "id"))
    comments = _hn(items.where(F.col("type") == "comment"), F.lit(""), F.lit(""))
    return kids.join(comments, "id")


def hn_top(stories: DataFrame, min_score: int = 10) -> DataFrame:
    return stories.where(F.col("score") >= min_score)


def hn_by_keywords(stories: DataFrame, keywords: list[str], min_score: int = 5) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", "text"))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | text.contains(word.lower())
    return hn_top(stories, min_score).where(hit)


def exa_results(df: DataFrame, as_of: Column) -> DataFrame:
    """A date that cannot be read becomes `as_of`."""
    blank = lambda c: text_or_empty(F.col(c)).alias(c)
    return df.select(
        blank("id"), blank("title"), blank("url"), text_or_empty(F.col("text")).alias("content"), blank("author"),
        F.coalesce(iso_time(F.col("publishedDate")), as_of.cast(NTZ)).alias("published_date"), _or("score", 0.0).alias("score"),
        blank("domain"), blank("language"), blank("type"), blank("publishedDate"),
    )


def web_filter(results: DataFrame, exclude: list[str] = K.EXCLUDED_DOMAINS, site: str | None = None) -> DataFrame:
    """Drop results of the excluded domains (and their subdomains); keep one site if asked."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    for domain in exclude:
        results = results.where(~((host == domain) | host.endswith("." + domain)))
    if site:
        results = results.where((host == site) | host.endswith("." + site))
    return results


def tweets(df: DataFrame, users: DataFrame) -> DataFrame:
    """Tweets with their authors; an unknown author leaves the fixed fallbacks."""
    u = users.dropDuplicates(["id"]).select(
        F.col("id").alias("author_id"), "name", "username", "verified", F.col("public_metrics.followers_count").alias("followers")
    )
    rows = df.join(u, "author_id", "left")
    known = F.coalesce(F.col("username"), F.lit("")) != ""
    base = F.concat(F.lit("https://twitter.com/"), "username")
    metric = lambda n: F.coalesce(F.col(f"public_metrics.{n}"), F.lit(0)).alias(n)
    kinds = F.coalesce("referenced_tweets", F.array().cast("array<struct<type:string,id:string>>"))
    names = lambda path, field: F.coalesce(F.transform(path, lambda x: x[field]), F.array().cast("array<string>"))
    return rows.select(
        "id", "text", _or("name", "Unknown").alias("author"), _or("username", "unknown").alias("author_username"),
        F.when(known, base).otherwise("").alias("author_url"),
        F.when(known, F.concat(base, F.lit("/status/"), "id")).otherwise("").alias("url"),
        iso_time(F.col("created_at")).alias("created_at"),
        *[metric(n) for n in ("retweet_count", "like_count", "reply_count", "quote_count")],
        F.exists(kinds, lambda r: r["type"] == "retweeted").alias("is_retweet"),
        F.exists(kinds, lambda r: r["type"] == "replied_to").alias("is_reply"),
        names("entities.hashtags", "tag").alias("hashtags"), names("entities.mentions", "username").alias("mentions"),
        _or("verified", False).alias("author_verified"), _or("followers", 0).alias("author_followers"), _or("lang", "en").alias("lang"),
    )


def without_retweets(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = rows.where(~F.col("is_retweet"))
    if start:
        rows = rows.where(F.col("created_at") >= F.lit(start).cast(NTZ))
    if end:
        rows = rows.where(F.col("created_at") <= F.lit(end).cast(NTZ))
    return rows


def _reddit_common(df: DataFrame) -> list[Column]:
    author = _or("author", "[deleted]")
    named = F.concat(F.lit("https://reddit.com/u/"), text_or_empty(F.col("author")))
    return [
        author.alias("author"),
        F.when(F.col("author") == "[deleted]", "").otherwise(named).alias("author_url"),
        F.concat(F.lit("https://reddit.com"), text_or_empty(F.col("permalink"))).alias("url"),
        text_or_empty(F.col("subreddit")).alias("subreddit"),
        epoch_time(F.col("created_utc")).alias("created_at"),
        _or("score", 0).alias("score"),
    ]


def reddit_posts(df: DataFrame) -> DataFrame:
    flag = lambda c: _or(c, False).alias(c)
    return df.select(
        "id", text_or_empty(F.col("title")).alias("title"), text_or_empty(F.col("selftext")).alias("content"), *_reddit_common(df),
        F.concat(F.lit("https://reddit.com/r/"), text_or_empty(F.col("subreddit"))).alias("subreddit_url"),
        _or("upvote_ratio", 0.0).alias("upvote_ratio"), _or("num_comments", 0).alias("num_comments"), _or("is_self", True).alias("is_self"),
        F.when(~_or("is_self", False), F.col("url")).alias("link_url"), F.col("link_flair_text").alias("flair"),
        text_or_empty(F.col("domain")).alias("domain"), flag("is_original_content"), flag("is_crosspostable"),
        flag("is_reddit_media_domain"), flag("is_video"), flag("over_18"), flag("spoiler"), flag("stickied"),
        _or("gilded", 0).alias("gilded"), "distinguished", "post_hint", "preview", text_or_empty(F.col("thumbnail")).alias("thumbnail"),
    )


def reddit_listing(listings: DataFrame, kind: str) -> DataFrame:
    """Records of one kind (`t1` comments, `t3` posts) from listing pages: struct data.children[]."""
    children = listings.select(F.posexplode("data.children").alias("pos", "child"))
    return children.where(F.col("child.kind") == kind).select("pos", "child.data.*")


def reddit_comments(df: DataFrame) -> DataFrame:
    return df.select(
        "id", text_or_empty(F.col("body")).alias("content"), *_reddit_common(df), text_or_empty(F.col("parent_id")).alias("parent_id"),
        F.regexp_replace(text_or_empty(F.col("link_id")), "^t3_", "").alias("post_id"), _or("depth", 0).alias("depth"),
        _or("is_submitter", False).alias("is_submitter"), _or("collapsed", False).alias("collapsed"),
    )


def product_mentions(rows: DataFrame, products: list[str], text: Column, terms: list[str] = K.MENTION_TERMS, tags: bool = True) -> DataFrame:
    """Rows that match a search for a product, one row per matching query.

    A query is "<product> <term>" (every word must occur) or the product as #tag or @handle.
    """
    low = F.lower(text)
    queries = []
    for product in products:
        whole = [w for w in product.lower().split(" ") if w]
        for term in terms:
            hit = F.lit(True)
            for word in [*whole, *term.split(" ")]:
                hit = hit & low.contains(word)
            queries.append(F.when(hit, f"{product} {term}"))
        if tags:
            handle = product.lower().replace(" ", "")
            queries += [F.when(low.contains(mark + handle), mark + handle) for mark in "#@"]
    return rows.withColumn("query", F.explode(F.array_compact(F.array(*queries))))
