"""Source plans: landed JSON is derived from the given tables, then parsed like a landed file."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.operators import listing
from echoloom.plans import tables as T
from echoloom.plans.registry import plan
from echoloom.plans.tables import with_tables
from echoloom.sources import canonical as C
from echoloom.sources import landed as L

def _as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")



def _key():
    return F.col("doc_id")


def _lines(df, *fields):
    return df.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields])).alias("value"))


def _text(v):
    return v.cast("string")


def _docs(spark, sf):
    return T.read(spark, sf, "documents")


def _issue_lines(spark, sf):
    name = F.concat(F.lit("user"), _text(_key() % 50))
    labels = F.when(_key() % 2 == 0, F.array(F.struct(F.lit("bug").alias("name")), F.struct(F.col("lang").alias("name")))).otherwise(
        F.array(F.struct(F.lit("question").alias("name")))
    )
    return _lines(
        _docs(spark, sf), ("id", _key()), ("number", _key() + 1), ("title", F.substring("text", 1, 60)),
        ("body", F.when(_key() % 9 != 8, F.col("text"))),
        ("user", F.struct(name.alias("login"), F.concat(F.lit("https://git.example/"), name).alias("html_url"))),
        ("html_url", F.concat(F.lit("https://git.example/i/"), _text(_key()))),
        ("created_at", F.concat(F.lit("2024-01-"), F.lpad(_text(_key() % 28 + 1), 2, "0"), F.lit("T10:00:00Z"))),
        ("updated_at", F.concat(F.lit("2024-02-"), F.lpad(_text(_key() % 28 + 1), 2, "0"), F.lit("T10:00:00Z"))),
        ("labels", labels), ("state", F.when(_key() % 3 == 0, "closed").otherwise("open")), ("comments", (_key() % 7).cast("int")),
        ("assignees", F.array(F.struct(name.alias("login")))),
        ("pull_request", F.when(_key() % 10 == 9, F.struct(F.lit("x").alias("url")))), ("category", F.col("source")),
    )


def _issues(spark, sf):
    return L.github_issues(L.parse_text(_issue_lines(spark, sf), "github_issue"))


ISSUES = """WITH issues AS (SELECT doc_id AS id, doc_id + 1 AS number, substring(text, 1, 60) AS title, CASE WHEN doc_id % 9 <> 8 THEN text ELSE '' END AS body, 'user' || (doc_id % 50) AS author,
    '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' AS created, '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' AS updated,
    CASE WHEN doc_id % 2 = 0 THEN 'bug,' || lang ELSE 'question' END AS labels, CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state, doc_id % 10 = 9 AS pr FROM documents) """
_TIME = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@plan("a01_github_issues", ISSUES + "SELECT id, number, title, md5(body) AS body_md5, author, created, updated, labels, state, author AS assignees FROM issues WHERE NOT pr")
def _(spark, sf):
    return _issues(spark, sf).select(
        "id", "number", "title", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), "author", _TIME("created_at").alias("created"),
        _TIME("updated_at").alias("updated"), F.array_join("labels", ",").alias("labels"), "state", F.array_join("assignees", ",").alias("assignees"),
    )


@plan("a02_github_discussions", ISSUES + "SELECT id, title, author, labels, source AS category, CAST(0 AS INT) AS assignees FROM issues JOIN documents ON doc_id = id")
def _(spark, sf):
    rows = L.github_discussions(L.parse_text(_issue_lines(spark, sf), "github_discussion"))
    return rows.select("id", "title", "author", F.array_join("labels", ",").alias("labels"), "category", F.size("assignees").alias("assignees"))


@plan("b01_without_pull_requests", ISSUES + "SELECT count(*) AS issues FROM issues WHERE NOT pr")
def _(spark, sf):
    return _issues(spark, sf).agg(F.count("*").alias("issues"))


@plan("b02_issue_filter", ISSUES + "SELECT id FROM issues WHERE NOT pr AND updated >= '2024-02-15 00:00:00' AND state = 'open' AND labels = 'bug,en'")
def _(spark, sf):
    return L.filter_issues(_issues(spark, sf), since="2024-02-15 00:00:00", state="open", labels=["bug", "en"]).select("id")


def _hn_lines(spark, sf):
    kind = F.when(_key() % 5 == 0, "story").when(_key() % 5 == 4, "poll").otherwise("comment")
    return _lines(
        _docs(spark, sf), ("id", _key()), ("type", kind), ("by", F.when(_key() % 7 != 6, F.concat(F.lit("hn"), _text(_key() % 30)))),
        ("time", F.lit(1704067200) + _key() * 60), ("title", F.when(kind == "story", F.substring("text", 1, 50))), ("text", F.when(_key() % 4 != 3, F.col("text"))),
        ("url", F.when(_key() % 3 == 0, F.concat(F.lit("https://blog.example/"), _text(_key())))), ("score", F.when(_key() % 6 != 5, (_key() % 40).cast("int"))),
        ("kids", F.when(kind == "story", F.array(_key() + 1, _key() + 2, _key() + 3, _key() + 4))),
    )


def _hn_items(spark, sf):
    return L.parse_text(_hn_lines(spark, sf), "hacker_news")


HN = """WITH hn AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'story' WHEN 4 THEN 'poll' ELSE 'comment' END AS type, CASE WHEN doc_id % 7 <> 6 THEN 'hn' || (doc_id % 30) ELSE 'unknown' END AS author,
    epoch_us(TIMESTAMP '2024-01-01' + to_minutes(doc_id)) AS t, substring(text, 1, 50) AS title, CASE WHEN doc_id % 4 <> 3 THEN text ELSE '' END AS body, CASE WHEN doc_id % 3 = 0 THEN 'https://blog.example/' || doc_id ELSE '' END AS url,
    CASE WHEN doc_id % 6 <> 5 THEN doc_id % 40 ELSE 0 END AS score FROM documents), stories AS (SELECT * FROM hn WHERE type = 'story') """


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@plan("a03_hn_stories", HN + "SELECT id, title, md5(body) AS text_md5, author, url, score, t FROM stories")
def _(spark, sf):
    return L.hn_stories(_hn_items(spark, sf)).select(
        "id", "title", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "author", "url", "score", _micros("time").alias("t")
    )


@plan("a04_hn_comments", HN + "SELECT s.id AS story_id, c.id, c.author, c.score FROM stories s JOIN hn c ON c.id BETWEEN s.id + 1 AND s.id + 2 AND c.type = 'comment'")
def _(spark, sf):
    items = _hn_items(spark, sf)
    return L.hn_comments(L.hn_stories(items), items, 2).select("story_id", "id", "author", "score")


@plan("b03_hn_min_score", HN + "SELECT id, score FROM stories WHERE score >= 10")
def _(spark, sf):
    return L.hn_top(L.hn_stories(_hn_items(spark, sf))).select("id", "score")


@plan("b04_hn_keywords", HN + "SELECT id FROM stories WHERE score >= 5 AND (contains(lower(title || ' ' || body), 'tion') OR contains(lower(title || ' ' || body), 'nicht'))")
def _(spark, sf):
    return L.hn_by_keywords(L.hn_stories(_hn_items(spark, sf)), ["TION", "nicht"]).select("id")


_HOSTS = ["blog.example", "github.com", "old.reddit.com", "news.example", "notgithub.com"]


def _exa(spark, sf):
    host = F.element_at(F.array(*[F.lit(h) for h in _HOSTS]), (_key() % 5 + 1).cast("int"))
    date = F.when(_key() % 3 == 0, "2024-03-01T08:30:00.000Z").when(_key() % 3 == 1, "last week").otherwise("2024-03-02T00:00:00+02:00")
    lines = _lines(
        _docs(spark, sf), ("id", F.concat(F.lit("exa-"), _text(_key()))), ("title", F.substring("text", 1, 40)), ("url", F.concat(F.lit("https://"), host, F.lit("/p/"), _text(F.floor(_key() / 2)))),
        ("text", F.col("text")), ("author", F.when(_key() % 2 == 0, F.lit("Ann"))), ("publishedDate", date), ("score", (_key() % 100) / F.lit(100.0)), ("domain", host),
    )
    return L.exa_results(L.parse_text(lines, "exa"), _as_of())


EXA = f"""WITH exa AS (SELECT doc_id, 'exa-' || doc_id AS id, {_HOSTS}[doc_id % 5 + 1] AS host, CASE WHEN doc_id % 2 = 0 THEN 'Ann' ELSE '' END AS author,
    CASE doc_id % 3 WHEN 0 THEN '2024-03-01 08:30:00' WHEN 1 THEN '2024-06-01 00:00:00' ELSE '2024-03-01 22:00:00' END AS published, (doc_id % 100) / CAST(100 AS DOUBLE) AS score, substring(text, 1, 40) AS title FROM documents) """


@plan("a05_exa_results", EXA + "SELECT id, title, author, published, score FROM exa")
def _(spark, sf):
    return _exa(spark, sf).select("id", "title", "author", _TIME("published_date").alias("published"), "score")


@plan("b05_domain_filter", EXA + "SELECT id FROM exa WHERE host NOT IN ('github.com', 'old.reddit.com')")
def _(spark, sf):
    return L.web_filter(_exa(spark, sf)).select("id")


def _tweets(spark, sf):
    mentions = F.when(_key() % 4 == 0, F.struct(F.array(F.struct(F.col("lang").alias("tag"))).alias("hashtags"), F.array(F.struct(F.lit("acme").alias("username"))).alias("mentions")))
    refs = F.when(_key() % 5 == 0, F.array(F.struct(F.lit("retweeted").alias("type"), F.lit("1").alias("id")))).when(_key() % 5 == 1, F.array(F.struct(F.lit("replied_to").alias("type"), F.lit("2").alias("id"))))
    lines = _lines(
        _docs(spark, sf), ("id", _text(_key())), ("text", F.col("text")), ("author_id", _text(_key() % 40)), ("created_at", F.concat(F.lit("2024-01-"), F.lpad(_text(_key() % 28 + 1), 2, "0"), F.lit("T12:00:00.000Z"))),
        ("entities", mentions), ("referenced_tweets", refs), ("public_metrics", F.struct((_key() % 9).cast("int").alias("retweet_count"), (_key() % 11).cast("int").alias("like_count"))),
    )
    k = F.col("n_nationkey")
    users = _lines(
        T.read(spark, sf, "nation"), ("id", _text(k)), ("name", F.col("n_name")), ("username", F.lower("n_name")), ("verified", k % 2 == 0),
        ("public_metrics", F.struct((k * 10).cast("int").alias("followers_count"))),
    )
    return L.tweets(L.parse_text(lines, "twitter"), L.parse_text(users, "twitter_user"))


TWEETS = """WITH tw AS (SELECT doc_id::VARCHAR AS id, text, coalesce(n_name, 'Unknown') AS author, coalesce(lower(n_name), 'unknown') AS username, CASE WHEN n_name IS NULL THEN '' ELSE 'https://twitter.com/' || lower(n_name) || '/status/' || doc_id END AS url,
    CASE WHEN doc_id % 4 = 0 THEN lang ELSE '' END AS hashtags, doc_id % 5 = 0 AS is_retweet, doc_id % 5 = 1 AS is_reply, doc_id % 9 AS retweet_count, coalesce(n_nationkey * 10, 0) AS followers,
    '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 12:00:00' AS created FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 40) """


@plan("a06_tweets", TWEETS + "SELECT id, author, username, url, hashtags, is_retweet, is_reply, retweet_count, followers, created FROM tw")
def _(spark, sf):
    return _tweets(spark, sf).select(
        "id", "author", F.col("author_username").alias("username"), "url", F.array_join("hashtags", ",").alias("hashtags"), "is_retweet", "is_reply", "retweet_count",
        F.col("author_followers").alias("followers"), _TIME("created_at").alias("created"),
    )


@plan("b06_without_retweets", TWEETS + "SELECT id FROM tw WHERE NOT is_retweet AND created >= '2024-01-10 00:00:00' AND created <= '2024-01-20 23:00:00'")
def _(spark, sf):
    return L.without_retweets(_tweets(spark, sf), "2024-01-10 00:00:00", "2024-01-20 23:00:00").select("id")


_TERMS = ["bug", "review", "problem"]


@plan(
    "b07_product_mentions",
    "WITH t AS (SELECT doc_id AS id, lower(text || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'Acme Tool bug' WHEN doc_id % 3 = 1 THEN '#acmetool review' ELSE 'nothing' END) AS t FROM documents), q AS (SELECT * FROM (VALUES "
    + ", ".join(f"('Acme Tool {t}', '{t}')" for t in _TERMS)
    + ") q(query, term)) SELECT id, query FROM t, q WHERE contains(t, 'acme') AND contains(t, 'tool') AND contains(t, term) UNION ALL SELECT id, '#acmetool' FROM t WHERE contains(t, '#acmetool') UNION ALL SELECT id, '@acmetool' FROM t WHERE contains(t, '@acmetool')",
)
def _(spark, sf):
    tail = F.when(_key() % 3 == 0, "Acme Tool bug").when(_key() % 3 == 1, "#acmetool review").otherwise("nothing")
    rows = _docs(spark, sf).select(_key().alias("id"), F.concat_ws(" ", "text", tail).alias("text"))
    return L.product_mentions(rows, ["Acme Tool"], F.col("text"), _TERMS).select("id", "query")


def _posts(spark, sf):
    lines = _lines(
        _docs(spark, sf), ("id", _text(_key())), ("title", F.substring("text", 1, 70)), ("selftext", F.col("text")), ("author", F.when(_key() % 6 == 5, "[deleted]").otherwise(F.concat(F.lit("r"), _text(_key() % 20)))),
        ("permalink", F.concat(F.lit("/r/x/"), _text(_key()))), ("subreddit", F.col("source")), ("created_utc", (F.lit(1704067200) + _key()).cast("double")), ("score", (_key() % 50).cast("int")),
        ("is_self", _key() % 2 == 0), ("url", F.lit("https://link.example")), ("num_comments", (_key() % 12).cast("int")),
    )
    return L.reddit_posts(L.parse_text(lines, "reddit_post"))


@plan(
    "a07_reddit_posts",
    """SELECT doc_id::VARCHAR AS id, substring(text, 1, 70) AS title, CASE WHEN doc_id % 6 = 5 THEN '' ELSE 'https://reddit.com/u/r' || (doc_id % 20) END AS author_url, 'https://reddit.com/r/x/' || doc_id AS url,
    CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'https://link.example' END AS link_url, doc_id % 50 AS score, 1704067200000000 + doc_id * 1000000 AS t FROM documents""",
)
def _(spark, sf):
    return _posts(spark, sf).select("id", "title", "author_url", "url", "link_url", "score", _micros("created_at").alias("t"))


@plan("a08_reddit_comments", "SELECT conv_id || '-' || turn AS id, text AS content, turn AS depth, conv_id::VARCHAR AS post_id FROM conversations WHERE role <> 'system'")
def _(spark, sf):
    c = T.read(spark, sf, "conversations")
    data = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.col("turn").cast("int").alias("depth"), F.concat(F.lit("t3_"), F.col("conv_id").cast("string")).alias("link_id"),
        F.lit("x").alias("author"), F.lit(1704067200.0).alias("created_utc"),
    )
    page = F.to_json(F.struct(F.struct(F.array(F.struct(F.when(F.col("role") == "system", "more").otherwise("t1").alias("kind"), data.alias("data"))).alias("children")).alias("data")))
    schema = "data struct<children:array<struct<kind:string,data:struct<" + ",".join(p.replace(" ", ":", 1) for p in L.LANDED["reddit_comment"].split(", ")) + ">>>>"
    listings = c.select(F.from_json(page, schema).alias("r")).select("r.*")
    return L.reddit_comments(L.reddit_listing(listings, "t1")).select("id", "content", F.col("depth").cast("bigint").alias("depth"), "post_id")


def _checked(records):
    return records.select("source_type", "source_id", "url", F.md5(F.encode("title", "UTF-8")).alias("title_md5"), "author", "author_url", F.col("raw_metadata")["score"].alias("score"))


@plan("a09_canonical_issues", ISSUES + "SELECT 'github_issue' AS source_type, id::VARCHAR AS source_id, 'https://git.example/i/' || id AS url, author, 'https://git.example/' || author AS author_url, created AS time, state FROM issues WHERE NOT pr")
def _(spark, sf):
    return C.from_github_issues(_issues(spark, sf)).select("source_type", "source_id", "url", "author", "author_url", _TIME("timestamp").alias("time"), F.col("raw_metadata")["state"].alias("state"))


@plan("a10_canonical_discussions", ISSUES + "SELECT 'github_discussion' AS source_type, id::VARCHAR AS source_id, title, source AS category FROM issues JOIN documents ON doc_id = id")
def _(spark, sf):
    rows = C.from_github_discussions(L.github_discussions(L.parse_text(_issue_lines(spark, sf), "github_discussion")))
    return rows.select("source_type", "source_id", "title", F.col("raw_metadata")["category"].alias("category"))


@plan("a11_canonical_hn", HN + "SELECT 'hacker_news' AS source_type, id::VARCHAR AS source_id, CASE WHEN url = '' THEN 'https://news.ycombinator.com/item?id=' || id ELSE url END AS url, md5(title) AS title_md5, author, 'https://news.ycombinator.com/user?id=' || author AS author_url, score::VARCHAR AS score FROM stories")
def _(spark, sf):
    return _checked(C.from_hacker_news(L.hn_stories(_hn_items(spark, sf))))


@plan("a12_canonical_exa", EXA + "SELECT 'exa_blog' AS source_type, id AS source_id, author, '' AS author_url, published AS time FROM exa")
def _(spark, sf):
    return C.from_exa(_exa(spark, sf)).select("source_type", "source_id", "author", "author_url", _TIME("timestamp").alias("time"))


@plan("a13_canonical_tweets", TWEETS + "SELECT 'twitter_post' AS source_type, id AS source_id, md5('@' || username || ': ' || substring(text, 1, 100) || '...') AS title_md5, author FROM tw")
def _(spark, sf):
    return C.from_tweets(_tweets(spark, sf)).select("source_type", "source_id", F.md5(F.encode("title", "UTF-8")).alias("title_md5"), "author")


@plan("a14_canonical_reddit", "SELECT 'reddit' AS source_type, doc_id::VARCHAR AS source_id, source AS subreddit, (doc_id % 50)::VARCHAR AS score FROM documents")
def _(spark, sf):
    return C.from_reddit_posts(_posts(spark, sf)).select("source_type", "source_id", F.col("raw_metadata")["subreddit"].alias("subreddit"), F.col("raw_metadata")["score"].alias("score"))


def _all_sources(spark, sf):
    return C.union_sources(
        C.from_github_issues(_issues(spark, sf)), C.from_hacker_news(L.hn_stories(_hn_items(spark, sf))), C.from_exa(_exa(spark, sf)),
        C.from_tweets(_tweets(spark, sf)), C.from_reddit_posts(_posts(spark, sf)),
    )


_SUMMARY = ISSUES.rstrip() + ", " + HN[5:].rstrip() + """, s AS (SELECT 'github_issue' AS source_type, count(*) AS items FROM issues WHERE NOT pr UNION ALL SELECT 'hacker_news', count(*) FROM stories
    UNION ALL SELECT unnest(['exa_blog', 'twitter_post', 'reddit']), count(*) FROM documents) """


@plan("a16_ingest_summary", _SUMMARY + "SELECT source_type, items, items AS successful, 0 AS failed FROM s")
def _(spark, sf):
    return C.ingest_summary(_all_sources(spark, sf))


@plan("e07_union_sources", _SUMMARY + "SELECT count(*) AS sources, sum(items)::BIGINT AS items FROM s")
def _(spark, sf):
    per = _all_sources(spark, sf).groupBy("source_type").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("sources"), F.sum("n").alias("items"))


@plan("e06_distinct_urls", EXA + "SELECT count(DISTINCT host || '/' || doc_id // 2) AS results FROM exa")
def _(spark, sf):
    return listing.distinct_keep_first(_exa(spark, sf).select("url", "id", "title"), "url", "id").agg(F.count("*").alias("results"))


@plan(
    "a15_upsert",
    with_tables("raw")
    + """SELECT source_type, source_id, CASE WHEN id % 4 = 1 THEN 'new ' || id ELSE title END AS title, CASE WHEN id % 4 = 1 THEN '2024-06-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated, '2024-01-01 00:00:00' AS created FROM raw WHERE id % 10 <> 1
    UNION ALL SELECT source_type, source_id, 'new ' || id, '2024-06-01 00:00:00', '2024-06-01 00:00:00' FROM raw WHERE id % 10 = 1 AND id % 4 = 1""",
)
def _(spark, sf):
    raw = T.raw_feedback(spark, sf)
    first = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    current = C.with_ids(raw.where("id % 10 <> 1").drop("id"), first)
    incoming = raw.where("id % 4 = 1").withColumn("title", F.concat(F.lit("new "), F.col("id").cast("string"))).drop("id")
    out = C.upsert(current, incoming, _as_of())
    return out.select("source_type", "source_id", "title", _TIME("updated_at").alias("updated"), _TIME("created_at").alias("created"))


@plan("g06_latest_per_key", "SELECT event_type AS source_type, user_id::VARCHAR AS source_id, max(epoch_us(ts)) AS latest FROM events GROUP BY ALL")
def _(spark, sf):
    e = T.read(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("source_type"), F.col("user_id").cast("string").alias("source_id"), F.col("props").alias("content"), F.col("ts").alias("timestamp"))
    return C.latest_per_key(rows).select("source_type", "source_id", _micros("timestamp").alias("latest"))
