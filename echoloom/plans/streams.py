"""Streaming plans: the given tables are read as file streams and run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.operators import limits as L
from echoloom.plans import tables as T
from echoloom.plans.registry import ORACLES, plan
from echoloom.streaming import admission, digest, ingest, runs


def _events(spark, sf):
    return runs.stream_parquet(spark, sf, "events.parquet")


@plan("k01_ingest_stream")
def _(spark, sf):
    docs = runs.stream_parquet(spark, sf, "documents.parquet")
    raw = T.raw_columns(docs)
    out = ingest.run_ingest(raw)
    return out.select("raw_feedback_id", "language", F.col("word_count").cast("bigint").alias("word_count"))


@plan(
    "k02_daily_counts",
    "SELECT epoch_us(CAST(ts AS DATE)::TIMESTAMP) AS day_us, event_type, count(*) AS items FROM events GROUP BY ALL",
)
def _(spark, sf):
    out = digest.run_counts(_events(spark, sf), "ts", "1 day", keys=("event_type",))
    return out.select(F.unix_micros("period_start").alias("day_us"), "event_type", "items")


@plan(
    "k02_hourly_counts",
    "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS items FROM events GROUP BY ALL",
)
def _(spark, sf):
    out = digest.run_counts(_events(spark, sf), "ts", "1 hour")
    return out.select(F.unix_micros("period_start").alias("hour_us"), "items")


@plan(
    "k03_sliding_stream",
    """WITH w AS (SELECT CAST(ts AS DATE) + CAST(i AS INTEGER) AS d, count(*) AS items FROM events, range(1, 8) r(i) GROUP BY 1)
    SELECT epoch_us(d::TIMESTAMP) AS end_us, items FROM w""",
)
def _(spark, sf):
    out = digest.run_counts(_events(spark, sf), "ts", "7 days", "1 day")
    return out.select(F.unix_micros("period_end").alias("end_us"), "items")


def _batch_oracle(name: str) -> str:
    import echoloom.plans.health  # noqa: F401  registers the batch twin first

    return ORACLES[name]


@plan("k04_request_admission_stream", _batch_oracle("k04_request_admission"))
def _(spark, sf):
    out = admission.admit_stream(_events(spark, sf), "event_type", "ts", "event_id", L.SlidingLog(2, 3600))
    return runs.run_available(out).select("event_id", "admitted")


@plan("k05_cooldown_stream", _batch_oracle("j26_alert_cooldown"))
def _(spark, sf):
    out = admission.admit_stream(_events(spark, sf), "event_type", "ts", "event_id", L.Cooldown(K.ALERT_COOLDOWN_SECONDS))
    return runs.run_available(out).select("event_id", "admitted")


@plan("k05_hourly_cap_stream", _batch_oracle("j28_notification_cap"))
def _(spark, sf):
    out = admission.admit_stream(_events(spark, sf), "event_type", "ts", "event_id", L.HourlyCap(2))
    return runs.run_available(out).select("event_id", "admitted")


def _ordered_oracle() -> str:
    """The batch answers of all events that the watermark, ten minutes behind the last one, has passed."""
    head, tail = _batch_oracle("j26_alert_cooldown").rsplit("SELECT event_id, admitted FROM w", 1)
    return head + "SELECT event_id, admitted FROM w JOIN e USING (event_id) WHERE t < (SELECT (max(t) // 1000 - 600000) * 1000 FROM e)" + tail


@plan("k05_ordered_stream", _ordered_oracle())
def _(spark, sf):
    out = admission.admit_ordered(_events(spark, sf), "event_type", "ts", "event_id", L.Cooldown(K.ALERT_COOLDOWN_SECONDS), "10 minutes")
    return runs.run_available(out).select("event_id", "admitted")


@plan("k07_stream_upsert", "SELECT event_type AS source_type, user_id::VARCHAR AS source_id, max(epoch_us(ts)) AS latest FROM events GROUP BY ALL")
def _(spark, sf):
    import uuid

    from echoloom.session import ensure_checkpoint_dir

    e = _events(spark, sf)
    text = lambda c: F.col(c).cast("string")
    records = e.select(
        F.col("event_type").alias("source_type"), text("user_id").alias("source_id"), F.lit("").alias("url"), text("event_id").alias("title"),
        F.col("props").alias("content"), text("user_id").alias("author"), F.lit("").alias("author_url"), F.col("ts").alias("timestamp"),
        F.create_map(F.lit("t"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")).alias("raw_metadata"),
    )
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    ingest.run_upsert(records, f"{base}/store", f"{base}/progress", buckets=8)
    store = spark.read.parquet(f"{base}/store")
    return store.select("source_type", "source_id", F.col("raw_metadata")["t"].cast("bigint").alias("latest"))


@plan(
    "k07_delta_store",
    """SELECT event_type AS source_type, user_id::VARCHAR AS source_id, arg_max(event_id, (epoch_us(ts), event_id))::VARCHAR AS title, max(epoch_us(ts)) AS latest
    FROM events WHERE event_id % 2 = 1 OR (event_type, user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE event_id % 2 = 1) GROUP BY ALL""",
)
def _(spark, sf):
    """Even events as the first batch, odd ones as the second, which wins; the first one is compacted in between."""
    import uuid

    from echoloom.session import ensure_checkpoint_dir
    from echoloom.sources import store

    text = lambda c: F.col(c).cast("string")
    events = T.read(spark, sf, "events")
    records = events.select(
        F.col("event_type").alias("source_type"), text("user_id").alias("source_id"), F.lit("").alias("url"), text("event_id").alias("title"),
        F.lpad(text("event_id"), 20, "0").alias("content"), text("user_id").alias("author"), F.lit("").alias("author_url"), F.col("ts").alias("timestamp"),
        F.create_map(F.lit("t"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")).alias("raw_metadata"), (F.col("event_id") % 2).alias("odd"),
    )
    path = f"{ensure_checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}"
    add = store.store_batches(path, buckets=8, every=1)
    add(records.where("odd = 0"), 0)
    store.add_batch(records.where("odd = 1"), path, 1, buckets=4)
    found = store.read_store(spark, path)
    return found.select("source_type", "source_id", "title", F.col("raw_metadata")["t"].cast("bigint").alias("latest"))


@plan("a17_table_scan", "SELECT source AS source_type, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def _(spark, sf):
    """Scan with a declared schema: two columns reach the reader."""
    docs = spark.read.schema("source string, n_chars bigint").parquet(f"{sf}/documents.parquet")
    return docs.groupBy(F.col("source").alias("source_type")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))
