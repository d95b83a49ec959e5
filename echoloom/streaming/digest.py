"""Windowed digest counts over an event stream.

`period_counts` and `sliding_counts` emit a window once, when the watermark has passed its end; rows later
than the stated lateness are lost to it. `run_counts` keeps every row: each micro-batch adds its partial
counts, so late rows and windows still open are counted whenever the result is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.session import ensure_checkpoint_dir
from echoloom.streaming.ingest import stored


def period_counts(events: DataFrame, time: str, lateness: str, period: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per tumbling period, emitted when the watermark has passed the period's end."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counts = timed.groupBy(F.window(time, period), *keys).agg(F.count("*").alias("items"))
    return counts.select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), *keys, "items")


def sliding_counts(events: DataFrame, time: str, lateness: str, length: str = "7 days", step: str = "1 day") -> DataFrame:
    """Rows per sliding window; a batch job compares each with the window before it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counts = timed.groupBy(F.window(time, length, step)).agg(F.count("*").alias("items"))
    return counts.select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "items")


def add_counts(path: str, window: Callable[[Column], Column], time: str, keys: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that writes a batch's counts to a folder of its own; a repeated batch replaces it."""

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(window(F.col(time).cast("timestamp")).alias("w"), *keys).agg(F.count("*").alias("items"))
        rows = counts.select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *keys, "items")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return add


def total_counts(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per window and key, summed over all micro-batches so far."""
    return parts.groupBy("period_start", "period_end", *keys).agg(F.sum("items").alias("items"))


def run_counts(events: DataFrame, time: str, length: str, step: str | None = None, keys: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """Counts of all windows over all that is available, late rows included; rows without a time are in none.

    A rerun with the same `out` goes on where the last one stopped and adds what has landed since.
    """
    spark = events.sparkSession
    base = out or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    add = add_counts(f"{base}/counts", lambda t: F.window(t, length, step), time, keys)
    events.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    kinds = "".join(f", {k} {events.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"period_start timestamp, period_end timestamp{kinds}, items bigint, batch bigint"
    if not stored(spark, f"{base}/counts"):  # nothing has landed yet
        return total_counts(spark.createDataFrame([], schema), keys)
    return total_counts(spark.read.schema(schema).parquet(f"{base}/counts"), keys)
