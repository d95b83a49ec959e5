"""Continuous ingest: normalise, drop repeated keys, keep the keyed store up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.operators.normalize import normalize_documents
from echoloom.session import ensure_checkpoint_dir
from echoloom.sources import canonical as C

KEY = C.KEY


def normalized_stream(raw: DataFrame, lateness: str) -> DataFrame:
    """Raw feedback stream → processed documents, each (source_type, source_id) once.

    Rows later than `lateness` behind the newest are dropped and the key state is bounded by it; a
    backfill, where files come in any order, goes through `run_ingest`.
    """
    timed = raw.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    once = timed.dropDuplicatesWithinWatermark(["source_type", "source_id"])
    return normalize_documents(once.drop("event_time"))


def add_normalized(path: str) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that appends the documents of keys not seen in an earlier batch.

    Nothing is dropped for its age: keys are known from the batches written before, of which only the
    key columns are read. A batch writes its keys and its documents to folders of its own, so a repeated
    batch replaces them. Of rows that repeat a key inside a batch the latest counts; rows without a
    whole key cannot be stored, as in `canonical.ingest_summary`.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.struct(F.col("timestamp"), F.xxhash64("content"))
        once = batch.dropna(subset=KEY).groupBy(*KEY).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if stored(spark, f"{path}/keys"):
            schema = ", ".join(f"{k} {batch.schema[k].dataType.simpleString()}" for k in KEY) + ", batch bigint"
            known = spark.read.schema(schema).parquet(f"{path}/keys").where(F.col("batch") < batch_id)
            once = once.join(known.select(*KEY), KEY, "left_anti").select(*batch.columns)
        fresh = once.persist()
        normalize_documents(fresh).write.mode("overwrite").parquet(f"{path}/documents/batch={batch_id}")
        fresh.select(*KEY).write.mode("overwrite").parquet(f"{path}/keys/batch={batch_id}")
        fresh.unpersist()

    return add


def run_ingest(raw: DataFrame, out: str | None = None) -> DataFrame:
    """All documents of what has landed so far; a rerun with the same `out` adds what is new."""
    spark = raw.sparkSession
    base = out or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    query = raw.writeStream.foreachBatch(add_normalized(base)).option("checkpointLocation", f"{base}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    schema = normalize_documents(raw).schema
    if not stored(spark, f"{base}/documents"):  # nothing has landed yet
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/documents").drop("batch")


def stored(spark: SparkSession, path: str) -> bool:
    """True if the store exists; a store that cannot be read is an error of its own, never an empty one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def upsert_batches(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that merges raw records into a bucketed parquet store.

    A batch reads and rewrites only the buckets its keys fall into. Merging the same batch
    again gives the same rows, so a repeated batch does no harm.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        as_of = F.current_timestamp().cast("timestamp_ntz")
        bucket = F.pmod(F.xxhash64(*C.KEY), F.lit(buckets)).cast("int")
        new = batch.select(*C.COLUMNS).checkpoint()
        touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        if stored(spark, path):
            current = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        else:
            current = C.with_ids(new, as_of).limit(0)
        merged = C.upsert(current, new, as_of).withColumn("bucket", bucket).checkpoint()
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return merge


def run_upsert(stream: DataFrame, path: str, progress: str, buckets: int = 64) -> None:
    query = (
        stream.writeStream.foreachBatch(upsert_batches(path, buckets)).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
