"""A keyed store of raw records that batches only add to.

Layout below the store's path, readable at any moment:

    delta/batch=<n>/buckets=<count>/bucket=<b>/     the latest record of each key of one batch
    base/version=<n>/buckets=<count>/bucket=<b>/    all records up to batch n, one for each key
    versions/                                       a row for each base that is whole

A batch writes its own delta and reads nothing, so it costs in proportion to itself; the same batch again replaces its
delta. A reader folds the newest whole base and the deltas after it: a key keeps what its first batch
said, with title, content, metadata and update time of its last one. Compaction writes the fold as a new base and
deletes what it replaces; whatever ends it half-way leaves the former base in force. The bucket count is part of every folder's
name, so it may change with any batch or compaction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.sources import canonical as C

BUCKETS = 64
#: Batches between two compactions.
COMPACT_EVERY = 50
CHANGING = ["title", "content", "raw_metadata", "updated_at"]

_TEXT = T.StringType()
SCHEMA = T.StructType(
    [T.StructField(c, T.TimestampNTZType() if c == "timestamp" else T.MapType(_TEXT, _TEXT) if c == "raw_metadata" else _TEXT) for c in C.COLUMNS]
    + [T.StructField("id", _TEXT), T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType())]
)
_PLACE = [T.StructField("buckets", T.IntegerType()), T.StructField("bucket", T.IntegerType())]


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _there(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The n of all folders `<name>=<n>` in a folder."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}="))


def bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64(*C.KEY), buckets).cast("int")


def _written(rows: DataFrame, path: str, buckets: int) -> None:
    placed = rows.select(*SCHEMA.fieldNames()).withColumn("buckets", F.lit(buckets)).withColumn("bucket", bucket(F.lit(buckets)))
    placed.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def add_batch(records: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Store a batch; of records that repeat a key the latest counts, records without a whole key are left out."""
    new = C.latest_per_key(records.select(*C.COLUMNS).dropna(subset=C.KEY))
    as_of = F.current_timestamp().cast("timestamp_ntz")
    _written(C.with_ids(new.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), as_of), f"{path}/delta/batch={batch}", buckets)


def version(spark: SparkSession, path: str) -> int:
    """The last batch of the base in force; -1 without one."""
    if not _there(spark, f"{path}/versions"):
        return -1
    return spark.read.schema("version bigint").parquet(f"{path}/versions").agg(F.max("version")).first()[0]


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Rows of the base and the deltas after it with their batch, and the last batch."""
    last = version(spark, path)
    deltas = [n for n in _numbers(spark, f"{path}/delta", "batch") if n > last]
    parts = spark.createDataFrame([], T.StructType([*SCHEMA.fields, *_PLACE, T.StructField("batch", T.LongType())]))
    read = lambda folder: spark.read.schema(T.StructType([*SCHEMA.fields, *_PLACE])).parquet(folder)
    if last >= 0:
        parts = parts.unionByName(read(f"{path}/base/version={last}").withColumn("batch", F.lit(last).cast("long")))
    if deltas:
        every = spark.read.schema(T.StructType([*SCHEMA.fields, *_PLACE, T.StructField("batch", T.LongType())])).option("basePath", f"{path}/delta")
        parts = parts.unionByName(every.parquet(*[f"{path}/delta/batch={n}" for n in deltas]))
    return parts, max([last, *deltas])


def _folded(parts: DataFrame) -> DataFrame:
    fixed = [c for c in SCHEMA.fieldNames() if c not in C.KEY and c not in CHANGING]
    out = parts.groupBy(*C.KEY).agg(F.min_by(F.struct(*fixed), "batch").alias("f"), F.max_by(F.struct(*CHANGING), "batch").alias("c"))
    return out.select(*C.KEY, "f.*", "c.*").select(*SCHEMA.fieldNames())


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One record for each key; no rows for a store that has none yet."""
    return _folded(_parts(spark, path)[0])


def find(spark: SparkSession, path: str, source_type: str, source_id: str) -> DataFrame:
    """The record of a key; only the key's bucket of the base and of each delta is read."""
    parts = _parts(spark, path)[0]
    at = F.pmod(F.xxhash64(F.lit(source_type), F.lit(source_id)), F.col("buckets")).cast("int")
    return _folded(parts.where((F.col("bucket") == at) & (F.col("source_type") == source_type) & (F.col("source_id") == source_id)))


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Make the fold the new base, then delete the deltas and bases it replaces."""
    parts, last = _parts(spark, path)
    if last < 0:
        return
    if last > version(spark, path):
        _written(_folded(parts), f"{path}/base/version={last}", buckets)
        spark.createDataFrame([(last,)], "version bigint").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    files, _ = _files(spark, path)
    gone = [f"delta/batch={n}" for n in _numbers(spark, f"{path}/delta", "batch") if n <= last]
    for name in gone + [f"base/version={n}" for n in _numbers(spark, f"{path}/base", "version") if n != last]:
        files.delete(_files(spark, f"{path}/{name}")[1], True)


def store_batches(path: str, buckets: int = BUCKETS, every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that adds each batch and compacts after each `every` of them.

    A batch that comes again after it was compacted leaves a delta that no reader looks at.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, path, batch_id, buckets)
        if (batch_id + 1) % every == 0:
            compact(batch.sparkSession, path, buckets)

    return add
