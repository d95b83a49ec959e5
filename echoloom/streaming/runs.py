"""Run a stream over what has landed so far, and read streams from table folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from echoloom.session import ensure_checkpoint_dir


def stream_parquet(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream over `<folder>/<name>`, one file or a folder of files; the schema is taken from the files, not inferred per batch."""
    table = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(table)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(table)


def run_available(stream: DataFrame, out: str | None = None, mode: str = "append") -> DataFrame:
    """Process everything available, then return the written rows.

    Rows and the stream's own progress live under the shared checkpoint folder unless `out`
    names another shared place; a rerun with the same `out` goes on where it stopped.
    """
    spark = stream.sparkSession
    base = out or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
