"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.session import ensure_checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows to which a file of an intermediate table is worth its cost.
FILE_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once for a row although the body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def frozen(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint: later readers see the same rows in the same partitions.

    With `rows`, the rows that `df` comes from, neighbouring partitions go to one file: a file for FILE_ROWS of them,
    or for each core. Hadoop's local file system starts two processes for every file, to set its mode.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    return df.checkpoint()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a task; at the end, memory that is free goes back to the system.

    Python workers outlive their tasks, and Arrow and the C library would keep it for the life of the worker.
    """

    def finished(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library only
                trim(0)

    return finished


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def spare(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sampled(keys: Column, share: float) -> Column:
    """True for a fixed pseudo-random share of keys, the same rows at every run."""
    return F.pmod(F.xxhash64(keys), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that the job itself wrote, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
