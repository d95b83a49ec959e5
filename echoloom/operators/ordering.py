"""Global order without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom.session import ensure_checkpoint_dir

_ROW_BITS = (1 << 33) - 1


def range_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by `order`, frozen, with their partition number.

    The reliable checkpoint fixes which row is in which partition, so a lost executor
    cannot change the numbers handed out below.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).checkpoint()
    return placed.withColumn("__pid", F.spark_partition_id())


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table; `order` must be unique.

    Per-partition counts become offsets (one row per partition), and each row adds its
    position inside its partition.
    """
    placed = range_sorted(df, order).withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    counts = placed.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # one row per partition: small whatever the table size
    ranked = placed.join(F.broadcast(offsets), "__pid")
    return ranked.withColumn(name, F.col("__offset") + F.col("__pos") + 1).drop("__pid", "__pos", "__offset")


def rolling(ranked: DataFrame, width: int, out: str, value, rank: str = "rank", block: int = 65536) -> DataFrame:
    """`value` over each full window of `width` rows by rank.

    Blocks of ranks are windowed separately; the last `width − 1` rows of a block are also
    sent to the next one, so no window is cut and no task holds more than a block.
    """
    home = F.floor((F.col(rank) - 1) / block)
    tail = F.pmod(F.col(rank) - 1, F.lit(block)) >= block - (width - 1)
    blocks = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    rows = ranked.withColumn("__home", home).withColumn("__block", F.explode(blocks))
    frame = W.partitionBy("__block").orderBy(rank).rowsBetween(-(width - 1), 0)
    rows = rows.withColumn(out, value.over(frame))
    return rows.where((F.col("__home") == F.col("__block")) & (F.col(rank) >= width)).drop("__home", "__block")
