"""Ranks and running totals over a whole table without a one-task window.

A window with no partition key sends every row to a single task. Here the rows
are range-partitioned on the order, each partition works alone, and only one
total per partition (at most ``spark.sql.shuffle.partitions`` rows) is combined
in one place and broadcast back. The order must identify a row; callers
aggregate to distinct keys first, which also removes any hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewfold.storage import materialize

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def _before(column: str) -> Column:
    """Total of ``column`` over the range partitions before this one."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def ranked(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in ``order``."""
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_slot", _LOCAL_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_part", _before("_rows").alias("_offset"))
    local = F.col("_slot").bitwiseAND(F.lit(_LOCAL_MASK))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + local + 1)
        .drop("_part", "_slot", "_offset")
    )


def running_totals(df: DataFrame, order: Sequence[Column], totals: Mapping[str, str]) -> DataFrame:
    """Add inclusive running totals in ``order``.

    ``totals`` maps a new column to the column it sums. The sum over the whole
    table is added as ``<new column>_all``.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(*[F.sum(src).alias(f"_{out}") for out, src in totals.items()])
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "_part",
        *[_before(f"_{out}").alias(f"_{out}_before") for out in totals],
        *[F.sum(f"_{out}").over(whole).alias(f"{out}_all") for out in totals],
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select("*", *[F.sum(src).over(inside).alias(f"_{out}_here") for out, src in totals.items()])
    joined = running.join(F.broadcast(offsets), "_part")
    return joined.select(
        *df.columns,
        *[(F.col(f"_{out}_before") + F.col(f"_{out}_here")).alias(out) for out in totals],
        *[f"{out}_all" for out in totals],
    )


def with_row_index(df: DataFrame, order: Sequence[Column], base: int = 0, out: str = "row_index") -> DataFrame:
    """Position of each row in ``order``, counted from ``base``."""
    return ranked(df, order, out).withColumn(out, F.col(out) - 1 + base)
