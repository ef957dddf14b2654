"""Positions within groups, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_parquet

#: The most rows (a group and four numbers each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bits of a row's number within its partition, as monotonically_increasing_id deals them.
ROW_BITS = 33


def numbered(df: DataFrame, groups: list[str], order: list[Column], at: str = "at", size: str = "size") -> DataFrame:
    """`df` with the place of each row (from 0) in its group by `order`, and with the group's size.

    Rows are dealt by range of group and order, so that a group of any size lies in many partitions in a row, sorted
    there, numbered, and written once to the shared folder. What other partitions hold of a group before a row's own
    is a running sum over one row a group and partition. A null is a group of its own; rows that tie on all of `order`
    are numbered in any way, so callers order by all that tells rows apart.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut_parquet(dealt.withColumn("row_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("row_", ROW_BITS)))
    held = rows.groupBy(*groups, "part_").agg(F.min("row_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
    whole = W.partitionBy(*groups)
    earlier = F.sum("rows_").over(whole.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    held = held.select(*[F.col(g).alias(f"{g}_of_") for g in groups], F.col("part_").alias("of_part_"), (F.coalesce(earlier, F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("rows_").over(whole).alias(size))
    if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    same = F.col("part_") == F.col("of_part_")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of_"))
    return rows.join(held, same).withColumn(at, F.col("row_") + F.col("shift_")).select(*df.columns, at, size)
