"""Places in an order of a whole table, without a task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place, from 0, in an order that no two rows share.

    Rows are dealt by ranges of the order and sorted within each; a range's first place is the sum of the sizes of those
    before it, of which there are as many as partitions. The result is written out, so that ranges are drawn only once.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt)
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = sizes.select("_part", before.alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_before") + within).drop("_part", "_before", "_at")


def numbered_within(rows: DataFrame, group: str, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place, from 0, in their group; a large group is no single task's."""
    placed = numbered(rows, group, *order, name="_all")
    first = placed.groupBy(group).agg(F.min("_all").alias("_first")).select(F.concat(F.col(group).cast("string")).alias("_key"), "_first")
    own = placed.withColumn("_key", F.col(group).cast("string"))
    return own.join(first, "_key").withColumn(name, F.col("_all") - F.col("_first")).drop("_key", "_all", "_first")
