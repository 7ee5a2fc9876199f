"""Weighted hash tree: each row descends region, rack and shard by weighted hash draws.

At every level each child draws -ln(u) / weight with u hashed (md5, 52 bits) from the key and the child's path; the smallest draw
wins, so a child gets rows in proportion to its weight. A draw depends on nothing but key, path and weight: where a
weight changes, only draws of that child and its ancestors change, and rows move only into or out of that subtree.

Law ``key``: key and tree decide. A tree for n + 1 shards is that for n with the new shard in a region of its own, so
all other weights stay and rows move only into the new shard.

Defined cases: a null text has no bytes (size 1); a null key is a key like any other; repeated rows go to the same
shard and get slots of their own; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
#: Slots are numbered within buckets of about this many rows.
BUCKET_ROWS = 50_000


def tree_for(shards: int, regions: int = 2, racks: int = 2, base: int = 8) -> Tree:
    """Equal weights: the first base shards fill regions x racks, and each further one has a region of its own."""
    tree: Tree = {}
    for s in range(shards):
        if s < base:
            region, rack = f"r{s * regions // base}", f"k{s * regions * racks // base % racks}"
        else:
            region, rack = f"r{regions + s - base}", "k0"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, path: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{path}"))), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)


def _descend(key: Column, node: dict, path: str) -> Column:
    children = [(k, c) for k, c in node.items() if _weight(c) > 0]
    if not children:
        raise ValueError(f"no weight below {path or 'the root'}")
    below = [_descend(key, c, f"{path}/{k}") if isinstance(c, dict) else F.lit(int(k)) for k, c in children]
    if len(children) == 1:
        return below[0]
    draws = [F.struct(_draw(key, f"{path}/{k}", _weight(c)).alias("d"), F.lit(i).alias("i")) for i, (k, c) in enumerate(children)]
    won = F.array_min(F.array(*draws))["i"]
    return reduce(lambda e, i: e.when(won == i, below[i]), range(1, len(below)), F.when(won == 0, below[0]))


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key; null is the key 'null'."""
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), tree, "")


def shard_rows(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Shard, gapless slot there and, with a grown tree, the shard under that; one row per input row.

    Slots come from counts of buckets, many to a shard, and a numbering within each bucket: no task numbers a shard.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_of(text_col)).cast("bigint").alias("_bytes"), F.crc32(text_of(text_col)).alias("_crc"))
    rows = rows.withColumn("_shard", place(F.col("_id"), tree)).withColumn("_grown", place(F.col("_id"), grown) if grown else F.lit(None).cast("int"))
    buckets = max(1024, docs.count() // bucket_rows)
    digest = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("_bucket", F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") % buckets)
    counts = rows.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_id", "_crc", "_bytes")) - 1
    return rows.withColumn("_rank", rank).join(starts, ["_shard", "_bucket"]).select(
        F.col("_id").alias(id_col), (F.col("_bytes") + 1).alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_start") + F.col("_rank")).cast("bigint").alias("slot"), F.col("_grown").alias("grown_shard"),
    )
