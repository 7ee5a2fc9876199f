"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Each level looks only at rows that the level before could not tell apart. What is known of a level goes to the next
scan as a bitmap of bounded size (``key_filter``), so texts are never shuffled to find out which of them need the next
level, and a group of copies that holds a third of all rows costs one pre-aggregated row per task.

Defined cases: a null text equals the empty text; a null doc_id is smaller than any other; rows that repeat the kept
doc_id of their group are all reported as kept, while ``exact_dedup`` returns one of them; an empty table gives an
empty table; extra columns are carried whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_power, key_filter, maybe_in, text_of

#: Characters of the prefix that is hashed on the second level.
PREFIX_CHARS = 64


def _refined(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, carry: dict[str, Column]) -> DataFrame:
    """_id, _n (bytes), carried columns and _full: sha256 of the text where two levels did not tell it apart, else null."""
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), *[c.alias(k) for k, c in carry.items()]).withColumn("_n", F.octet_length("_t"))
    power = filter_power(docs.count())
    prefix = F.xxhash64(F.substring("_t", 1, prefix_chars))
    lengths = base.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    base = maybe_in(base, [F.col("_n")], key_filter(lengths, [F.col("_n")], power), "_by_length", power)
    prefixes = base.filter("_by_length").groupBy("_n", prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    base = base.withColumn("_p", F.when(F.col("_by_length"), prefix))
    base = maybe_in(base, [F.col("_n"), F.col("_p")], key_filter(prefixes, [F.col("_n"), F.col("_p")], power), "_by_prefix", power)
    return base.withColumn("_full", F.when(F.col("_by_length") & F.col("_by_prefix"), F.sha2("_t", 256)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, and with digest the sha256 of every text."""
    rows = _refined(docs, id_col, text_col, prefix_chars, {}).select("_id", "_n", "_full", *([F.coalesce("_full", F.sha2("_t", 256)).alias("text_sha256")] if digest else []))
    # Rows that are alone get a key of their own, so they spread over the join's partitions.
    rows = rows.withColumn("_k", F.concat_ws(":", "_n", F.coalesce("_full", F.hex(F.xxhash64("_id")))))
    groups = (
        rows.filter(F.col("_full").isNotNull())
        .groupBy("_n", "_full")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .filter("_size > 1")
        .select(F.concat_ws(":", "_n", "_full").alias("_k"), "_keep", "_size")  # not the key they are grouped by: the join's partitions can be split
    )
    out = rows.join(groups, "_k", "left")
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), *(["text_sha256"] if digest else [])
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs with one row for each distinct text, that of the largest id; only possible copies are shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString() and f.name != text_col]
    rows = _refined(docs, id_col, text_col, prefix_chars, {"_row": row, "_tie": F.xxhash64(*rest)})
    alone = rows.filter(F.col("_full").isNull()).select("_row.*")
    best = (
        rows.filter(F.col("_full").isNotNull())
        .groupBy("_n", "_full")
        .agg(F.max_by("_row", F.struct(F.col("_id"), F.col("_tie"))).alias("_row"))
    )
    return alone.unionByName(best.select("_row.*")) if len({c.lower() for c in docs.columns}) == len(docs.columns) else alone.union(best.select("_row.*"))
