"""Stored rows: look-ups by lists and windows, orders, and rows of any shape as canonical posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids that are put in a plan as they are; more become a table.
INLINE_IDS = 1000
METRICS = T.StructType([T.StructField(c, T.LongType()) for c in ("likes", "reposts", "replies", "views", "shares")])
LISTS = ("urls", "hashtags", "mentions", "media_urls")
TEXTS = ("author_screen_name", "parent_id", "reply_to_user_id", "source_client")


def with_ids(rows: DataFrame, ids: Sequence[str] | DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among the ids: a test in the scan for a short list, a semi join for a long one or a table."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    if len(ids) <= INLINE_IDS:
        return rows.filter(F.col(key).isin(list(ids)))
    table = rows.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], f"{key} string")
    return rows.join(table, key, "left_semi")


def edges_between(edges: DataFrame, start: str, end: str, undated: bool = True) -> DataFrame:
    """Edges with a time from start to end, both included, and on demand those without, which come first."""
    at = F.col("ts")
    inside = (at >= F.lit(start).cast("timestamp")) & (at <= F.lit(end).cast("timestamp"))
    return edges.filter(at.isNull() | inside if undated else inside).orderBy(F.asc_nulls_first("ts"), "source_id", "target_id")


def latest_analytics(analytics: DataFrame) -> DataFrame:
    return analytics.orderBy(F.desc("analyzed_at"), "post_id")


def by_community(communities: DataFrame) -> DataFrame:
    return communities.orderBy("community_id", "user_id")


def canonical(rows: DataFrame) -> DataFrame:
    """Rows whose lists, metrics and metadata are JSON texts as posts; what isn't readable is empty, and the text of
    metadata that is no object is kept in ``unread``, so that nothing is lost. Ids are texts; a null text is empty."""

    def listed(c: str) -> Column:
        read = F.from_json(F.col(c), "array<string>")
        return F.coalesce(read, F.array().cast("array<string>")).alias(c)

    extra = F.col("extra_metadata")
    is_object = F.coalesce(F.trim(extra).startswith("{") & F.json_object_keys(extra).isNotNull(), F.lit(False))
    counts = F.from_json("metrics", METRICS)
    have = set(rows.columns)
    return rows.select(
        F.col("id").cast("string").alias("id"), "platform", F.col("author_id").cast("string").alias("author_id"),
        *[F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in TEXTS],
        F.coalesce("text", F.lit("")).alias("text"), "ts",
        *[listed(c) if c in have else F.array().cast("array<string>").alias(c) for c in LISTS],
        F.struct(*[(F.coalesce(counts[c], F.lit(0)) if c != "views" else counts[c]).alias(c) for c in METRICS.names]).alias("metrics"),
        F.when(is_object, extra).otherwise("{}").alias("extra_metadata"), F.when(~is_object, extra).alias("unread"),
    )
