"""Upserts, counts and look-ups on the stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {
    "posts": ["id"], "users": ["id"], "cascade_events": ["cascade_id", "post_id", "adoption_order"],
    "graph_edges": ["source_id", "target_id", "relation_type"], "post_analytics": ["post_id"], "user_communities": ["user_id"],
}
# What a missing column of an analytics row becomes.
ANALYTICS_DEFAULTS: dict[str, Any] = {
    "effective_polarity": "neutral", "sentiment_score": 0.0, "is_sarcastic": False, "irony_score": 0.0, "primary_emotion": "neutral", "emotion_score": 0.0,
    "stance": "none", "stance_score": 0.0,
}


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows of both with one for each key: a new one goes before an old one, then the later by order.

    One pre-aggregated pass: the newest row of a key is that of the largest (source, order).
    """
    cols = old.columns
    rank = order if order is not None else F.lit(0)
    both = old.select(*cols, F.lit(0).alias("_new"), rank.alias("_at")).unionByName(new.select(*cols, F.lit(1).alias("_new"), rank.alias("_at")))
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    return both.groupBy(*keys).agg(F.max_by(row, F.struct("_new", "_at")).alias("_row")).select("_row.*")


def with_defaults(rows: DataFrame, defaults: Mapping[str, Any] = ANALYTICS_DEFAULTS) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) in one job."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.union(row)
    return out


def followers(edges: DataFrame, user: str) -> DataFrame:
    return edges.filter((F.lower("relation_type") == "follows") & (F.col("target_id") == user)).select("source_id")


def following(edges: DataFrame, user: str) -> DataFrame:
    return edges.filter((F.lower("relation_type") == "follows") & (F.col("source_id") == user)).select("target_id")


def sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    return spark.sql(text, args=dict(args or {}))


def mask_secret(c: Column) -> Column:
    """First and last four characters; up to eight are all hidden."""
    return F.when(F.length(c) <= 8, "***").otherwise(F.concat(F.substring(c, 1, 4), F.lit("..."), F.substring(c, -4, 4)))


def redact_key(url: Column) -> Column:
    """A URL without the value of its key parameter."""
    return F.regexp_replace(url, r"([?&]key=)[^&\s]+", "$1***")
