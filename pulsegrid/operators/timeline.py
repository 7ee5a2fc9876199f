"""Slices, counts and orders of posts in time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import time_bucket
from .ranks import numbered


def keyword(word: str) -> Column:
    """Text or the list of tags has the word, in any case; % and _ are wild as in LIKE."""
    return F.col("text").ilike(f"%{word}%") | F.array_join("hashtags", ", ").ilike(f"%{word}%")


def in_thread(parent: str, with_urls: bool = True) -> Column:
    """Children of a post or of the video of that name, the post itself, and posts one of whose links has the name."""
    out = (F.col("parent_id") == parent) | (F.col("id") == parent) | (F.col("parent_id") == f"video_{parent}")
    return out | F.array_join("urls", ", ").ilike(f"%{parent}%") if with_urls else out


def slice_posts(
    posts: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None, platform: str | None = None,
    word: str | None = None, parent: str | None = None, author: str | None = None, limit: int = 0,
) -> DataFrame:
    """Posts that fit all given conditions, in order of time and id; both ends count; limit 0 is none."""
    out = posts
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    if platform:
        out = out.filter(F.col("platform") == platform.lower())
    if word:
        out = out.filter(keyword(word))
    if parent:
        out = out.filter(in_thread(parent, "urls" in posts.columns))
    if author:
        out = out.filter(F.col("author_id") == author)
    out = out.orderBy("ts", "id")
    return out.limit(limit) if limit > 0 else out


def bounds(posts: DataFrame) -> DataFrame:
    """One row: start, end, total; an empty table has nulls and 0."""
    return posts.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("total"))


def activity(posts: DataFrame, interval: str) -> DataFrame:
    """Posts per bucket; buckets without posts are left out."""
    return posts.groupBy(time_bucket(F.col("ts"), interval).alias("bucket")).agg(F.count(F.lit(1)).alias("posts"))


def user_timeline(posts: DataFrame, author: str, limit: int = 100) -> DataFrame:
    return slice_posts(posts, author=author, limit=limit)


def replay_pages(posts: DataFrame, size: int) -> DataFrame:
    """posts with a page number, pages of equal size in order of time and id; no task orders the whole table or a day.

    Rows are written out on the way (``numbered``), so choose the columns that pages need first."""
    return numbered(posts, "ts", "id", name="_place").withColumn("page", F.floor(F.col("_place") / size)).drop("_place")


def since_origin(cascades: DataFrame) -> DataFrame:
    """Seconds since the first event of each cascade."""
    first = cascades.groupBy("cascade_id").agg(F.min("timestamp_ms").alias("_first"))
    return cascades.join(first, "cascade_id").withColumn("seconds", (F.col("timestamp_ms") - F.col("_first")) / 1000).drop("_first")


def unanalysed(posts: DataFrame, analytics: DataFrame, limit: int = 50) -> DataFrame:
    """The oldest posts without analytics."""
    return posts.join(analytics, F.col("id") == F.col("post_id"), "left_anti").orderBy("ts", "id").limit(limit)
