"""How content moves between segments of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sentiment import signed

SEGMENTS = ("community", "age_bracket", "persona")


# Where a user's metadata may hold a segment, the first that is there counts.
PATHS = {
    "age_bracket": ("$.age_bracket", "$.persona.age_bracket"),
    "persona": ("$.primary_persona", "$.persona.primary_persona", "$.persona.name", "$.persona"),
}


def metadata(kind: str, c: str = "extra_metadata") -> Column:
    return F.coalesce(*[F.get_json_object(c, p) for p in PATHS[kind]])


def segment_key(kind: str) -> Column:
    if kind not in SEGMENTS:
        raise ValueError(f"no such segment: {kind!r}")
    if kind == "community":
        return F.when(F.col("community_id").isNotNull(), F.concat(F.lit("community_"), F.col("community_id").cast("string"))).otherwise("community_unknown")
    return F.coalesce(F.when(F.col(kind) != "", F.col(kind)), F.lit("unknown_age" if kind == "age_bracket" else "unknown_persona"))


def _segments(users: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    kinds = {k: metadata(k) if "extra_metadata" in users.columns else none for k in PATHS}
    return users.select(F.col("id").alias("user_id"), *[c.alias(k) for k, c in kinds.items()])


def adoptions(events: DataFrame, communities: DataFrame, analytics: DataFrame, users: DataFrame) -> DataFrame:
    """events (cascade_id, post_id, user_id, timestamp_ms) with their user's segments and their post's sentiment."""
    a = analytics.select("post_id", "sentiment_score", "effective_polarity")
    rows = events.join(communities.select("user_id", "community_id"), "user_id", "left")
    return rows.join(a, "post_id", "left").join(_segments(users), "user_id", "left")


def topic_adoptions(posts: DataFrame, communities: DataFrame, analytics: DataFrame, users: DataFrame, topic: str, start: str, end: str) -> DataFrame:
    """As ``adoptions``: the posts of a span whose text has the topic, as one cascade of its name."""
    at = F.col("ts")
    spanned = posts.filter((at >= F.lit(start).cast("timestamp")) & (at <= F.lit(end).cast("timestamp")))
    found = spanned.filter(F.lower("text").like(f"%{topic.lower()}%"))
    events = found.select(F.lit(topic).alias("cascade_id"), F.col("id").alias("post_id"), F.col("author_id").alias("user_id"), F.unix_millis("ts").alias("timestamp_ms"))
    return adoptions(events, communities, analytics, users)


def arrivals(rows: DataFrame, kind: str) -> DataFrame:
    """(cascade_id, segment, place, first_ms, first_user, sentiment): segments in the order in which they were reached."""
    keyed = rows.withColumn("segment", segment_key(kind)).withColumn("_s", F.when(F.col("sentiment_score").isNotNull(), signed(F.col("effective_polarity"), F.col("sentiment_score"))))
    by = keyed.groupBy("cascade_id", "segment").agg(F.min(F.struct("timestamp_ms", "user_id")).alias("f"), F.round(F.round(F.coalesce(F.avg("_s"), F.lit(0.0)), 10), 4).alias("sentiment"), F.count(F.lit(1)).alias("adoptions"))
    place = F.row_number().over(Window.partitionBy("cascade_id").orderBy("f.timestamp_ms", "segment"))
    return by.select("cascade_id", "segment", place.alias("place"), F.col("f.timestamp_ms").alias("first_ms"), F.col("f.user_id").alias("first_user"), "sentiment", "adoptions")


def transitions(reached: DataFrame) -> DataFrame:
    """From each segment to the next one reached: latency in seconds, users and change of sentiment."""
    w = Window.partitionBy("cascade_id").orderBy("place")
    nxt = {c: F.lead(c).over(w).alias(f"_{c}") for c in ("segment", "first_ms", "first_user", "sentiment")}
    rows = reached.select("cascade_id", "place", "segment", "first_ms", "first_user", "sentiment", *nxt.values()).filter("_segment is not null")
    return rows.select(
        "cascade_id", "place", F.col("segment").alias("from_segment"), F.col("_segment").alias("to_segment"), F.greatest(F.lit(0.0), (F.col("_first_ms") - F.col("first_ms")) / 1000).alias("latency_seconds"),
        F.col("first_user").alias("source_user"), F.col("_first_user").alias("target_user"), F.round(F.col("_sentiment") - F.col("sentiment"), 4).alias("sentiment_drift"),
    )


def drift(reached: DataFrame) -> DataFrame:
    """Per cascade: first and last segment reached, their sentiments and the change."""
    first, last = F.min(F.struct("place", "segment", "sentiment")), F.max(F.struct("place", "segment", "sentiment"))
    out = reached.groupBy("cascade_id").agg(first.alias("a"), last.alias("b"), F.count(F.lit(1)).alias("segments"), F.sum("adoptions").alias("adoptions"))
    return out.select("cascade_id", F.col("a.segment").alias("origin"), F.col("b.segment").alias("final"), "segments", "adoptions", F.col("a.sentiment").alias("origin_sentiment"), F.round(F.col("b.sentiment") - F.col("a.sentiment"), 4).alias("drift"))
