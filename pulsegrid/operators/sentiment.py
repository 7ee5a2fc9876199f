"""Sentiment over time, between windows and within emotions; model outputs come as columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import intensity, tweet_normalised
from ..functions.time import time_bucket

EMOTIONS = ("joy", "optimism", "anger", "sadness", "fear", "anxiety", "excitement", "surprise", "disgust", "neutral")


def signed(polarity: Column, score: Column, neutral: Column | None = None) -> Column:
    """-|score| for negative, |score| for positive; otherwise ``neutral`` (the score as it is unless given)."""
    return F.when(polarity == "negative", -F.abs(score)).when(polarity == "positive", F.abs(score)).otherwise(score if neutral is None else neutral)


def inverted(label: Column, score: Column, irony: Column, threshold: float = 0.85, invert: bool = True) -> Column:
    """struct<polarity, score, is_inverted>: praise that is ironic beyond the threshold counts as blame."""
    turned = (label == "positive") & (irony >= threshold) if invert else F.lit(False)
    value = F.when(turned | (label == "negative"), -score).when(label == "positive", score).otherwise(0.0)
    return F.struct(F.when(turned, "negative").otherwise(label).alias("polarity"), value.alias("score"), turned.alias("is_inverted"))


def generic_stance(polarity: Column, score: Column) -> Column:
    return F.struct(F.when(polarity == "positive", "favor").when(polarity == "negative", "against").otherwise("neutral").alias("stance"), F.abs(score).alias("score"))


def calibrated(rows: DataFrame, text: str = "text", alpha: float = 0.6) -> DataFrame:
    """rows with columns p_joy, p_fear, p_anger, p_sadness, p_surprise, p_disgust, p_neutral to ``emotions`` (a struct
    of ten shares that sum to 1), ``primary_emotion`` and ``emotion_score``.

    Words in the text take anxiety out of fear, excitement and then optimism out of joy.
    """
    part = lambda p, s: F.when(s > 0, F.least(p, p * alpha + (1 - alpha) * s)).otherwise(0.0)
    rows = rows.withColumns({f"_{k}": intensity(F.col(text), k) for k in ("anxiety", "excitement", "optimism")})
    rows = rows.withColumns({"_anx": part(F.col("p_fear"), F.col("_anxiety")), "_exc": part(F.col("p_joy"), F.col("_excitement"))})
    rows = rows.withColumn("_joy", F.greatest(F.lit(0.0), F.col("p_joy") - F.col("_exc")))
    rows = rows.withColumn("_opt", F.when(F.col("_optimism") > 0, F.least(F.col("_joy"), F.round(F.col("_joy") * 0.5 * F.col("_optimism"), 4))).otherwise(0.0))
    raw = {
        "joy": F.greatest(F.lit(0.0), F.col("_joy") - F.col("_opt")), "optimism": F.col("_opt"), "anger": F.col("p_anger"), "sadness": F.col("p_sadness"),
        "fear": F.greatest(F.lit(0.0), F.col("p_fear") - F.col("_anx")), "anxiety": F.col("_anx"), "excitement": F.col("_exc"),
        "surprise": F.col("p_surprise"), "disgust": F.col("p_disgust"), "neutral": F.col("p_neutral"),
    }
    rows = rows.withColumn("_sum", sum(raw.values(), F.lit(0.0)))
    share = F.array(*[F.when(F.col("_sum") > 0, F.round(raw[k] / F.col("_sum"), 4)).otherwise(raw[k]) for k in EMOTIONS])
    rows = rows.withColumn("_share", share)
    rows = rows.withColumn("_top", F.array_position("_share", F.array_max("_share")).cast("int") - 1)
    drift = F.when(F.col("_sum") > 0, F.round(1 - F.aggregate("_share", F.lit(0.0), lambda a, b: a + b), 4)).otherwise(0.0)
    rows = rows.withColumn("_share", F.transform("_share", lambda x, i: F.when(i == F.col("_top"), F.round(x + drift, 4)).otherwise(x)))
    out = F.struct(*[F.get("_share", F.lit(i)).alias(k) for i, k in enumerate(EMOTIONS)])
    names = F.array(*map(F.lit, EMOTIONS))
    rows = rows.withColumns({"emotions": out, "primary_emotion": F.get(names, F.array_position("_share", F.array_max("_share")).cast("int") - 1), "emotion_score": F.array_max("_share")})
    return rows.drop("_anxiety", "_excitement", "_optimism", "_anx", "_exc", "_joy", "_opt", "_sum", "_share", "_top")


def temporal(posts: DataFrame, analytics: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Averages and shares per bucket; the dominant emotion is the most frequent one, of equals the first by name."""
    rows = posts.join(analytics, F.col("id") == F.col("post_id")).withColumn("bucket", time_bucket(F.col("ts"), interval))
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    is_ = lambda *names: F.col("primary_emotion").isin(*names)
    stats = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("posts"), F.avg("sentiment_score").alias("avg_sentiment"),
        *[rate(F.col("effective_polarity") == p).alias(f"{p}_ratio") for p in ("positive", "negative", "neutral")],
        rate(F.col("is_sarcastic")).alias("sarcasm_rate"), F.avg("irony_score").alias("avg_irony"), rate(is_("joy")).alias("joy_ratio"),
        rate(is_("fear", "anxiety")).alias("anxiety_ratio"), rate(is_("anger")).alias("anger_ratio"), rate(is_("sadness")).alias("sadness_ratio"),
    )
    modes = rows.groupBy("bucket", "primary_emotion").agg(F.count(F.lit(1)).alias("_n")).groupBy("bucket").agg(F.min_by("primary_emotion", F.struct(-F.col("_n"), F.col("primary_emotion"))).alias("dominant_emotion"))
    return stats.join(modes, "bucket")


def history(posts: DataFrame, analytics: DataFrame, start: str, end: str, interval: str = "1 hour", limit: int = 1000) -> DataFrame:
    """``temporal`` over the oldest ``limit`` posts of a span."""
    spanned = posts.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    return temporal(spanned.orderBy("ts", "id").limit(limit), analytics, interval)


def drift(posts: DataFrame, analytics: DataFrame, topic: str, t1: str, t2: str, t3: str, margin: float = 0.10, jump: float = 0.35) -> DataFrame:
    """One row: mean signed sentiment of a topic's posts in [t1, t2) and [t2, t3], the shift, whether it turned over, and a
    status: insufficient_data if a window is empty."""
    at = F.col("ts")
    rows = posts.filter(F.lower("text").like(f"%{topic.lower()}%") & (at >= F.lit(t1).cast("timestamp")) & (at <= F.lit(t3).cast("timestamp")))
    rows = rows.join(analytics, F.col("id") == F.col("post_id"), "left").withColumn("_s", signed(F.col("effective_polarity"), F.coalesce("sentiment_score", F.lit(0.0)), F.lit(0.0)))
    early = at < F.lit(t2).cast("timestamp")
    out = rows.agg(F.count(F.when(early, 1)).alias("baseline_posts"), F.count(F.when(~early, 1)).alias("active_posts"), F.avg(F.when(early, F.col("_s"))).alias("_b"), F.avg(F.when(~early, F.col("_s"))).alias("_a"))
    b, a = F.col("_b"), F.col("_a")
    opposed = ((b >= margin) & (a <= -margin)) | ((b <= -margin) & (a >= margin)) | ((F.abs(a - b) >= jump) & (a * b < 0))
    zero = F.lit(0.0)
    return out.select("baseline_posts", "active_posts", F.round(F.coalesce(b, zero), 4).alias("baseline_sentiment"), F.round(F.coalesce(a, zero), 4).alias("active_sentiment"), F.round(F.coalesce(a, zero) - F.coalesce(b, zero), 4).alias("shift"), F.coalesce(opposed, F.lit(False)).alias("inverted"), F.when(b.isNull() | a.isNull(), "insufficient_data").otherwise("ok").alias("status"))


def latest_drift(posts: DataFrame, analytics: DataFrame, topic: str, minutes: float) -> DataFrame:
    """``drift`` of the last window against the one before, up to the latest post."""
    end = posts.agg(F.max("ts").cast("string")).first()[0]
    if end is None:
        return drift(posts, analytics, topic, "1970-01-01", "1970-01-01", "1970-01-01")
    t3 = datetime.fromisoformat(end)
    t1, t2 = (str(t3 - k * timedelta(minutes=minutes)) for k in (2, 1))
    return drift(posts, analytics, topic, t1, t2, end)


def scored(posts: DataFrame, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], schema: str, text: str = "text", batch: int = 32) -> DataFrame:
    """posts with a struct ``model`` from a scorer of normalised texts, batch by batch.

    load is called once in each Python worker that runs tasks, by the first batch, and gives the scorer; so a model is
    read where it is used and kept for later tasks of the worker."""
    key = f"{getattr(load, '__module__', '')}.{getattr(load, '__qualname__', '')}.{uuid.uuid4().hex}"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import builtins

        kept = builtins.__dict__.setdefault("_pulsegrid_scorers", {})
        if key not in kept:
            kept[key] = load()
        for b in batches:
            parts = [kept[key](b.iloc[i : i + batch].reset_index(drop=True)) for i in range(0, len(b), batch)]
            yield pd.concat(parts, ignore_index=True) if parts else kept[key](b)

    return posts.withColumn("model", run(tweet_normalised(F.col(text))))


def classification(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Per label: precision, recall, f1, support; accuracy and macro_f1 in each row. Division by zero gives 0."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("g"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("h")))).alias("x"))
    by = labels.groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.g").alias("_guessed"), F.sum("x.h").alias("_hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    by = by.withColumns({"precision": ratio(F.col("_hits"), F.col("_guessed")), "recall": ratio(F.col("_hits"), F.col("support"))})
    by = by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    everything = Window.partitionBy(F.lit(0))  # a row for each label
    return by.select("label", "support", "precision", "recall", "f1", (F.sum("_hits").over(everything) / F.sum("support").over(everything)).alias("accuracy"), F.avg("f1").over(everything).alias("macro_f1"))
