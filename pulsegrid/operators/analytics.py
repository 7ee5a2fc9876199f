"""From a model's probabilities to the stored analytics of a post, and what is read from them for a conversation.

Probabilities come as columns: ``s_negative s_neutral s_positive`` (sentiment), ``irony``, ``p_*`` (seven emotions, see
``sentiment.calibrated``) and, where a stance model ran, ``t_favor t_against t_none``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sentiment, trees

# Targets that have a stance model of their own, and the names of its classes.
STANCE_TARGETS = ("climate", "abortion", "atheism", "feminist", "hillary")
STANCES = {"favor": "supportive", "against": "against", "none": "none"}
POLARITIES = ("negative", "neutral", "positive")
#: Columns of a stored analytics row, in order.
COLUMNS = (
    "post_id", "effective_polarity", "sentiment_score", "is_sarcastic", "irony_score", "primary_emotion", "emotion_score",
    *sentiment.EMOTIONS, "stance", "stance_score",
)


def largest(classes: Mapping[str, Column]) -> Column:
    """struct<score, label>: the class of the largest probability, of equals the first."""
    cells = [F.struct(p.cast("double").alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("label")) for i, (name, p) in enumerate(classes.items())]
    return F.array_max(F.array(*cells))


def stance_task(target: str | None) -> str | None:
    """The model for a target: one of STANCE_TARGETS, or None, where the polarity stands for it."""
    name = (target or "").strip().lower()
    return name if name in STANCE_TARGETS else None


def decided(rows: DataFrame, target: str | None = None) -> DataFrame:
    """rows with polarity, polarity_score, is_ironic, stance and stance_score.

    Ironic is an irony over 0.5. The stance is that of the target's own model; for another target the polarity's;
    without a target it is neutral with a score of 0."""
    best = largest({k: F.col(f"s_{k}") for k in POLARITIES})
    rows = rows.withColumns({"polarity": best["label"], "polarity_score": best["score"], "is_ironic": F.col("irony") > 0.5})
    if not target:
        return rows.withColumns({"stance": F.lit("neutral"), "stance_score": F.lit(0.0)})
    if stance_task(target):
        found = largest({v: F.col(f"t_{k}") for k, v in STANCES.items()})
        return rows.withColumns({"stance": found["label"], "stance_score": found["score"]})
    stance = F.when(F.col("polarity") == "positive", "supportive").when(F.col("polarity") == "negative", "against").otherwise("neutral")
    return rows.withColumns({"stance": stance, "stance_score": F.col("polarity_score")})


def analytics_rows(rows: DataFrame, target: str | None = None, irony_threshold: float = 0.85, id_col: str = "id") -> DataFrame:
    """The flat analytics row (COLUMNS) of each post: decisions, calibrated emotions, praise that is ironic turned over.

    Sarcastic is what was turned over or is ironic."""
    full = sentiment.calibrated(decided(rows, target))
    turned = sentiment.inverted(F.col("polarity"), F.col("polarity_score"), F.col("irony"), irony_threshold)
    full = full.withColumn("_turned", turned)
    out = full.select(
        F.col(id_col).cast("string").alias("post_id"), F.col("_turned.polarity").alias("effective_polarity"),
        F.col("_turned.score").alias("sentiment_score"), (F.col("_turned.is_inverted") | F.col("is_ironic")).alias("is_sarcastic"),
        F.col("irony").cast("double").alias("irony_score"), "primary_emotion", "emotion_score", "emotions.*", "stance", "stance_score",
    )
    return out.select(*COLUMNS)


def evaluated(rows: DataFrame, task: str, split: str) -> DataFrame:
    """Precision, recall and f1 of a task's decisions against ``label``: rows of ``decided`` with label.

    task: sentiment, irony or stance/<target>."""
    if task == "sentiment":
        guess = F.col("polarity")
    elif task == "irony":
        guess = F.when(F.col("is_ironic"), "irony").otherwise("non_irony")
    elif task.startswith("stance/"):
        back = F.lit("none")
        for name, stance in STANCES.items():
            back = F.when(F.col("stance") == stance, name).otherwise(back)
        guess = back
    else:
        raise ValueError(f"no such task: {task!r}")
    pairs = rows.select(F.lower("label").alias("truth"), guess.alias("predicted"))
    return sentiment.classification(pairs).withColumns({"task": F.lit(task), "split": F.lit(split)})


def conversations(posts: DataFrame, scored: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per thread: its metrics with sentiment dynamics.

    scored: analytics of the posts of threads that were scored (post_id, polarity, score, primary_emotion, stance);
    a thread without any has what ``stored`` (effective_polarity, sentiment_score, primary_emotion) knows of its
    root; ``dynamics_from`` says which: thread, root, or none."""
    tree = trees.thread_tree(posts)
    metrics = trees.thread_metrics(tree)
    dynamics = trees.thread_sentiment(tree, scored).withColumnRenamed("replies", "_replies")
    root = stored.select(
        F.col("post_id").alias("root_id"), F.col("effective_polarity").alias("_polarity"),
        F.col("sentiment_score").cast("double").alias("_score"), F.col("primary_emotion").alias("_emotion"),
    )
    rows = metrics.join(dynamics, "root_id", "left").join(root, "root_id", "left")
    have, known = F.col("_replies").isNotNull(), F.col("_polarity").isNotNull()

    def either(of_thread: Column, of_root: Column) -> Column:
        return F.when(have, of_thread).when(known, of_root)

    zero = F.lit(0.0)
    share = {"favor": "positive", "against": "negative", "neutral": "neutral"}
    return rows.select(
        "root_id", "posts", "replies", "max_depth", "branching", "participants", "duration_seconds", "mean_latency_seconds",
        either(F.col("root_sentiment"), F.col("_score")).alias("root_sentiment"),
        *[either(F.col(c), zero).alias(c) for c in ("mean_sentiment", "drift", "controversy", "hostility")],
        *[either(F.col(c), F.when(F.col("_polarity") == p, 1.0).otherwise(0.0)).alias(c) for c, p in share.items()],
        either(F.col("mood"), F.col("_emotion")).alias("mood"),
        F.when(have, "thread").when(known, "root").otherwise("none").alias("dynamics_from"),
    )


def replies_in_order(posts: DataFrame, root: str) -> DataFrame:
    """The posts of one thread but its root, by time."""
    tree = trees.thread_tree(posts.filter(F.col("root_id") == root))
    return tree.filter(F.col("id") != root).orderBy("timestamp_ms", "id")
