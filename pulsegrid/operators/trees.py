"""Conversation threads and diffusion cascades as trees.

Trees are walked from their roots in steps of doubled length, over all trees together: a chain of any length takes one
or two joins for each doubling. What a cycle holds is never reached, so the walk ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, forget
from .ranks import numbered_within
from .sentiment import signed


def closure(nodes: DataFrame, tree: str, node: str, parent: str, with_size: bool = False) -> DataFrame:
    """(tree, node, depth[, size]) of all nodes that a root (no parent) reaches; size counts a node and all below it.

    One table, written once a doubling: before round k an open row points to the node 2**k above it (``_up``), a closed
    one has reached its root and knows its depth; sizes are of what is less than 2**k below. Open rows take the pointer
    of the node they point to; those that point nowhere go. Rows that name one node twice and so lead from a root into
    a cycle are an error.
    """
    first = [F.lit(1).cast("bigint").alias("size")] if with_size else []
    up = F.col(parent).alias("_up")
    state = cut(nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), up, F.col(parent).isNotNull().cast("int").alias("depth"), *first))
    kept = ["size"] if with_size else []
    most, closed = state.agg(F.count(F.lit(1)), F.count(F.when(F.col("_up").isNull(), 1))).first()
    step = 1
    while True:
        far = state.select("tree", F.col("node").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_d"))
        rows = state.filter("_up is not null")
        moved = rows.join(far, ["tree", "_up"]).select("tree", "node", F.col("_next").alias("_up"), (F.col("depth") + F.col("_d")).alias("depth"), *kept)
        new = state.filter("_up is null").unionByName(moved)
        if with_size:
            more = rows.groupBy("tree", F.col("_up").alias("node")).agg(F.sum("size").alias("_more"))
            new = new.join(more, ["tree", "node"], "left").select("tree", "node", "_up", "depth", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))
        former, state = state, cut(new)
        forget(former)
        open_, done = state.agg(F.count("_up"), F.count(F.when(F.col("_up").isNull(), 1))).first()
        if not open_ or done == closed:  # none in reach, or cycles alone
            return state.filter("_up is null").select("tree", "node", "depth", *kept)
        if step >= most:
            raise ValueError("a root leads into a cycle")
        closed, step = done, step * 2


# --- threads -----------------------------------------------------------------------------------------------------


def thread_tree(posts: DataFrame) -> DataFrame:
    """posts (id, parent_id, root_id, ...) with their depth; replies that no root reaches are left out."""
    depth = closure(posts, "root_id", "id", "parent_id")
    return posts.join(depth, (posts["id"] == depth["node"]) & (posts["root_id"] == depth["tree"])).drop("tree", "node")


def children(posts: DataFrame, parent: str) -> DataFrame:
    """Direct replies to a post, by time."""
    return posts.filter(F.col("parent_id") == parent).orderBy("timestamp_ms", "id")


def thread_participants(tree: DataFrame) -> DataFrame:
    """(root_id, author_id, posts): who wrote in a thread and how often, a row each."""
    return tree.groupBy("root_id", "author_id").agg(F.count(F.lit(1)).alias("posts"))


def thread_metrics(tree: DataFrame) -> DataFrame:
    """Per thread: posts, replies, max_depth, branching, participants and their names (authors, by name, comma-joined; null
    if none is known), duration and mean latency of replies, in seconds."""
    parent = tree.select("root_id", F.col("id").alias("parent_id"), F.col("timestamp_ms").alias("_before"))
    rows = tree.join(parent, ["root_id", "parent_id"], "left").withColumn("_wait", F.when(F.col("_before").isNotNull(), F.greatest(F.lit(0), F.col("timestamp_ms") - F.col("_before")) / 1000))
    base = rows.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("posts"), F.count(F.when(F.col("depth") > 0, 1)).alias("replies"), F.max("depth").alias("max_depth"),
        ((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000).alias("duration_seconds"), F.coalesce(F.avg("_wait"), F.lit(0.0)).alias("mean_latency_seconds"),
    )
    children = tree.filter("parent_id is not null").groupBy("root_id", "parent_id").agg(F.count(F.lit(1)).alias("n")).groupBy("root_id").agg(F.round(F.avg("n"), 2).alias("branching"))
    names = F.array_join(F.array_sort(F.collect_list("author_id")), ",")  # each once, as thread_participants gives them
    who = thread_participants(tree).groupBy("root_id").agg(F.count("author_id").alias("participants"), F.when(F.count("author_id") > 0, names).alias("authors"))
    return base.join(children, "root_id", "left").join(who, "root_id").select("root_id", "posts", "replies", "max_depth", F.coalesce("branching", F.lit(0.0)).alias("branching"), "participants", "authors", "duration_seconds", "mean_latency_seconds")


def depth_histogram(tree: DataFrame) -> DataFrame:
    return tree.groupBy("root_id", "depth").agg(F.count(F.lit(1)).alias("posts"))


def thread_sentiment(tree: DataFrame, analytics: DataFrame) -> DataFrame:
    """Per thread: mean reply sentiment, its drift from the root's, spread, hostility a minute, stance shares, mood.

    analytics: (post_id, polarity, score, primary_emotion, stance). The mood is the most frequent emotion of the
    replies, of equals the one that came first.
    """
    rows = tree.join(analytics, F.col("id") == F.col("post_id")).withColumn("_s", signed(F.col("polarity"), F.col("score"), F.lit(0.0)))
    reply = F.col("depth") > 0
    when = lambda c: F.when(reply, c)
    share = lambda *names: F.coalesce(F.avg(when(F.when(F.col("stance").isin(*names), 1.0).otherwise(0.0))), F.lit(0.0))
    minutes = F.greatest(F.lit(1.0), (F.max(when(F.col("timestamp_ms"))) - F.min(when(F.col("timestamp_ms")))) / 60000)
    out = rows.groupBy("root_id").agg(
        F.count(when(F.lit(1))).alias("replies"), F.max(F.when(~reply, F.col("_s"))).alias("root_sentiment"), F.coalesce(F.avg(when(F.col("_s"))), F.lit(0.0)).alias("mean_sentiment"),
        F.coalesce(F.stddev_samp(when(F.col("_s"))), F.lit(0.0)).alias("controversy"), F.coalesce(F.count(when(F.when(F.col("primary_emotion").isin("anger", "anxiety", "disgust"), 1))) / minutes, F.lit(0.0)).alias("hostility"),
        share("favor").alias("favor"), share("against").alias("against"), share("neutral", "none").alias("neutral"),
    )
    counts = rows.filter(reply).groupBy("root_id", "primary_emotion").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("timestamp_ms", "id")).alias("at"))
    mood = counts.groupBy("root_id").agg(F.min_by("primary_emotion", F.struct(-F.col("n"), F.col("at"))).alias("mood"))
    out = out.join(mood, "root_id", "left")
    return out.withColumn("drift", F.when(F.col("replies") > 0, F.col("mean_sentiment") - F.col("root_sentiment")).otherwise(0.0))


# --- cascades ----------------------------------------------------------------------------------------------------


def first_adopters(events: DataFrame) -> DataFrame:
    """The first event of each user in each cascade, numbered from 0 by adoption order and time."""
    row = F.struct(*[F.col(c) for c in events.columns])
    once = events.groupBy("cascade_id", "user_id").agg(F.min_by(row, F.struct("adoption_order", "timestamp_ms")).alias("_row")).select("_row.*")
    return numbered_within(once, "cascade_id", "adoption_order", "timestamp_ms", "user_id", name="ord")


def parents(adopters: DataFrame, follows: DataFrame) -> DataFrame:
    """adopters with parent: an earlier adopter of the parent post if given, else the latest earlier adopter whom the
    user follows (of equal times the first), else the first adopter; null for the first.

    Candidates come from the users' follow edges: a row for each edge holds the followed user's cascades as arrays, and is
    met with the follower's own where those lie, so neither a cascade nor a user's edges times cascades is shuffled.
    """
    a = adopters if "parent_event_id" in adopters.columns else adopters.withColumn("parent_event_id", F.lit(None).cast("string"))
    prior = a.select("cascade_id", F.col("user_id").alias("_by"), F.col("post_id").alias("_post"), F.col("ord").alias("_ord"), F.col("timestamp_ms").alias("_ts"))
    named = a.filter("parent_event_id is not null").select("cascade_id", "user_id", "ord", F.col("parent_event_id").alias("_post"))
    explicit = named.join(prior, ["cascade_id", "_post"]).filter("_ord < ord").select("cascade_id", "user_id", "_by", F.lit(1).alias("_sure"), "_ts", "_ord")
    edges = follows.select(F.col("source_id").alias("user_id"), F.col("target_id").alias("_by")).distinct()
    roots = cut(a.filter("ord = 0").select("cascade_id", F.col("user_id").alias("_root")).withColumn("_c", F.monotonically_increasing_id()))
    coded = a.join(roots.select("cascade_id", "_c"), "cascade_id").select("user_id", F.struct("_c", "ord", F.col("timestamp_ms").alias("_ts")).alias("_x"))
    own = coded.groupBy("user_id").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    lists = own.select("user_id", *[F.col("_x")[c].alias(f"_{c}s") for c in ("_c", "ord", "_ts")])  # three plain arrays take least to shuffle
    theirs = edges.join(lists.withColumnRenamed("user_id", "_by"), "_by")
    met = theirs.join(own, "user_id").select("user_id", "_by", "__cs", "_ords", "__tss", F.explode("_x").alias("_x")).withColumn("_i", F.array_position("__cs", F.col("_x")["_c"]).cast("int") - 1)
    met = met.filter("_i >= 0").select("user_id", "_by", F.col("_x")["_c"].alias("_c"), F.col("_x")["ord"].alias("ord"), F.get("_ords", "_i").alias("_ord"), F.get("__tss", "_i").alias("_ts")).filter("_ord < ord")
    nearest = met.groupBy("user_id", "_c").agg(F.max_by(F.struct("_by", "_ts", "_ord"), F.struct("_ts", -F.col("_ord"))).alias("_m"))
    followed = nearest.join(roots, "_c").select("cascade_id", "user_id", F.col("_m")["_by"].alias("_by"), F.lit(0).alias("_sure"), F.col("_m")["_ts"].alias("_ts"), F.col("_m")["_ord"].alias("_ord"))
    best = explicit.union(followed).groupBy("cascade_id", "user_id").agg(F.max_by("_by", F.struct("_sure", "_ts", -F.col("_ord"))).alias("_parent"))
    out = a.join(best, ["cascade_id", "user_id"], "left").join(roots.drop("_c"), "cascade_id")
    return out.withColumn("parent", F.when(F.col("ord") > 0, F.coalesce("_parent", "_root"))).drop("_parent", "_root")


def cascade_rows(events: DataFrame, follows: DataFrame) -> DataFrame:
    """(cascade_id, user_id, post_id, ord, timestamp_ms, parent) of all first adoptions, written out."""
    return cut(parents(first_adopters(events), follows).select("cascade_id", "user_id", "post_id", "ord", "timestamp_ms", "parent"))


def cascade_tree(events: DataFrame, follows: DataFrame) -> DataFrame:
    """(cascade_id, user_id, post_id, ord, parent, depth, delay_seconds, timestamp_ms)."""
    rows = cascade_rows(events, follows)
    depth = closure(rows, "cascade_id", "user_id", "parent").withColumnsRenamed({"tree": "cascade_id", "node": "user_id"})
    before = rows.select("cascade_id", F.col("user_id").alias("parent"), F.col("timestamp_ms").alias("_before"))
    out = rows.join(depth, ["cascade_id", "user_id"]).join(before, ["cascade_id", "parent"], "left")
    wait = F.coalesce((F.col("timestamp_ms") - F.col("_before")) / 1000, F.lit(0.0))
    return out.withColumn("delay_seconds", F.round(F.greatest(F.lit(0.0), wait), 2)).drop("_before")


def structural_virality(rows: DataFrame) -> DataFrame:
    """(cascade_id, virality) of cascade_rows: mean distance of pairs, the sum over edges of s (n - s), s nodes below."""
    sized = closure(rows, "cascade_id", "user_id", "parent", with_size=True).withColumnRenamed("tree", "cascade_id")
    n = sized.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("size") * (F.col("n") - F.col("size"))
    edges = sized.join(n, "cascade_id").groupBy("cascade_id").agg(F.sum(pairs).alias("w"), F.max("n").alias("n"))
    mean = F.round(2 * F.col("w") / (F.col("n") * (F.col("n") - 1)), 4)
    return edges.select("cascade_id", F.when(F.col("n") > 1, mean).otherwise(0.0).alias("virality"))


def cascade_metrics(tree: DataFrame) -> DataFrame:
    """Per cascade: size, depth, breadth, branching, duration, half-life, speed an hour, depth to breadth."""
    base = tree.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("adoptions"), F.max("depth").alias("max_depth"), F.min("timestamp_ms").alias("_t0"), F.max("timestamp_ms").alias("_t1"))
    breadth = tree.groupBy("cascade_id", "depth").agg(F.count(F.lit(1)).alias("b")).groupBy("cascade_id").agg(F.max("b").alias("max_breadth"))
    branching = tree.filter("parent is not null").groupBy("cascade_id", "parent").agg(F.count(F.lit(1)).alias("c")).groupBy("cascade_id").agg(F.round(F.avg("c"), 3).alias("branching"))
    placed = numbered_within(tree.select("cascade_id", "timestamp_ms", "ord"), "cascade_id", "timestamp_ms", "ord", name="_k")
    halves = base.select("cascade_id", (F.greatest(F.lit(1), F.floor(F.col("adoptions") / 2)) - 1).alias("_half"))
    half = placed.join(halves, "cascade_id").filter("_k = _half").select("cascade_id", F.col("timestamp_ms").alias("_th"))
    out = base.join(breadth, "cascade_id").join(branching, "cascade_id", "left").join(half, "cascade_id")
    hours = F.greatest((F.col("_t1") - F.col("_t0")) / 3600000, F.lit(1 / 60))
    return out.select(
        "cascade_id", "adoptions", "max_depth", "max_breadth", F.coalesce("branching", F.lit(0.0)).alias("branching"), F.round((F.col("_t1") - F.col("_t0")) / 1000, 2).alias("duration_seconds"),
        F.round((F.col("_th") - F.col("_t0")) / 1000, 2).alias("half_life_seconds"), F.round(F.col("adoptions") / hours, 2).alias("per_hour"), F.round(F.col("max_depth") / F.greatest(F.lit(1), F.col("max_breadth")), 4).alias("depth_to_breadth"),
    )


def top_cascades(events: DataFrame, least: int = 2, limit: int = 10) -> DataFrame:
    return events.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("events")).filter(F.col("events") >= least).orderBy(F.desc("events"), "cascade_id").limit(limit)
