"""Ranks, communities and bridges on an edge table (source_id, target_id, weight).

Iterative algorithms are driver loops of joins and pre-aggregated sums; each round is written out (``cut``), so plans
stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import paths
from .ranks import numbered

# Relations by name.
RELATIONS = ("FOLLOWS", "RETWEETS", "REPLIES", "MENTIONS", "QUOTES")


def relation_type(c: Column) -> Column:
    """Trimmed and in capitals; null unless it is known or a plain name of at most 64 characters."""
    name = F.upper(F.trim(c))
    return F.when(name.isin(*RELATIONS) | F.trim(c).rlike("^[A-Za-z][A-Za-z0-9_]{0,63}$"), name)


def simple(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """One edge for each pair of nodes, the last by order (the time or number of its writing; without one, of several
    relations the last by name); weights of 0 or null count as 1."""
    at = F.struct(*([order.alias("o")] if order is not None else []), F.col("relation_type").alias("r"), F.col("weight").alias("w"))
    out = edges.groupBy("source_id", "target_id").agg(F.max(at)["w"].alias("weight"))
    return out.withColumn("weight", F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, in_centrality) on different pairs."""
    pairs = edges.select("source_id", "target_id").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("target_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    out = ends.groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    n = out.agg(F.count(F.lit(1)).alias("_n"))
    return out.join(F.broadcast(n)).select("node", "in_degree", "out_degree", F.when(F.col("_n") > 1, F.col("in_degree") / (F.col("_n") - 1)).otherwise(0.0).alias("in_centrality"))


def density(edges: DataFrame) -> DataFrame:
    pairs = edges.select("source_id", "target_id").distinct().agg(F.count(F.lit(1)).alias("edges"))
    n = nodes(edges).agg(F.count(F.lit(1)).alias("nodes"))
    return pairs.join(F.broadcast(n)).select("nodes", "edges", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0).alias("density"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: 2 for pairs that point both ways, else 1."""
    pairs = edges.filter("source_id != target_id").select("source_id", "target_id").distinct()
    return pairs.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, cut_every: int = 4) -> DataFrame:
    """(node, rank): weighted; rank of nodes without out-edges is dealt to all; ends when the sum of changes is below
    tolerance times the number of nodes."""
    e = simple(edges)
    out = e.groupBy("source_id").agg(F.sum("weight").alias("_out"))
    flow = cut(e.join(out, "source_id").select("source_id", "target_id", (F.col("weight") / F.col("_out")).alias("share")))
    every = cut(nodes(edges).join(out.select(F.col("source_id").alias("node"), F.lit(True).alias("_flows")), "node", "left").select("node", F.coalesce("_flows", F.lit(False)).alias("flows")))
    n = every.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("rank"))
    rank = every.select("node", "flows", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        moved = rank.join(flow, rank["node"] == flow["source_id"]).groupBy("target_id").agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
        stuck = rank.agg(F.sum(F.when(~F.col("flows"), F.col("rank")).otherwise(0.0)).alias("_stuck"))
        nxt = rank.join(moved, rank["node"] == moved["target_id"], "left").join(F.broadcast(stuck)).select("node", "flows", F.col("rank").alias("_old"), ((1 - damping) / n + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_stuck") / n)).alias("rank"))
        if (i + 1) % cut_every and i + 1 < rounds:
            rank = nxt.select("node", "flows", "rank")
            continue
        nxt = cut(nxt)
        rank = nxt.select("node", "flows", "rank")
        if tolerance and nxt.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] < tolerance * n:
            break
    return rank.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each weakly connected component."""
    both = cut(edges.select("source_id", "target_id").union(edges.select("target_id", "source_id")).toDF("node", "_next").distinct())
    label = cut(both.groupBy("node").agg(F.min("_next").alias("_m")).select("node", F.least("node", "_m").alias("component")))
    while True:
        around = both.join(label.select(F.col("node").alias("_next"), "component"), "_next").groupBy("node").agg(F.min("component").alias("_m"))
        near = label.join(around, "node", "left").select("node", F.col("component").alias("_old"), F.least("component", "_m").alias("component"))
        jump = near.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        step = cut(near.join(jump, "component", "left").select("node", "_old", F.coalesce("_far", "component").alias("component")))
        label = step.select("node", "component")
        if step.filter("_old != component").isEmpty():
            return label


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): each round every node takes the label of most weight around it and its own; ties: the smallest."""
    u = undirected(edges)
    both = cut(u.select(F.col("a").alias("node"), F.col("b").alias("next"), "weight").union(u.select("b", "a", "weight")))
    label = both.select("node").distinct().select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("node").alias("next"), "community"), "next").select("node", "community", "weight")
        votes = votes.union(label.select("node", "community", F.lit(0.5))).groupBy("node", "community").agg(F.sum("weight").alias("w"))
        new = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community"))
        step = cut(new.join(label.withColumnRenamed("community", "_old"), "node"))
        label = step.select("node", "community")
        if step.filter("_old != community").isEmpty():
            break
    return label


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: Q of a partition (node, community) on undirected weights; null for one community or no edges."""
    u = undirected(edges)
    p = partition.select(F.col("node"), F.col("community"))
    deg = u.select(F.explode(F.array("a", "b")).alias("node"), "weight").join(p, "node").groupBy("community").agg(F.sum("weight").alias("d"))
    inner = u.join(p.toDF("a", "_ca"), "a").join(p.toDF("b", "_cb"), "b").filter("_ca = _cb").groupBy(F.col("_ca").alias("community")).agg(F.sum("weight").alias("l"))
    m = u.agg(F.sum("weight").alias("m"))
    q = deg.join(inner, "community", "left").join(F.broadcast(m)).agg(F.count(F.lit(1)).alias("communities"), F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))
    return q.select("communities", F.when(F.col("communities") > 1, F.round("q", 4)).alias("modularity"))


def _half_sweep(state: DataFrame, near: DataFrame, way: int, resolution: float, total: float) -> DataFrame:
    """(x, k, loops, c) after the moves of a half sweep: nodes whose best community is a smaller one go in even ones, those
    whose best is a larger one in odd ones. With what each node had given to modularity before it: _inner, the weight within
    its community, and _square, its degree times its community's."""
    size = state.groupBy("c").agg(F.sum("k").alias("s"))
    sized = state.join(size, "c").select("x", "k", "loops", "c", "s")
    own = sized.toDF("x", "k", "loops", "own", "_own")
    told = near.join(sized.select(F.col("x").alias("y"), "c", "s"), "y").select("x", "c", "s", "weight").repartition("x")  # what follows stays where it is
    home, side = F.col("c") == F.col("own"), F.col("c") < F.col("own") if way % 2 == 0 else F.col("c") > F.col("own")
    gain = F.col("w") - resolution * F.col("k") * (F.col("s") - F.when(home, F.col("k")).otherwise(0.0)) / total
    by = told.groupBy("x", "c").agg(F.sum("weight").alias("w"), F.max("s").alias("s")).join(own, "x")
    options = by.groupBy("x").agg(F.max(F.when(home, F.col("w"))).alias("w0"), F.max(F.when(~home, F.struct(F.round(gain, 9).alias("gain"), F.col("c"), side.alias("now")))).alias("b"))
    within = F.coalesce("w0", F.lit(0.0))
    stay = within - resolution * F.col("k") * (F.col("_own") - F.col("k")) / total
    moves = F.when(F.col("b.now") & (F.col("b.gain") > stay + 1e-9), F.col("b.c")).otherwise(F.col("own"))
    return cut(own.join(options, "x", "left").select("x", "k", "loops", moves.alias("c"), (within + F.col("loops")).alias("_inner"), (F.col("k") * F.col("_own")).alias("_square")))


def _moved(pairs: DataFrame, resolution: float, total: float, tolerance: float) -> tuple[DataFrame, bool]:
    """(x, c): communities of nodes after moves until a sweep raises modularity by no more than tolerance. What a sweep
    has come to is known from the half sweep after it, which goes over the same weights."""
    loops = F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0))
    state = cut(pairs.groupBy("x").agg(F.sum("weight").alias("k"), loops.alias("loops")).withColumn("c", F.col("x")))
    near = pairs.filter("x != y").repartition("y").persist()
    start, value, changed, way = state, None, False, 0
    while True:
        step = _half_sweep(state, near, way, resolution, total)
        if way % 2 == 0:
            found = step.agg(F.sum("_inner").alias("w"), F.sum("_square").alias("q")).first()
            now = found["w"] / total - resolution * found["q"] / total**2
            if value is not None and now <= value + tolerance:
                near.unpersist()
                return (state if now > value else start), changed or now > value
            start, value, changed = state, now, value is not None
        state, way = step.select("x", "k", "loops", "c"), way + 1


def louvain(edges: DataFrame, resolution: float = 1.0, tolerance: float = 1e-4) -> DataFrame:
    """(node, community) by greedy modularity: nodes move to the neighbouring community of most gain, then communities
    become nodes, until a level gains no more than tolerance. One way of working at every size.

    Moves of a half sweep happen together, only towards smaller community names and then only towards larger ones, so
    that two nodes never just swap; a node whose best community lies the other way waits for its half. A sweep that lowers modularity is not kept. Gains and ties are deterministic.
    """
    u = undirected(edges)
    pairs = cut(u.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").union(u.select("b", "a", "weight")))
    total = pairs.agg(F.sum("weight")).first()[0] or 0.0  # twice the sum of weights
    member = pairs.select(F.col("x").alias("node")).distinct().select("node", F.col("node").alias("community"))
    while total:
        state, changed = _moved(pairs, resolution, total, tolerance)
        if not changed:
            break
        where = state.select(F.col("x").alias("community"), F.col("c").alias("_to"))
        member = cut(member.join(where, "community").select("node", F.col("_to").alias("community")))
        left, right = state.select("x", F.col("c").alias("cx")), state.select(F.col("x").alias("y"), F.col("c").alias("cy"))
        pairs = cut(pairs.join(left, "x").join(right, "y").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("weight").alias("weight")))
    return member


def cluster_ids(partition: DataFrame, least: int = 1) -> DataFrame:
    """(node, community) with communities numbered by size, then smallest member; those under ``least`` are -1."""
    sizes = partition.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    large = numbered(sizes.filter(F.col("n") >= least), F.desc("n"), "first", name="_id").select("community", "_id")
    named = sizes.select("community").join(large, "community", "left").select("community", F.coalesce("_id", F.lit(-1)).alias("_id"))
    return partition.join(named, "community").select("node", F.col("_id").alias("community"))


def community_stats(edges: DataFrame, partition: DataFrame, top: int = 5) -> DataFrame:
    """Per community: members, inner directed edges, density and its members of most in-degree."""
    pairs = edges.select("source_id", "target_id").distinct()
    inner = pairs.join(partition.toDF("source_id", "c1"), "source_id").join(partition.toDF("target_id", "c2"), "target_id").filter("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count(F.lit(1)).alias("inner_edges"))
    best = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("in_degree"), "node"))
    tops = partition.join(degrees(edges), "node").withColumn("_r", best).filter(F.col("_r") <= top).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "node"))), lambda x: x["node"]), ",").alias("top"))
    out = partition.groupBy("community").agg(F.count(F.lit(1)).alias("members")).join(inner, "community", "left").join(tops, "community", "left")
    edges_in = F.coalesce("inner_edges", F.lit(0))
    return out.filter("community != -1").select("community", "members", edges_in.alias("inner_edges"), F.when(F.col("members") > 1, F.round(edges_in / (F.col("members") * (F.col("members") - 1)), 4)).otherwise(0.0).alias("density"), "top")


def pivots(all_nodes: DataFrame, k: int = 500) -> DataFrame:
    """At most k nodes, those of the smallest hashes."""
    return all_nodes.orderBy(F.xxhash64("node"), "node").limit(k)


def betweenness(edges: DataFrame, k: int = 500, directed: bool = True) -> DataFrame:
    """(node, betweenness), normalised; from at most k pivots, scaled up; weights are distances.

    All pivots are worked on together over blocks of nodes (``paths``), one way at every size; rounds are as many as the
    edges of the longest shortest path, twice over.
    """
    e = simple(edges)
    if not directed:
        back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight")
        e = e.unionByName(back).groupBy("source_id", "target_id").agg(F.min("weight").alias("weight"))
    e, every = cut(e), cut(nodes(edges))
    n, chosen = every.count(), cut(pivots(every, k))
    parts = paths.shares(e, every, chosen)
    scale = 1.0 / ((n - 1) * (n - 2)) * n / max(1, min(n, k)) if n > 2 else 0.0
    sums = parts.groupBy("node").agg(F.sum("d").alias("d"))
    return every.join(sums, "node", "left").select("node", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def log_scaled(rows: DataFrame, c: str) -> DataFrame:
    """rows with column c after ln(1 + x), stretched to 0 .. 1 over all rows; a flat range becomes 1 / rows."""
    x = F.log1p(F.greatest(F.lit(0.0), F.col(c)))
    span = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    return rows.join(F.broadcast(span)).withColumn(c, F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1 / F.col("_n"))).drop("_lo", "_hi", "_n")


def rank_leaders(ranks: DataFrame, degree: DataFrame, between: DataFrame, top: int = 20, least_in: int = 0, weights: tuple[float, float, float] = (0.50, 0.35, 0.15)) -> DataFrame:
    """Influence from scaled rank, in-degree and betweenness; ordered by score, in-degree, rank, node."""
    raw = degree.join(ranks, "node").join(between, "node")
    cols = ("rank", "in_centrality", "betweenness")
    scaled = raw.select("node", *[F.col(c).alias(f"_{c}") for c in cols])
    for c in cols:
        scaled = log_scaled(scaled, f"_{c}")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((w * F.col(f"_{c}") for w, c in zip(weights, cols, strict=True)), F.lit(0.0))))
    out = raw.join(scaled, "node").filter(F.col("in_degree") >= least_in).select("node", F.round("rank", 6).alias("pagerank"), "in_degree", "out_degree", F.round("betweenness", 6).alias("betweenness"), F.round(score, 4).alias("influence"))
    best = out.orderBy(F.desc("influence"), F.desc("in_degree"), F.desc("pagerank"), "node").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("influence"), F.desc("in_degree"), F.desc("pagerank"), "node")))


def bridges(edges: DataFrame, partition: DataFrame, between: DataFrame | None = None, top: int = 20, least_neighbours: int = 1, least_ratio: float = 0.0, weights: tuple[float, float, float] = (0.60, 0.25, 0.15)) -> DataFrame:
    """Nodes whose neighbours are in other communities (null and negative ones never count), by a composite score."""
    e = edges.filter("source_id != target_id").select("source_id", "target_id")
    pairs = e.union(e.select("target_id", "source_id")).toDF("node", "next").distinct()
    valid = partition.filter("community >= 0")
    c = valid.toDF("node", "own"), valid.toDF("next", "other")
    rows = pairs.join(c[0], "node", "left").join(c[1], "next", "left").withColumn("foreign", F.col("own").isNotNull() & F.col("other").isNotNull() & (F.col("own") != F.col("other")))
    by = rows.groupBy("node").agg(F.count(F.lit(1)).alias("neighbours"), F.count(F.when(F.col("foreign"), 1)).alias("foreign_neighbours"), F.size(F.collect_set(F.when(F.col("foreign"), F.col("other")))).alias("reached"), F.max("own").alias("community"))
    by = by.withColumn("ratio", F.round(F.col("foreign_neighbours") / F.col("neighbours"), 4)).filter((F.col("neighbours") >= least_neighbours) & (F.col("foreign_neighbours") > 0) & (F.col("ratio") >= least_ratio))
    number = valid.agg(F.countDistinct("community").alias("_k"))
    if between is None:
        between = pairs.select("node").distinct().withColumn("betweenness", F.lit(0.0))
    most = between.agg(F.max("betweenness").alias("_most"))
    rows = by.join(between, "node", "left").join(F.broadcast(number)).join(F.broadcast(most))
    norm = F.when(F.col("_most") > 1e-9, F.coalesce("betweenness", F.lit(0.0)) / F.col("_most")).otherwise(0.0)
    spread = F.least(F.lit(1.0), F.when(F.col("_k") > 1, F.col("reached") / (F.col("_k") - 1)).otherwise(F.col("reached") / 3))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weights[0] * F.col("ratio") + weights[1] * norm + weights[2] * spread)), 4)
    out = rows.select("node", "community", "ratio", "neighbours", "foreign_neighbours", "reached", F.round(F.coalesce("betweenness", F.lit(0.0)), 6).alias("betweenness"), score.alias("score"))
    order = (F.desc("score"), F.desc("ratio"), F.desc("betweenness"), "node")
    return out.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def ego(edges: DataFrame, centre: str, radius: int = 1, most: int = 100) -> DataFrame:
    """(node, hop) within radius steps either way; at most ``most``, nearer ones first, then by name."""
    e = edges.select("source_id", "target_id").union(edges.select("target_id", "source_id")).toDF("node", "_next").distinct()
    seen = e.filter(F.col("node") == centre).select("node").distinct().withColumn("hop", F.lit(0))
    level = seen
    for hop in range(1, radius + 1):
        level = cut(level.join(e, "node").select(F.col("_next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(level)
    return seen.orderBy("hop", "node").limit(most)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges between nodes of keep (node)."""
    k = keep.select("node")
    return edges.join(k.withColumnRenamed("node", "source_id"), "source_id", "left_semi").join(k.withColumnRenamed("node", "target_id"), "target_id", "left_semi")


def spearman(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """One row: rank correlation of two columns by ordinal ranks (ties by key); 1 for fewer than two rows.

    Ranks are places within ranges of values plus counts of the ranges before (``numbered``).
    """
    ra, rb = (numbered(rows.select(key, c), F.desc(c), key, name=n).select(key, n) for c, n in ((a, "_a"), (b, "_b")))
    ranked = ra.join(rb, key)
    n, d = F.count(F.lit(1)), F.sum(F.pow(F.col("_a") - F.col("_b"), 2))
    return ranked.agg(F.when(n < 2, 1.0).otherwise(F.round(1 - 6 * d / (n * (n * n - 1)), 4)).alias("rho"))
