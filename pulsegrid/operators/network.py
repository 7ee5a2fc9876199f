"""A graph as a table with versions, and its overview: topology, communities, leaders and cascades in one call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import graph, tables, trees


def named(ranked: DataFrame, users: DataFrame, node: str = "node") -> DataFrame:
    """ranked (a short list) with the screen names of its nodes: the table of users is cut to them first."""
    ids = ranked.select(F.col(node).alias("id"))
    names = users.join(F.broadcast(ids), "id", "left_semi").select(F.col("id").alias(node), "screen_name")
    return ranked.join(names, node, "left")


def topology(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, is_connected; an empty graph has zeros and is not connected."""
    size = graph.density(edges)
    parts = graph.components(edges).agg(F.countDistinct("component").alias("components"))  # one row
    return size.join(F.broadcast(parts)).select("nodes", "edges", "density", "components", (F.col("components") == 1).alias("is_connected"))


def assignments(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(user_id, community_id, modularity_score) as they are stored."""
    score = graph.modularity(edges, partition).select(F.coalesce("modularity", F.lit(0.0)).alias("modularity_score"))
    return partition.select(F.col("node").alias("user_id"), F.col("community").cast("int").alias("community_id")).join(F.broadcast(score))


def persisted(old: DataFrame, edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The stored communities with those of a partition put in."""
    return tables.upsert(old, assignments(edges, partition).select(*old.columns), tables.KEYS["user_communities"])


@dataclass
class Network:
    """Edges (source_id, target_id, relation_type, weight) with a revision that each change raises.

    The overview is kept until the revision changes."""

    edges: DataFrame
    revision: int = 0
    _kept: dict = field(default_factory=dict)

    def add(self, edges: DataFrame) -> Network:
        """A network with edges put in: of the same nodes and relation the new one counts."""
        return Network(tables.upsert(self.edges, edges.select(*self.edges.columns), tables.KEYS["graph_edges"]), self.revision + 1)

    def cleared(self) -> Network:
        return Network(self.edges.limit(0), self.revision + 1)

    def has(self, source: str, target: str) -> bool:
        return not self.edges.filter((F.col("source_id") == source) & (F.col("target_id") == target)).isEmpty()

    def counts(self) -> DataFrame:
        """One row: nodes and edges, parallel relations as one."""
        return graph.density(self.edges).select("nodes", "edges")

    def overview(
        self, users: DataFrame | None = None, events: DataFrame | None = None, least: int = 2, leaders: int = 20, cascades: int = 5,
        least_cascade: int = 3,
    ) -> dict[str, DataFrame]:
        """Tables topology, partition, communities, leaders and cascades (those of at least least_cascade events)."""
        key = (self.revision, users is None, events is None, least, leaders, cascades, least_cascade)
        if key in self._kept:
            return self._kept[key]
        partition = cut(graph.cluster_ids(graph.louvain(self.edges), least))
        ranked = graph.rank_leaders(graph.pagerank(self.edges), graph.degrees(self.edges), graph.betweenness(self.edges), leaders)
        ranked = ranked.join(partition, "node", "left")
        out = {"topology": topology(self.edges), "partition": partition, "communities": graph.community_stats(self.edges, partition)}
        out["leaders"] = named(ranked, users) if users is not None else ranked
        if events is not None:
            top = trees.top_cascades(events, least_cascade, cascades).select("cascade_id")
            out["cascades"] = trees.cascade_metrics(trees.cascade_tree(events.join(F.broadcast(top), "cascade_id", "left_semi"), self.edges))
        self._kept = {key: out}
        return out
