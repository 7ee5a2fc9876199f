"""Queries over the graph as a table: changes, overview, leaders, stored communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, network, tables
from ..session import table
from ..sources.views import load
from .registry import query

_G = ("graph_edges",)
_N = "nodes AS (SELECT source_id AS node FROM graph_edges UNION SELECT target_id FROM graph_edges)"


def _edges(s, d) -> DataFrame:
    return load(s, d, "graph_edges")


def _part(e: DataFrame) -> DataFrame:
    return graph.nodes(e).withColumn("community", F.substring("node", 2, 20).cast("bigint") % 5 - 1)


_PART = "part AS (SELECT node, CAST(substr(node, 2) AS BIGINT) % 5 - 1 AS community FROM nodes)"
_RELATIONS = """many AS (SELECT source_id, target_id, r AS relation_type, CASE r WHEN 'FOLLOWS' THEN 0.0 WHEN 'MENTIONS' THEN 2.5 END AS weight, CASE r WHEN 'FOLLOWS' THEN 3 WHEN 'MENTIONS' THEN h % 5 ELSE 1 END AS written
 FROM (SELECT *, CAST(substr(source_id, 2) AS BIGINT) AS h FROM graph_edges), (SELECT unnest(['FOLLOWS', 'MENTIONS', 'QUOTES']) AS r) WHERE r <> 'QUOTES' OR h % 3 = 0)"""


def _many(s, d) -> DataFrame:
    e = _edges(s, d).select("source_id", "target_id", F.substring("source_id", 2, 20).cast("bigint").alias("h"))
    r = F.explode(F.array(*map(F.lit, ("FOLLOWS", "MENTIONS", "QUOTES")))).alias("relation_type")
    rows = e.select("*", r).filter("relation_type != 'QUOTES' or h % 3 = 0")
    weight = F.when(F.col("relation_type") == "FOLLOWS", 0.0).when(F.col("relation_type") == "MENTIONS", 2.5)
    at = F.when(F.col("relation_type") == "FOLLOWS", 3).when(F.col("relation_type") == "MENTIONS", F.col("h") % 5).otherwise(1)
    return rows.select("source_id", "target_id", "relation_type", weight.alias("weight"), at.alias("at"))


@query("collapsed_relations", f"WITH {_RELATIONS}, last AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY written DESC, relation_type DESC) AS k FROM many) SELECT source_id, target_id, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END::DOUBLE AS weight FROM last WHERE k = 1", _G)
def _(s, d):
    return graph.simple(_many(s, d), F.col("at"))


def _changed(s, d) -> network.Network:
    e = _edges(s, d)
    new = e.filter("cast(substring(source_id, 2, 20) as bigint) % 10 = 0").select("source_id", F.lit("u_new").alias("target_id"), F.lit("FOLLOWS").alias("relation_type"), F.lit(2.0).alias("weight")).distinct()
    return network.Network(e).add(new)


@query("graph_changes", f"WITH more AS (SELECT source_id, target_id FROM graph_edges UNION SELECT source_id, 'u_new' FROM graph_edges WHERE CAST(substr(source_id, 2) AS BIGINT) % 10 = 0), n AS (SELECT source_id AS x FROM more UNION SELECT target_id FROM more) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM more) AS edges", _G)
def _(s, d):
    return _changed(s, d).counts()


@query("graph_topology", f"""WITH RECURSIVE {_N}, b AS (SELECT source_id AS x, target_id AS y FROM graph_edges UNION SELECT target_id, source_id FROM graph_edges),
 r AS (SELECT node AS first, node FROM nodes UNION SELECT r.first, b.y FROM r JOIN b ON b.x = r.node), p AS (SELECT node, min(first) AS part FROM r GROUP BY node), k AS (SELECT count(DISTINCT part) AS k FROM p)
 SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM graph_edges) AS edges, round((SELECT count(*) FROM graph_edges) * 1.0 / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS density, k AS components, k = 1 AS is_connected FROM k""", _G)
def _(s, d):
    return network.topology(_edges(s, d))


@query("induced_subgraph", "SELECT source_id, target_id FROM graph_edges WHERE CAST(substr(source_id, 2) AS BIGINT) % 2 = 0 AND CAST(substr(target_id, 2) AS BIGINT) % 2 = 0", _G)
def _(s, d):
    e = _edges(s, d)
    keep = graph.nodes(e).filter("cast(substring(node, 2, 20) as bigint) % 2 = 0")
    return graph.induced(e, keep).select("source_id", "target_id")


@query("log_scaled", f"WITH {_N}, i AS (SELECT target_id AS node, count(*) AS c FROM graph_edges GROUP BY 1), x AS (SELECT node, ln(1 + coalesce(c, 0)) AS l FROM nodes LEFT JOIN i USING (node)) SELECT node, round((l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()), 6) AS scaled FROM x", _G)
def _(s, d):
    return graph.log_scaled(graph.degrees(_edges(s, d)), "in_degree").select("node", F.round("in_degree", 6).alias("scaled"))


# --- label propagation, unrolled -----------------------------------------------------------------------------------

_ROUNDS = 5


def _propagated() -> str:
    u = "u AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*)::DOUBLE AS weight FROM (SELECT DISTINCT source_id, target_id FROM graph_edges WHERE source_id <> target_id) GROUP BY ALL)"
    out = [f"WITH {u}", "e AS (SELECT a AS node, b AS nx, weight FROM u UNION ALL SELECT b, a, weight FROM u)", "l0 AS (SELECT DISTINCT node, node AS c FROM e)"]
    for i in range(_ROUNDS):
        votes = f"SELECT e.node, l.c, weight AS w FROM e JOIN l{i} l ON l.node = e.nx UNION ALL SELECT node, c, 0.5 FROM l{i}"
        ranked = f"SELECT node, c, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, c) AS k FROM ({votes}) GROUP BY node, c"
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT node, c FROM ({ranked}) WHERE k = 1)")
    return ", ".join(out) + f" SELECT node, c AS community FROM l{_ROUNDS}"


@query("label_propagation_rounds", _propagated(), _G)
def _(s, d):
    return graph.label_propagation(_edges(s, d), _ROUNDS)


# --- betweenness of all sources by shortest paths in SQL, and what is ranked by it -----------------------------------



def _between(edges: str) -> str:
    """SQL of bt (node, b): exact betweenness over simple edges (u, v), by distances of at most five edges, beyond the
    diameter here, and numbers of shortest paths."""
    return f"""se AS MATERIALIZED ({edges}), sn AS (SELECT u AS node FROM se UNION SELECT v FROM se),
 reach AS (SELECT node AS s, node AS v, 0 AS d FROM sn UNION SELECT r.s, e.v, r.d + 1 FROM reach r JOIN se e ON e.u = r.v WHERE r.d < 5),
 far AS MATERIALIZED (SELECT s, v, min(d) AS d FROM reach GROUP BY ALL),
 ways AS (SELECT node AS s, node AS v, 0 AS d, 1.0::DOUBLE AS p FROM sn UNION ALL SELECT w.s, e.v, w.d + 1, sum(w.p) FROM ways w JOIN se e ON e.u = w.v JOIN far f ON f.s = w.s AND f.v = e.v AND f.d = w.d + 1 GROUP BY w.s, e.v, w.d + 1),
 mid AS (SELECT x.v AS node, sum(x.p * y.p / z.p) AS b FROM ways x JOIN ways y ON y.s = x.v AND y.d > 0 JOIN ways z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 GROUP BY x.v),
 bt AS (SELECT sn.node, coalesce(b, 0) / ((c.n - 1) * (c.n - 2)) AS b FROM sn LEFT JOIN mid USING (node), (SELECT count(*) AS n FROM sn) c)"""


_ONE_WAY = "SELECT DISTINCT source_id AS u, target_id AS v FROM graph_edges WHERE source_id <> target_id"
_BOTH_WAYS = "SELECT source_id AS u, target_id AS v FROM graph_edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM graph_edges WHERE source_id <> target_id"
_EVERY = (1 << 31) - 1


@query("betweenness_exact", f"WITH RECURSIVE {_between(_BOTH_WAYS)} SELECT node, round(b, 6) AS betweenness FROM bt", _G)
def _(s, d):
    """Of the whole graph without directions, every node a pivot."""
    return graph.betweenness(_edges(s, d), _EVERY, directed=False).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("bridge_ranking", f"""WITH RECURSIVE {_between(_ONE_WAY)}, {_N}, {_PART}, p AS (SELECT source_id AS node, target_id AS nx FROM graph_edges UNION SELECT target_id, source_id FROM graph_edges), k AS (SELECT count(DISTINCT community) AS k FROM part WHERE community >= 0),
 x AS (SELECT p.node, CASE WHEN a.community >= 0 THEN a.community END AS own, CASE WHEN b.community >= 0 THEN b.community END AS oth FROM p JOIN part a ON a.node = p.node JOIN part b ON b.node = p.nx),
 y AS (SELECT node, any_value(own) AS community, count(*) AS neighbours, count(*) FILTER (own <> oth) AS foreign_neighbours, count(DISTINCT oth) FILTER (own <> oth) AS reached FROM x GROUP BY node), z AS (SELECT *, round(foreign_neighbours * 1.0 / neighbours, 4) AS ratio FROM y WHERE foreign_neighbours > 0),
 w AS (SELECT z.*, round(b, 6) AS betweenness, round(0.6 * ratio + 0.25 * b / (SELECT max(b) FROM bt) + 0.15 * least(1.0, reached * 1.0 / (k - 1)), 4) AS score FROM z JOIN bt USING (node), k)
 SELECT node, community, ratio, neighbours, foreign_neighbours, CAST(reached AS INT) AS reached, betweenness, score, CAST(row_number() OVER (ORDER BY score DESC, ratio DESC, betweenness DESC, node) AS INT) AS place FROM w ORDER BY place LIMIT 20""", _G)
def _(s, d):
    """The top 20 bridges by their real betweenness, every node a pivot."""
    e = _edges(s, d)
    return graph.bridges(e, _part(e), graph.betweenness(e, _EVERY))


def _ranked(s, d) -> DataFrame:
    """Leaders with ranks that are given, so that only the composite is compared."""
    e = _edges(s, d)
    k = F.substring("node", 2, 20).cast("bigint")
    nodes = graph.nodes(e)
    ranks = nodes.select("node", ((k * 37) % 101 / 1000.0).cast("double").alias("rank"))
    between = nodes.select("node", ((k * 53) % 97 / 1000.0).cast("double").alias("betweenness"))
    return graph.rank_leaders(ranks, graph.degrees(e), between, least_in=1)


_LEADERS = f"""{_N}, i AS (SELECT target_id AS node, count(*) AS c FROM graph_edges GROUP BY 1), o AS (SELECT source_id AS node, count(*) AS c FROM graph_edges GROUP BY 1),
 m AS (SELECT node, CAST(substr(node, 2) AS BIGINT) AS k, coalesce(i.c, 0) AS ind, coalesce(o.c, 0) AS outd, (SELECT count(*) FROM nodes) AS n FROM nodes LEFT JOIN i USING (node) LEFT JOIN o USING (node)),
 x AS (SELECT node, (k * 37) % 101 / 1000.0 AS r, (k * 53) % 97 / 1000.0 AS b, ind, outd, ln(1 + (k * 37) % 101 / 1000.0) AS lr, ln(1 + ind * 1.0 / (n - 1)) AS li, ln(1 + (k * 53) % 97 / 1000.0) AS lb FROM m),
 z AS (SELECT *, 0.5 * (lr - min(lr) OVER ()) / (max(lr) OVER () - min(lr) OVER ()) + 0.35 * (li - min(li) OVER ()) / (max(li) OVER () - min(li) OVER ()) + 0.15 * (lb - min(lb) OVER ()) / (max(lb) OVER () - min(lb) OVER ()) AS v FROM x),
 lead AS (SELECT node, round(r, 6)::DOUBLE AS pagerank, ind AS in_degree, outd AS out_degree, round(b, 6)::DOUBLE AS betweenness, round(v, 4) AS influence FROM z WHERE ind >= 1),
 led AS (SELECT *, CAST(row_number() OVER (ORDER BY influence DESC, in_degree DESC, pagerank DESC, node) AS INT) AS place FROM lead ORDER BY place LIMIT 20)"""


@query("leader_composite", f"WITH {_LEADERS} SELECT * FROM led", _G)
def _(s, d):
    return _ranked(s, d)


@query("leader_names", f"WITH {_LEADERS} SELECT place, node, screen_name FROM led LEFT JOIN users ON id = node", ("graph_edges", "users"))
def _(s, d):
    return network.named(_ranked(s, d), load(s, d, "users")).select("place", "node", "screen_name")


# --- stored communities, overview ----------------------------------------------------------------------------------


@query("persisted_communities", f"WITH {_N}, {_PART} SELECT user_id, CAST(community_id AS INT) AS community_id FROM (SELECT node AS user_id, community AS community_id FROM part UNION ALL SELECT 'gone_' || r_regionkey, 9 FROM region)", _G)
def _(s, d):
    e = _edges(s, d)
    gone = table(s, d, "region").select(F.concat(F.lit("gone_"), F.col("r_regionkey").cast("string")).alias("user_id"), F.lit(9).alias("community_id"), F.lit(0.0).alias("modularity_score"))
    stale = graph.nodes(e).limit(20).select(F.col("node").alias("user_id"), F.lit(99).alias("community_id"), F.lit(0.0).alias("modularity_score"))
    return network.persisted(gone.union(stale), e, _part(e)).select("user_id", "community_id")


@query("communities_in_order", f"WITH {_N}, {_PART} SELECT node AS user_id, CAST(community AS INT) AS community_id FROM part ORDER BY 2, 1", _G)
def _(s, d):
    from ..operators import records

    e = _edges(s, d)
    rows = _part(e).select(F.col("node").alias("user_id"), F.col("community").cast("int").alias("community_id"))
    return records.by_community(rows)


@query("network_overview", f"""WITH {_N}, top AS (SELECT cascade_id, count(*) AS events FROM cascade_events GROUP BY 1 HAVING count(*) >= 3 ORDER BY events DESC, cascade_id LIMIT 5)
 SELECT 'nodes' AS part, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'edges', count(*) FROM graph_edges UNION ALL SELECT 'leaders', least(20, count(*)) FROM nodes UNION ALL SELECT 'partition', count(*) FROM nodes
 UNION ALL SELECT cascade_id, count(DISTINCT user_id) FROM cascade_events JOIN top USING (cascade_id) GROUP BY 1""", ("graph_edges", "cascade_events"))
def _(s, d):
    """Counts of the overview's tables, and the adoptions of each of its cascades."""
    parts = network.Network(_edges(s, d)).overview(load(s, d, "users"), load(s, d, "cascade_events"))
    size = parts["topology"].select(F.explode(F.array(F.struct(F.lit("nodes").alias("part"), F.col("nodes").alias("n")), F.struct(F.lit("edges").alias("part"), F.col("edges").alias("n")))).alias("x")).select("x.*")
    more = tables.counts({k: parts[k] for k in ("leaders", "partition")}).toDF("part", "n")
    return size.union(more).union(parts["cascades"].select("cascade_id", "adoptions"))


@query("graph_load", "SELECT source_id, target_id, relation_type, weight::DOUBLE AS weight FROM graph_edges", _G)
def _(s, d):
    """All edges as an empty network holds them once they are put in."""
    e = _edges(s, d)
    return network.Network(e.limit(0)).add(e).edges.select("source_id", "target_id", "relation_type", "weight")
