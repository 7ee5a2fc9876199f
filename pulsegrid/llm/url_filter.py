"""URL judgements: fixed rules first, then trust and distrust that spread over the link graph of hosts.

The graph has an edge between two hosts where a page of one links to the other by an absolute link, weighted by the
number of such links. Trust is a personalised PageRank from hosts whose pages are allowed by rules, along the links;
distrust is one from hosts with blocked pages, against them: who links to bad hosts is suspect. A host without a
rule is blocked if its distrust is over ``floor`` and more than ``ratio`` times its trust, else allowed.

All of it is DataFrame work on edges (one row per pair of hosts) and ranks (one row per host); each round of the
iteration is one join and one pre-aggregated sum, and lineage is cut by checkpoint() every few rounds.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged as host ''
(never in the graph, so allowed); null html has no links; repeated pages count again; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir

# Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING, ROUNDS, CHECKPOINT_EVERY = 0.85, 20, 5
RATIO, FLOOR = 1.0, 1e-12
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(https?://[^"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null where none does; of several the longest, then the first by text."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules if rules is not None else RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = pages.select(host_of(F.coalesce(F.col(url_col), F.lit(""))).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("url"))
    return links.select("src", host_of(F.col("url")).alias("dst")).filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): edges (src, dst, links), seeds (host, weight). Rank that reaches a host without links returns to the seeds."""
    spark = edges.sparkSession
    shared_dir(spark)
    total = seeds.agg(F.sum("weight").alias("_all"))
    start = seeds.join(F.broadcast(total)).select("host", (F.col("weight") / F.col("_all")).alias("seed")).checkpoint()
    out = edges.groupBy("src").agg(F.sum("links").alias("_out"))
    flow = edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("_out")).alias("share")).checkpoint()
    sources = out.select(F.col("src").alias("host"), F.lit(True).alias("_flows"))
    rank = start.select("host", F.col("seed").alias("rank"))
    if flow.isEmpty():  # nothing spreads
        return rank
    for i in range(rounds):
        moved = rank.join(flow, rank["host"] == flow["src"]).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        stuck = rank.join(sources, "host", "left").agg(F.sum(F.when(F.col("_flows").isNull(), F.col("rank")).otherwise(0.0)).alias("_stuck"))
        back = start.join(F.broadcast(stuck)).select("host", (F.col("seed") * (1 - damping + damping * F.coalesce("_stuck", F.lit(0.0)))).alias("rank"))
        rank = moved.union(back).groupBy("host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % CHECKPOINT_EVERY == 0:
            rank = rank.checkpoint()
    return rank


def filter_urls(pages: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, floor: float = FLOOR) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust and distrust of the host."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict})
    seeds = rows.filter("_verdict is not null and host != ''").groupBy("host", "_verdict").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    shared_dir(pages.sparkSession)
    edges = host_edges(pages, url_col, html_col).checkpoint()
    trust = personalised_pagerank(edges, seeds.filter("_verdict = 'allow'").select("host", "weight"))
    distrust = personalised_pagerank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"), seeds.filter("_verdict = 'block'").select("host", "weight"))
    hosts = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "rank"))
    hosts = hosts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    zero = F.lit(0.0)
    hosts = hosts.withColumnRenamed("host", "_ranked").select(F.concat("_ranked", F.lit("")).alias("_key"), "trust", "distrust")  # a key of its own: a large host can be split
    out = rows.join(hosts, F.col("host") == F.col("_key"), "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    method = F.when((F.col("distrust") > floor) & (F.col("distrust") > ratio * F.col("trust")), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "trust", "distrust")
