"""Queries that run a stream over a whole table to its end and read what it gave."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import as_text
from ..session import table
from ..sources.shared import shared_path
from ..streaming import alerts, bursts
from .registry import query


def _events(s: SparkSession, d: str) -> DataFrame:
    """The table of events as a stream. The pattern also fits a table that is one file."""
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _tagged(events: DataFrame) -> DataFrame:
    tag = F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("").alias("text"), F.array("event_type", tag).alias("hashtags"))


def _to_the_end(s: SparkSession, made: Callable[[], DataFrame], format_: str = "parquet") -> str:
    """Runs a stream until nothing is left to give; the folder it wrote to, in the shared place."""
    base = f"{shared_path(s)}/pulsegrid-streams/{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    bursts.use_state_store(s)
    try:
        q = made().writeStream.format(format_).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        s.conf.set(key, before) if before else s.conf.unset(key)
    return f"{base}/out"


_CLOSED = """tags AS (SELECT ts, '#' || unnest(hashtags) AS term FROM (SELECT ts, [event_type, 'k' || (event_id % 7)] AS hashtags FROM events)),
 w AS (SELECT term, CAST(floor(epoch_us(ts) / {us}) AS BIGINT) AS w, count(*) AS n FROM tags GROUP BY ALL),
 last AS (SELECT CAST(floor((epoch_us(max(ts)) - 3600000000) / {us}) AS BIGINT) - 1 AS last FROM events),
 reach AS (SELECT DISTINCT term, w + i AS w FROM w, last, range({n}) r(i) WHERE w + i <= last),
 counted AS (SELECT r.term, r.w, {counts} FROM reach r JOIN w ON w.term = r.term AND w.w > r.w - {n} AND w.w <= r.w GROUP BY ALL)"""


def _closed(minutes: int, n: int) -> str:
    counts = ", ".join(f"coalesce(sum(n) FILTER (w.w = r.w - {n - 1 - i}), 0)::BIGINT AS c{i}" for i in range(n))
    return _CLOSED.format(us=f"{minutes * 60_000_000}.0", n=n, counts=counts)


_AT = "strftime(make_timestamp(w * {us}), '%Y-%m-%d %H:%M:%S') AS window_start"
_BURSTS = f"""WITH {_closed(360, 6)}, stats AS (SELECT *, (c0 + c1 + c2 + c3 + c4) / 5.0 AS mean, list_stddev_samp([c0, c1, c2, c3, c4]::DOUBLE[]) AS std FROM counted),
 metrics AS (SELECT w, term, 'hashtag' AS kind, c5 AS "count", round(mean, 3) AS mean, round(std, 3) AS std, round((c5 - mean) / greatest(std, sqrt(greatest(mean, 1.0))), 3) AS z_score, round((c5 - mean) / 6.0, 3) AS velocity FROM stats)
 SELECT {_AT.format(us=360 * 60_000_000)}, term, kind, "count", mean, std, z_score, velocity, z_score >= 2.5 AND "count" >= 3 AS is_bursting FROM metrics"""
_METRIC_COLUMNS = ("term", "kind", "count", "mean", "std", "z_score", "velocity", "is_bursting")


@query("burst_history", _BURSTS)
def _(s, d):
    out = bursts.sliding(_tagged(table(s, d, "events")), 360, 5, target="hashtags")
    return out.select(as_text(F.col("window_start")).alias("window_start"), *_METRIC_COLUMNS)


@query("stream_burst_baselines", _BURSTS)
def _(s, d):
    path = _to_the_end(s, lambda: bursts.stateful(_tagged(_events(s, d)), 360, 5, target="hashtags"))
    return s.read.parquet(path).select(as_text(F.col("window_start")).alias("window_start"), *_METRIC_COLUMNS)


_STATES = ("dormant", "stable", "emerging", "viral_surge", "decelerating", "peaking")


@query("stream_trend_alerts", f"""WITH {_closed(180, 3)}, k AS (SELECT w, term, [c0, c1, c2] AS v, c2 / 180.0 AS now, c1 / 180.0 AS before, abs(c1 - c0) <= 0.15 * greatest(0.1, c0) AND abs(c2 - c1) <= 0.15 * greatest(0.1, c1) AS even FROM counted)
 SELECT {_AT.format(us=180 * 60_000_000)}, term, CASE WHEN even AND now < 2.5 THEN 'dormant' WHEN even THEN 'stable' WHEN now < 2.5 AND abs(now - before) < 1 THEN 'dormant' WHEN now >= 25 AND now - before >= 10 THEN 'viral_surge' WHEN now >= 10 AND now > before THEN 'emerging'
 WHEN now < before AND now < before * 0.85 THEN 'decelerating' WHEN now >= 10 AND (now - before <= 0.15 * before OR now <= before) AND c_max(v) * 0.85 <= v[3] THEN 'peaking' WHEN abs(now - before) <= greatest(0.1, before) * 0.15 THEN 'stable' WHEN now < before THEN 'decelerating' ELSE 'emerging' END AS state, v[3] AS volume FROM k""".replace("c_max", "list_max"))
def _(s, d):
    """All states, not only those that alert, through the sink that gives each once."""
    s.dataSource.register(alerts.AlertSink)
    path = _to_the_end(s, lambda: alerts.trend_alerts(_tagged(_events(s, d)), 180, 3, states=_STATES), "alert_sink")
    out = alerts.alerts(s, path, "window_start timestamp, term string, state string, volume bigint")
    return out.select(as_text(F.col("window_start")).alias("window_start"), "term", "state", "volume")


@query("stream_unanalysed", """WITH x AS (SELECT CAST(event_id AS VARCHAR) AS id, ts, CASE WHEN event_id % 3 <> 0 THEN ts + to_minutes(event_id % 20) END AS analysed_at FROM events),
 m AS (SELECT least(max(ts), max(analysed_at)) - INTERVAL 10 MINUTES AS passed FROM x)
 SELECT id FROM x, m WHERE (analysed_at IS NULL OR analysed_at > ts + INTERVAL 10 MINUTES) AND ts + INTERVAL 10 MINUTES < passed""")
def _(s, d):
    def out():
        at = F.col("ts").cast("timestamp")
        posts = _events(s, d).select(F.col("event_id").cast("string").alias("id"), at.alias("ts"))
        done = _events(s, d).filter("event_id % 3 != 0").select(F.col("event_id").cast("string").alias("post_id"), F.timestamp_micros(F.unix_micros(at) + F.col("event_id") % 20 * 60_000_000).alias("analysed_at"))
        return alerts.unanalysed(posts, done).select("id")

    return s.read.schema("id string").parquet(_to_the_end(s, out))
