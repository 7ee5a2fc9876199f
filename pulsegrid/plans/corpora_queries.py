"""Queries over corpora in their files' own formats: the test tables are written in such a format and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import as_text
from ..session import table
from ..sources import corpora, platforms
from ..sources.feeds import MadeFeed
from ..sources.shared import shared_path
from ..sources.views import load
from .registry import query

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
_ONE_LINE = "trim(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g'))"


def _fresh(s: SparkSession, name: str) -> str:
    return f"{shared_path(s)}/pulsegrid-corpora/{name}-{uuid.uuid4().hex}"


def _as_lines(s: SparkSession, rows: DataFrame, name: str) -> str:
    """rows (value) as compressed text files, many, as each is one task's to read; their folder."""
    path = _fresh(s, name)
    rows.write.option("compression", "lz4").option("maxRecordsPerFile", 20_000).text(path)
    return path


def _one_line(c: str):
    return F.trim(F.regexp_replace(c, r"[\t\r\n]+", " "))


@query("corpus_users_tsv", """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'UT: ' || (c_custkey % 80) || '.5,' || -(c_custkey % 120) ELSE c_address END AS location_raw,
 CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 80 + 0.5 END::DOUBLE AS latitude, CASE WHEN c_custkey % 3 = 0 THEN -(c_custkey % 120) END::DOUBLE AS longitude FROM
 (SELECT c_custkey, 'place' || c_custkey AS c_address FROM customer)""")
def _(s, d):
    k = F.col("c_custkey")
    gps = F.concat(F.lit("UT: "), (k % 80).cast("string"), F.lit(".5,"), (-(k % 120)).cast("string"))
    place = F.when(k % 3 == 0, gps).otherwise(F.concat(F.lit("place"), k.cast("string")))
    at = _as_lines(s, table(s, d, "customer").select(F.concat_ws("\t", k.cast("string"), place).alias("value")), "users")
    return corpora.tsv_users(s, at).select("id", "location_raw", "latitude", "longitude")


@query("corpus_posts_tsv", f"""SELECT author_id, id, {_ONE_LINE} AS text, {_TS('ts')} AS at, array_to_string(regexp_extract_all({_ONE_LINE}, '#([\\p{{L}}\\p{{N}}_]+)', 1), ',') AS tags FROM posts""", ("posts",))
def _(s, d):
    p = load(s, d, "posts")
    line = F.concat_ws("\t", "author_id", "id", _one_line("text"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    bad = p.limit(3).select(F.concat_ws("\t", "author_id", "id", F.lit("bad time"), F.lit("never")).alias("value"))
    at = _as_lines(s, p.select(line.alias("value")).union(bad), "posts")
    out = corpora.tsv_posts(s, at)
    return out.select("author_id", "id", "text", as_text(F.col("ts")).alias("at"), F.array_join("hashtags", ",").alias("tags"))


@query("corpus_users_csv", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS screen_name, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 1000 END::INT AS indegree, CAST(c_nationkey AS INT) AS outdegree FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(
        k.alias("user_id"), F.when(k % 5 != 0, F.col("c_name")).otherwise("").alias("user_screen_name"),
        F.when(k % 7 == 0, "many").otherwise((k % 1000).cast("string")).alias("indegree"), F.col("c_nationkey").alias("outdegree"), F.lit("").alias("bad_user_id"),
    )
    at = _fresh(s, "csv")
    rows.write.option("header", True).csv(at)
    return corpora.csv_users(s, at).select("id", "screen_name", "indegree", "outdegree")


def _zipped(name: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for key, own in p.groupby("file"):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"in/{key}.{name}", "\n".join(own.sort_values("line")["value"]))
                out.append((key, raw.getvalue()))
            yield pd.DataFrame(out, columns=["file", "content"])

    return run


def _archives(s: SparkSession, rows: DataFrame, ending: str) -> DataFrame:
    """rows (file, line, value) as an archive for each file: what binaryFile gives."""
    return rows.groupBy("file").applyInPandas(lambda p: next(iter(_zipped(ending)([p]))), "file string, content binary").select("content")


@query("corpus_cascades_zip", "SELECT replace(cascade_id, '|', '_') AS cascade_id, user_id, CASE WHEN adoption_order % 10 = 9 THEN NULL ELSE timestamp_ms END AS timestamp_ms, CASE WHEN adoption_order % 4 = 3 THEN 0 ELSE adoption_order END AS adoption_order, adoption_order % 10 = 9 AS rejected FROM cascade_events", ("cascade_events",))
def _(s, d):
    o = F.col("adoption_order")
    ms = F.when(o % 10 == 9, "soon").otherwise(F.col("timestamp_ms").cast("string"))
    line = F.concat_ws(",", "user_id", ms, F.when(o % 4 == 3, "x").otherwise(o.cast("string")))
    rows = load(s, d, "cascade_events").select(F.replace(F.col("cascade_id"), F.lit("|"), F.lit("_")).alias("file"), o.alias("line"), line.alias("value"))
    lines = corpora.unzipped(_archives(s, rows, "csv"))
    return corpora.cascades(lines).select("cascade_id", "user_id", "timestamp_ms", "adoption_order", "rejected")


@query("corpus_edges_dump", "SELECT substr(source_id, 2) AS source_id, substr(target_id, 2) AS target_id, 'follows' AS relation_type FROM graph_edges", ("graph_edges",))
def _(s, d):
    e = load(s, d, "graph_edges")
    value = F.concat(F.lit("("), F.substring("target_id", 2, 20), F.lit(", "), F.substring("source_id", 2, 20), F.lit(", 1)"))
    packed = e.groupBy(F.pmod(F.xxhash64("source_id"), F.lit(50)).alias("line")).agg(F.concat(F.lit("INSERT INTO `link` VALUES "), F.array_join(F.collect_list(value), ","), F.lit(";")).alias("value"))
    other = s.createDataFrame([(-1, "-- (1, 2) a comment"), (-2, "CREATE TABLE `link` (a int)")], "line bigint, value string")
    rows = packed.unionByName(other).select(F.lit("link").alias("file"), "line", "value")
    return corpora.dump_edges(corpora.unzipped(_archives(s, rows, "sql"))).select("source_id", "target_id", "relation_type")


@query("corpus_decoding", "SELECT r_regionkey, r_name || ' é' AS name FROM region")
def _(s, d):
    both = table(s, d, "region").select("r_regionkey", F.concat("r_name", F.lit(" é")).alias("t"))
    raw = F.when(F.col("r_regionkey") % 2 == 0, F.encode("t", "UTF-8")).otherwise(F.encode("t", "ISO-8859-1"))
    return both.select("r_regionkey", corpora.decoded(raw).alias("name"))


_LABELLED = "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, quality FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL"


def _labelled_files(s: SparkSession, d: str) -> str:
    """A task's folder: texts, labels and the names of labels, one of which is not named."""
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").filter("quality is not null").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"), "quality")
    base = _fresh(s, "task")
    order = ["doc_id", "quality"]  # of the lines of both files; of rows that share a place, the label is the same
    rows.orderBy(*order).select("text").write.text(f"{base}/mood/test_text.txt")
    rows.orderBy(*order).select(F.col("quality").cast("string")).write.text(f"{base}/mood/test_labels.txt")
    s.createDataFrame([("0 bad\nnone here\n",)], "value string").coalesce(1).write.text(f"{base}/mood/mapping.txt")
    return base


@query("corpus_labelled", f"SELECT trim(text) AS text, CAST(quality AS INT) AS label_id, CASE WHEN quality = 0 THEN 'bad' ELSE 'label_' || quality END AS label FROM ({_LABELLED})")
def _(s, d):
    return corpora.labelled(s, _labelled_files(s, d), "mood", "test").select("text", "label_id", "label")


@query("corpus_split_counts", f"SELECT 'mood' AS task, 'test' AS split, count(*) AS samples FROM ({_LABELLED})")
def _(s, d):
    return corpora.split_counts(corpora.labelled(s, _labelled_files(s, d), "mood", "test"))


# --- payloads of the other platforms -------------------------------------------------------------------------------


def _payload(s, d, *cells) -> DataFrame:
    e = table(s, d, "events").withColumn("u", F.concat(F.lit("u"), F.col("user_id").cast("string"))).withColumn("i", F.col("event_id").cast("string"))
    e = e.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("iso", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select(F.to_json(F.struct(*cells)).alias("payload"))


_AT = _TS("to_timestamp(floor(epoch_us(ts) / 1e6)) AT TIME ZONE 'UTC'")


def _shown(posts: DataFrame, *more) -> DataFrame:
    return posts.select("id", "author_id", "text", as_text(F.col("ts")).alias("at"), "parent_id", F.array_join("hashtags", ",").alias("tags"), F.col("metrics.likes").alias("likes"), *more)


@query("payload_reddit", f"SELECT CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS author_id, 'T' || event_id || chr(10) || chr(10) || 'b #' || event_type AS text, {_AT} AS at, CASE WHEN event_id % 3 = 0 THEN 't1_' || event_id END AS parent_id, event_type AS tags, greatest(0, event_id % 20 - 5) AS likes, 'https://reddit.com/r/' || event_id AS link FROM events")
def _(s, d):
    e = F.col("event_id")
    rows = _payload(s, d, F.col("i").alias("id"), F.concat(F.lit("T"), "i").alias("title"), F.concat(F.lit("b #"), "event_type").alias("selftext"), F.col("u").alias("author"), F.col("sec").alias("created_utc"), (e % 20 - 5).alias("score"), F.concat(F.lit("/r/"), "i").alias("permalink"), F.when(e % 3 == 0, F.concat(F.lit("t1_"), "i")).alias("parent_id"))
    return _shown(platforms.reddit(rows), F.col("urls")[0].alias("link"))


@query("payload_youtube", f"SELECT CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS author_id, 'ok #' || event_type AS text, {_AT} AS at, 'video_v' || event_id % 9 AS parent_id, event_type AS tags, event_id % 50 AS likes FROM events")
def _(s, d):
    e = F.col("event_id")
    inner = F.struct(F.concat(F.lit("ok #"), "event_type").alias("textOriginal"), F.struct(F.col("u").alias("value")).alias("authorChannelId"), (e % 50).alias("likeCount"), F.col("iso").alias("publishedAt"))
    video = F.concat(F.lit("v"), (e % 9).cast("string"))
    rows = _payload(s, d, F.col("i").alias("id"), F.struct(video.alias("videoId"), F.struct(inner.alias("snippet")).alias("topLevelComment")).alias("snippet"))
    return _shown(platforms.youtube(rows))


@query("payload_telegram", f"SELECT 'tg_-7_' || event_id AS id, '-7' AS author_id, 'go #' || event_type AS text, {_AT} AS at, CASE WHEN event_id % 2 = 0 THEN 'tg_-7_' || (event_id + 1) END AS parent_id, event_type AS tags, event_id % 30 AS likes, event_id % 11 AS shares FROM events")
def _(s, d):
    e = F.col("event_id")
    rows = _payload(s, d, e.alias("message_id"), F.struct(F.lit(-7).alias("id"), F.lit("chan").alias("username")).alias("chat"), F.concat(F.lit("go #"), "event_type").alias("text"), F.col("sec").alias("date"), (e % 30).alias("likes"), (e % 11).alias("forwards"), F.when(e % 2 == 0, F.struct((e + 1).alias("message_id"))).alias("reply_to_message"))
    return _shown(platforms.telegram(rows), F.col("metrics.shares").alias("shares"))


@query("payload_bluesky", f"SELECT 'k' || event_id AS id, 'u' || user_id AS author_id, 'x #' || event_type AS text, {_AT} AS at, CASE WHEN event_id % 2 = 0 THEN 'p' || event_id END AS parent_id, event_type AS tags, event_id % 40 AS likes FROM events")
def _(s, d):
    e, key = F.col("event_id"), F.lit("at://d/app.bsky.feed.post/")
    reply = F.when(e % 2 == 0, F.struct(F.struct(F.concat(key, F.lit("p"), "i").alias("uri")).alias("parent")))
    record = F.struct(F.concat(F.lit("x #"), "event_type").alias("text"), F.col("iso").alias("createdAt"), reply.alias("reply"))
    rows = _payload(s, d, F.concat(key, F.lit("k"), "i").alias("uri"), F.struct(F.col("u").alias("did")).alias("author"), record.alias("record"), (e % 40).alias("likeCount"))
    return _shown(platforms.bluesky(rows))


@query("made_feeds")
def _(s, d):
    s.dataSource.register(MadeFeed)
    out = None
    for name, normalise in sorted(platforms.NORMALISERS.items()):
        raw = s.read.format("made_feed").option("query", "solar").option("platform", name).option("rows", 200).load()
        part = normalise(raw).select("platform", "id", "author_id", "text", as_text(F.col("ts")).alias("at"))
        out = part if out is None else out.union(part)
    return out


@query("nested_threads", """WITH RECURSIVE t AS (SELECT id, parent_id, root_id, 0 AS depth FROM threads WHERE parent_id IS NULL UNION ALL SELECT c.id, c.parent_id, c.root_id, t.depth + 1 FROM threads c JOIN t ON c.parent_id = t.id)
 SELECT depth, id FROM t WHERE depth <= 2""", ("threads",))
def _(s, d):
    t = load(s, d, "threads").select("id", "parent_id", "root_id")
    post = lambda c: F.struct(F.struct(F.col(c).alias("id")).alias("post"))
    leaf = t.join(t.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("_up")), "parent_id").filter("_up is not null")
    tops = t.filter("parent_id is null").select(F.col("id").alias("top"))
    second = leaf.groupBy("parent_id").agg(F.collect_list(F.struct(F.struct(F.col("id").alias("id")).alias("post"))).alias("replies"))
    first = t.join(tops, F.col("parent_id") == F.col("top")).select("id", "top").join(second.withColumnRenamed("parent_id", "id"), "id", "left")
    first = first.groupBy("top").agg(F.collect_list(F.struct(F.struct(F.col("id").alias("id")).alias("post"), F.col("replies"))).alias("replies"))
    nested = tops.join(first, "top", "left").select(F.to_json(F.struct(F.struct(F.col("top").alias("id")).alias("post"), F.col("replies"))).alias("payload"))
    return platforms.thread_posts(nested).select("depth", F.get_json_object("payload", "$.id").alias("id"))
