"""Readers of offline corpora: tab-separated posts and users, CSV users, zipped cascades and dumps, labelled texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hashtags, mentions, urls
from ..operators.demographics import coordinates


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(raw, "ISO-8859-1"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): decoded lines without their ends."""
    return spark.read.text(path).select(F.regexp_replace(decoded(F.col("value").cast("binary")), r"[\r\n]+$", "").alias("value"))


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit else df


def tsv_users(spark: SparkSession, path: str, split: str = "train", limit: int | None = None) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines(spark, path).filter(F.size(f) >= 2).select(F.trim(f[0]).alias("id"), F.trim(f[1]).alias("location_raw"))
    at = coordinates(F.col("location_raw"))
    meta = F.to_json(F.struct(F.lit(split).alias("corpus_split")))
    return _limited(rows.select("id", F.lit("twitter").alias("platform"), "location_raw", at["lat"].alias("latitude"), at["lon"].alias("longitude"), meta.alias("extra_metadata")), limit)


def tsv_posts(spark: SparkSession, path: str, zone: str = "UTC", limit: int | None = None) -> DataFrame:
    """author, id, text, time; rows with fewer fields or a bad time are left out."""
    f = F.split("value", "\t")
    rows = lines(spark, path).filter(F.size(f) >= 4).select(F.trim(f[0]).alias("author_id"), F.trim(f[1]).alias("id"), F.trim(f[2]).alias("text"), F.to_utc_timestamp(F.try_to_timestamp(F.trim(f[3]), F.lit("yyyy-MM-dd HH:mm:ss")), zone).alias("ts"))
    rows = rows.filter("ts is not null")
    return _limited(rows.withColumns({"platform": F.lit("twitter"), "hashtags": hashtags(F.col("text")), "mentions": mentions(F.col("text")), "urls": urls(F.col("text")), "timestamp_ms": F.unix_millis("ts")}), limit)


def csv_users(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """user_id, user_screen_name, indegree, outdegree; a bad number is 0."""
    schema = "user_id string, user_screen_name string, indegree string, outdegree string, bad_user_id string"
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="PERMISSIVE") if _has_all(spark, path, schema) else spark.read.csv(path, header=True)
    number = lambda c: F.coalesce(F.trim(F.col(c)).try_cast("int"), F.lit(0)) if c in rows.columns else F.lit(0)
    name = F.trim("user_screen_name") if "user_screen_name" in rows.columns else F.lit(None).cast("string")
    return _limited(rows.select(F.trim("user_id").alias("id"), F.lit("twitter").alias("platform"), F.when(name != "", name).alias("screen_name"), number("indegree").alias("indegree"), number("outdegree").alias("outdegree")), limit)


def _has_all(spark: SparkSession, path: str, schema: str) -> bool:
    return spark.read.csv(path, header=True).columns == [x.split()[0] for x in schema.split(", ")]


def _unzipped(suffix: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        with z.open(name) as f:
                            reader = io.TextIOWrapper(f, encoding="latin-1")
                            while part := reader.readlines(1 << 22):
                                yield pd.DataFrame({"name": name, "value": [x.rstrip("\r\n") for x in part]})

    return run


def unzipped(archives: DataFrame, suffix: str = "") -> DataFrame:
    """(name, value): lines of the files in archives (content)."""
    return archives.select("content").mapInPandas(_unzipped(suffix), "name string, value string")


def zipped_lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(name, value): lines of the files in zip archives, a part of a file at a time; an archive is one task's."""
    return unzipped(spark.read.format("binaryFile").load(path), suffix)


def cascades(rows: DataFrame) -> DataFrame:
    """Lines 'user,time in ms[,order]' of files named by cascade; a bad order is 0, a bad time goes to ``rejected``."""
    f = F.split("value", ",")
    ms = F.trim(f[1]).try_cast("bigint")
    return rows.select(
        F.regexp_replace(F.regexp_extract("name", r"([^/]+)$", 1), r"\.[^.]*$", "").alias("cascade_id"), F.trim(f[0]).alias("user_id"), ms.alias("timestamp_ms"), F.timestamp_millis(ms).alias("ts"),
        F.coalesce(F.trim(F.get(f, F.lit(2))).try_cast("int"), F.lit(0)).alias("adoption_order"), ms.isNull().alias("rejected"),
    )


def dump_edges(rows: DataFrame) -> DataFrame:
    """Edges of the (user, follower) tuples in INSERT lines: the follower points to the user."""
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(r"\((\d+),\s*(\d+)"), F.lit(1)).alias("a"), F.regexp_extract_all("value", F.lit(r"\((\d+),\s*(\d+)"), F.lit(2)).alias("b"))
    return rows.filter(F.lower("value").contains("insert")).select(F.explode(pairs).alias("x")).select(F.col("x.b").alias("source_id"), F.col("x.a").alias("target_id"), F.lit("follows").alias("relation_type"), F.lit(1.0).alias("weight"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of a file, or of a folder's files by name, numbered from 0, without the blanks around them.

    A file is read in pieces by as many tasks. Both scans go over the same pieces, as they share their RDD; what a piece's
    first line is follows from how many the pieces before it have.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    pieces = DataFrame(spark._jsparkSession.createDataFrame(read._jdf.toJavaRDD(), read._jdf.schema()), spark)
    sizes = pieces.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each piece
    starts = sizes.select("_file", "_start", (before - F.col("_first")).alias("_by"))
    value = F.regexp_replace(F.make_valid_utf8("value"), r"(?U)^\s+|\s+$", "")
    return pieces.join(F.broadcast(starts), ["_file", "_start"]).select((F.col("_at") + F.col("_by")).alias("n"), value.alias("value"))


def labelled(spark: SparkSession, base: str, task: str, split: str) -> DataFrame:
    """(text, label_id, label): the n-th text with the n-th label, named by the task's mapping; bad labels are left out."""
    at = f"{base}/{task}"
    top = f"{base}/{task.split('/')[0]}/mapping.txt"
    texts = numbered_lines(spark, f"{at}/{split}_text.txt").select("n", F.col("value").alias("text"))
    labels = numbered_lines(spark, f"{at}/{split}_labels.txt").select("n", F.col("value").try_cast("int").alias("label_id")).filter("label_id is not null")
    m = F.split("value", r"\s+", 2)
    names = numbered_lines(spark, top).select(m[0].try_cast("int").alias("label_id"), F.get(m, F.lit(1)).alias("name")).filter("label_id is not null")
    out = texts.join(labels, "n").join(names, "label_id", "left")
    return out.select("n", "text", "label_id", F.coalesce("name", F.concat(F.lit("label_"), F.col("label_id").cast("string"))).alias("label"), F.lit(task).alias("task"), F.lit(split).alias("split"))


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("task", "split").agg(F.count(F.lit(1)).alias("samples"))
