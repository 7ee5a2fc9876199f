import queue

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import platforms
from pulsegrid.sources.feeds import MadeFeed
from pulsegrid.streaming.pipeline import Broadcaster, Pipeline, Store, hashtag_counts, polled, replay


def posts(df):
    return platforms.twitter(df).select("id", "platform", "author_id", "text", "ts", "parent_id", "hashtags")


def test_oldest_is_dropped():
    b = Broadcaster(2)
    q = b.subscribe()
    for i in range(3):
        b.publish({"n": i})
    assert [q.get_nowait()["n"] for _ in range(2)] == [1, 2]
    assert b.next(q, 0.01)["type"] == "heartbeat"


def test_pipeline(spark, tmp_path):
    spark.dataSource.register(MadeFeed)
    rows = posts(spark.read.format("made_feed").option("query", "solar").option("rows", 40).load())
    enrich = lambda due: due.select(F.col("id").alias("post_id"), F.lit("positive").alias("effective_polarity"))
    p = Pipeline(Store(spark, str(tmp_path)), enrich, batch=10)
    p.tick(rows, 0)
    p.tick(rows, 1)
    assert p.errors == []
    assert p.store.read("posts").count() == 40 and p.store.read("post_analytics").count() == 20
    for i in (2, 3, 4):
        p.tick(rows.limit(0), i)
    assert p.store.read("post_analytics").count() == 40 and not p.store.folders("pending") and p.errors == []
    broken = Pipeline(Store(spark, str(tmp_path / "b")), lambda due: due.select("nothing"))
    broken.tick(rows, 0)
    assert [e[0] for e in broken.errors] == ["enrich"] and broken.store.read("posts").count() == 40


def test_stream_counts(spark, tmp_path):
    spark.dataSource.register(MadeFeed)
    rows = posts(spark.read.format("made_feed").option("rows", 120).load())
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = hashtag_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, hashtag_counts(rows).collect()))
    assert isinstance(Broadcaster().subscribe(), queue.Queue)


def test_store_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(MadeFeed)
    rows = posts(spark.read.format("made_feed").option("query", "wind").option("rows", 4000).load())
    first, second = rows.filter("id < '8'"), rows.filter("id >= '8'")
    Store(spark, str(tmp_path)).upsert("posts", first)
    store = Store(spark, str(tmp_path))
    before = store.folders("posts")
    assert len(before) > 2
    day = min(before)
    store.upsert("posts", second.filter(F.date_format("ts", "yyyy-MM-dd") == day))
    after = Store(spark, str(tmp_path)).folders("posts")
    assert [d for d in before if before[d] != after[d]] == [day]  # other days are not written again
    Store(spark, str(tmp_path)).upsert("posts", second.withColumn("text", F.lit("new")))
    Store(spark, str(tmp_path)).upsert("posts", second.limit(0))
    got = Store(spark, str(tmp_path)).read("posts")
    assert got.count() == 4000 and got.select("id").distinct().count() == 4000 and got.filter("text = 'new'").count() == second.count()


def test_failed_ingest_is_not_committed(spark, tmp_path):
    spark.dataSource.register(MadeFeed)
    rows = posts(spark.read.format("made_feed").option("rows", 10).load())
    p = Pipeline(Store(spark, str(tmp_path)))
    with pytest.raises(Exception, match="no such|cannot|UNRESOLVED"):
        p.tick(rows.drop("id"), 0)
    assert p.store.read("posts") is None
    p.tick(rows, 0)
    assert p.store.read("posts").count() == 10


def test_feeds_start_stop_and_replay(spark, tmp_path):
    spark.dataSource.register(MadeFeed)
    for q in ("a", "b"):
        posts(spark.read.format("made_feed").option("query", q).option("rows", 30).load()).write.parquet(str(tmp_path / q))
    schema = "id string, platform string, author_id string, text string, ts timestamp, parent_id string, hashtags array<string>"
    both = polled([replay(spark, str(tmp_path / q), schema) for q in ("a", "b")])
    p = Pipeline(Store(spark, str(tmp_path / "store")))
    running = p.start(both, str(tmp_path / "c"), seconds=1)
    assert p.start(both, str(tmp_path / "c")) is running
    running.processAllAvailable()
    p.stop()
    p.stop()
    assert p.store.read("posts").count() == 60 and p.errors == []
    again = Pipeline(Store(spark, str(tmp_path / "store")))
    again.start(both, str(tmp_path / "c"), seconds=1).processAllAvailable()
    again.stop()
    assert again.store.read("posts").count() == 60
