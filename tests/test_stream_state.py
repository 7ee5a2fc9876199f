"""Streams with state: burst baselines, unanalysed posts and alerts, against batch operators, with late rows, restarts and failures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.streaming import alerts, bursts

POSTS = "ts timestamp, text string, hashtags array<string>"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def _state_store(spark):
    bursts.use_state_store(spark)


def made(seed=1):
    r = random.Random(seed)
    rows = [(START + timedelta(minutes=r.randint(0, 3600)), "x", [r.choice("abcd")] if r.random() < 0.7 else ["#Z"]) for _ in range(240)]
    rows += [(START + timedelta(hours=100, minutes=r.randint(0, 480)), "x", ["pause"]) for _ in range(30)]
    return sorted(rows) + [(START + timedelta(hours=130), "x", ["end"])]


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))


def run(out, path, checkpoint, **options):
    q = out.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def brute(rows, width, baselines, last):
    """Counts of every closed window and each tag in it or in its baselines."""
    counts = {}
    for ts, _, tags in rows:
        for t in tags:
            k = int((ts - START).total_seconds()) // 60 // width
            counts["#" + t.lstrip("#").lower(), k] = counts.get(("#" + t.lstrip("#").lower(), k), 0) + 1
    out = {}
    for tag, k in counts:
        for w in range(k, k + baselines + 1):
            if w <= last:
                out[tag, w] = [counts.get((tag, i), 0) for i in range(w - baselines, w + 1)]
    return out


def test_stateful_bursts(spark, tmp_path):
    """The stream, stopped and started again, gives what sliding windows over the table give; a post that is too late changes nothing."""
    rows = made()
    late = [(START + timedelta(minutes=5), "x", ["a"])] * 5
    parts = [rows[:90], rows[90:180], rows[180:]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for i, part in enumerate(parts):
        put(spark, part + (late if i == 2 else []), POSTS, tmp_path / "in" / str(i))
        run(bursts.stateful(stream, 60, 5, target="hashtags"), tmp_path / "out", tmp_path / "c")  # a restart each time
    got = spark.read.parquet(str(tmp_path / "out"))
    table = spark.createDataFrame(rows + [(None, "x", ["a"])], POSTS)
    assert rows_of(got) == rows_of(bursts.sliding(table, 60, 5, target="hashtags"))
    want = brute(rows, 60, 5, 128)
    keyed = {(r["term"], int((r["window_start"] - START).total_seconds()) // 3600): r for r in got.collect()}
    assert {k: v[-1] for k, v in want.items()} == {k: r["count"] for k, r in keyed.items()} and got.count() == len(want)
    for k, v in want.items():
        assert keyed[k]["mean"] == pytest.approx(sum(v[:-1]) / 5, abs=1e-3)


def test_one_window_equals_the_batch_operator(spark):
    from pulsegrid.operators import trends

    rows = made(2)
    table = spark.createDataFrame(rows, POSTS)
    end = START + timedelta(hours=30)
    batch = trends.burst_metrics(trends.window_counts(table, 60, 5, "hashtags", end - timedelta(seconds=1)), 60)
    one = bursts.sliding(table, 60, 5, target="hashtags").filter(F.col("window_start") == F.lit(end - timedelta(hours=1))).drop("window_start")
    assert rows_of(batch) == rows_of(one) and one.count() > 2


def test_without_posts(spark, tmp_path):
    empty = spark.createDataFrame([], POSTS)
    assert bursts.sliding(empty).count() == 0


def test_unanalysed(spark, tmp_path):
    posts, done = "id string, ts timestamp, text string", "post_id string, analysed_at timestamp"
    at = lambda m: START + timedelta(minutes=m)
    put(spark, [(f"p{i}", at(i), "t") for i in range(20)] + [("none", None, "t")], posts, tmp_path / "p" / "0")
    put(spark, [(f"p{i}", at(i + 3)) for i in range(0, 20, 2)] + [("p1", at(30)), ("p3", at(1))], done, tmp_path / "a" / "0")
    read = lambda x, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / x))
    out = lambda: run(alerts.unanalysed(read("p", posts), read("a", done)), tmp_path / "out", tmp_path / "c")
    out()
    put(spark, [("later", at(500), "t")], posts, tmp_path / "p" / "1")
    put(spark, [("other", at(500))], done, tmp_path / "a" / "1")
    out()
    out()
    got = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(f"p{i}" for i in range(1, 20, 2))  # p1 was analysed too late, p3 before it was there


ALERT = "window_start timestamp, term string, state string, volume bigint"


def test_a_batch_that_fails_midway_alerts_once(spark, tmp_path):
    """The first attempt dies in a task after others have written; the batch comes again, and once more after its commit."""
    spark.dataSource.register(alerts.AlertSink)
    rows = [(START + timedelta(minutes=m), "x", [tag]) for tag, n in (("hot", 1500), ("warm", 700)) for m in range(120, 180) for _ in range(n // 60)]
    rows += [(START + timedelta(minutes=m), "x", [t]) for m in range(0, 120, 10) for t in ("hot", "warm", "calm")]
    put(spark, rows + [(START + timedelta(hours=9), "x", ["end"])], POSTS, tmp_path / "in" / "0")
    stream = lambda: spark.readStream.schema(POSTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    flag = str(tmp_path / "failed")

    @F.udf("string")
    def once_broken(term):
        import os
        import time

        if term == "#warm" and not os.path.exists(flag):
            time.sleep(1)  # the others write first
            open(flag, "w").close()
            raise RuntimeError("a task dies")
        return term

    path = str(tmp_path / "alerts")

    def start():
        found = alerts.trend_alerts(stream(), 60, 3).withColumn("term", once_broken("term"))
        q = found.writeStream.format("alert_sink").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="dies"):
        start()
    start()
    first = rows_of(alerts.alerts(spark, path, ALERT).drop("batch"))
    assert {r[1] for r in first} == {"#hot", "#warm"} and len(first) == len(set(first))
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for crc in (tmp_path / "c" / "commits").glob(f".{last.name}*"):
        crc.unlink()
    last.unlink()  # the driver died after the sink's commit and before the query's own
    start()
    assert rows_of(alerts.alerts(spark, path, ALERT).drop("batch")) == first
