"""Expectations on small hand-made tables."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import text as T
from pulsegrid.functions.time import parse_interval, time_bucket
from pulsegrid.operators import demographics as D
from pulsegrid.operators import diffusion, graph, sentiment, tables, timeline, trees, trends, vectors
from pulsegrid.sources import corpora, limits, platforms

START = datetime(2024, 1, 1)


def posts(spark, rows):
    return spark.createDataFrame([(str(i), p, a, t, START + timedelta(minutes=m), None, h) for i, (p, a, t, m, h) in enumerate(rows)], "id string, platform string, author_id string, text string, ts timestamp, parent_id string, hashtags array<string>")


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "FOLLOWS", 1.0) for a, b in pairs], "source_id string, target_id string, relation_type string, weight double")


def test_intervals(spark):
    assert parse_interval("2 Hours") == (2, "hour")
    for bad in ("1 hour; drop", "hour", "-1 day", "1 fortnight"):
        with pytest.raises(ValueError):
            parse_interval(bad)
    row = spark.sql("select timestamp'2024-01-10 13:45:00' t").select(*[time_bucket(F.col("t"), i).cast("string").alias(str(k)) for k, i in enumerate(("1 week", "5 hours", "3 months", "2 years"))]).first()
    assert list(row) == ["2024-01-08 00:00:00", "2024-01-10 13:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"]


def test_slices_and_empty(spark):
    p = posts(spark, [("reddit", "a", "x tech", 0, ["tech"]), ("reddit", "b", "y", 10, ["art"]), ("twitter", "a", "z", 20, ["tech"])])
    assert [r["id"] for r in timeline.slice_posts(p, START, START + timedelta(minutes=10), "REDDIT").collect()] == ["0", "1"]
    assert [r["id"] for r in timeline.slice_posts(p, word="TECH").collect()] == ["0", "2"]
    assert timeline.bounds(p.limit(0)).first()["total"] == 0
    assert {r["page"] for r in timeline.replay_pages(p, 2).collect()} == {0, 1}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.with_defaults(spark.sql("select '1' post_id, cast(null as string) stance")).first()["stance"] == "none"


def test_terms_and_bursts(spark):
    got = spark.sql("select 'The #AI model https://t.co/x learns, learns é' t").select(T.terms(F.col("t")).alias("x")).first()["x"]
    assert got == ["#ai", "the", "model", "learns", "learns"]
    rows = spark.sql("select 'The #AI model https://t.co/x learns, learns é abcé xabc_d' text, array('#B', 'c') hashtags, 1 ts, 'a' author_id")
    found = trends.post_terms(rows).select("term", "kind").collect()
    assert [tuple(r) for r in found] == [("#b", "hashtag"), ("#c", "hashtag"), ("model", "keyword"), ("learns", "keyword"), ("learns", "keyword")]
    # links with tags in them, tags in links, several kinds of blanks, signs in words, a long piece, no text
    texts = ["go http://a.b/#frag/more xhttp://#tag https:// #Tag##two a_b cd\tef\nghi jkl9 mno, pqr", "é" * 200 + " plain words plain", "y" * 101 + "-abc http://x.y", "", None, "\u212aelvin ABC abc #ABC"]
    odd = spark.createDataFrame([(t, ["Q"] if i % 2 else None, i % 2, "a") for i, t in enumerate(texts)], "text string, hashtags array<string>, ts int, author_id string")
    for target in ("all", "hashtags", "keywords"):
        for stored in (True, False):
            want = trends.post_terms(odd, target, stored_tags=stored).groupBy("ts", "term", "kind").count()
            assert sorted(map(tuple, trends.term_counts(odd, ["ts"], target, stored_tags=stored).collect())) == sorted(map(tuple, want.collect()))
    counted = spark.createDataFrame([("breaking", "keyword", [2, 2, 2, 2, 2, 35]), ("steady", "keyword", [15, 15, 15, 15, 15, 15])], "term string, kind string, counts array<bigint>")
    m = {r["term"]: r for r in trends.burst_metrics(counted, 60).collect()}
    assert m["breaking"]["is_bursting"] and m["breaking"]["z_score"] == round(33 / math.sqrt(2), 3) and m["breaking"]["mean"] == 2.0
    assert not m["steady"]["is_bursting"] and m["steady"]["velocity"] == 0


def test_bursts_from_posts(spark):
    rows = [("twitter", f"u{i}", "quantum leap", 60 * h + i, ["quantum"]) for h in range(5) for i in range(2)] + [("twitter", f"u{i}", "quantum leap", 300 + i, ["quantum"]) for i in range(1, 26)]
    got = {r["term"]: r for r in trends.bursts(posts(spark, rows), 60, 5).collect()}
    assert got["quantum"]["count"] >= 24 and got["quantum"]["is_bursting"]


@pytest.mark.parametrize(("volumes", "state"), [([10, 30, 90], "viral_surge"), ([5, 12, 20], "emerging"), ([40, 95, 93], "peaking"), ([95, 60, 20], "decelerating"), ([50, 52, 51], "stable"), ([0, 1, 1], "dormant"), ([], "dormant")])
def test_lifecycle(spark, volumes, state):
    df = spark.createDataFrame([("t", volumes, 5)], "term string, volumes array<bigint>, authors bigint")
    assert trends.kinematics(df, 1).first()["state"] == state


def test_sentiment(spark):
    r = spark.sql("select 'positive' l, 0.9 s, 0.9 i").select(sentiment.inverted(F.col("l"), F.col("s").cast("double"), F.col("i").cast("double")).alias("x")).first()["x"]
    assert r["polarity"] == "negative" and r["score"] == -0.9 and r["is_inverted"]
    rows = spark.createDataFrame([("I am terrified and worried!", 0.1, 0.6, 0.1, 0.1, 0.05, 0.03, 0.02)], "text string, p_joy double, p_fear double, p_anger double, p_sadness double, p_surprise double, p_disgust double, p_neutral double")
    e = sentiment.calibrated(rows).first()
    assert e["primary_emotion"] == "anxiety" and abs(sum(e["emotions"]) - 1) < 1e-9 and e["emotions"]["fear"] < 0.1
    m = {r["label"]: r for r in sentiment.classification(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "truth string, predicted string")).collect()}
    assert m["a"]["precision"] == 1 and m["a"]["recall"] == 0.5 and abs(m["b"]["accuracy"] - 2 / 3) < 1e-9


def test_threads(spark):
    t = spark.createDataFrame([("r", None, "r", "a", 0), ("x", "r", "r", "b", 60000), ("y", "r", "r", "c", 120000), ("z", "x", "r", "a", 180000), ("w", "y", "r", "d", 240000), ("lost", "gone", "r", "e", 1)], "id string, parent_id string, root_id string, author_id string, timestamp_ms bigint")
    tree = trees.thread_tree(t)
    m = trees.thread_metrics(tree).first()
    assert (m["posts"], m["replies"], m["max_depth"], m["branching"], m["participants"]) == (5, 4, 2, 1.33, 4)
    assert {r["depth"]: r["posts"] for r in trees.depth_histogram(tree).collect()} == {0: 1, 1: 2, 2: 2}


def test_thread_authors(spark):
    t = spark.createDataFrame([("r", None, "r", "b", 0), ("x", "r", "r", "a", 1), ("y", "r", "r", "b", 2), ("z", "y", "r", None, 3), ("q", None, "q", None, 0)], "id string, parent_id string, root_id string, author_id string, timestamp_ms bigint")
    got = {r["root_id"]: (r["participants"], r["authors"]) for r in trees.thread_metrics(trees.thread_tree(t)).collect()}
    assert got == {"r": (2, "a,b"), "q": (0, None)}


def test_cascades(spark):
    star = [("s", f"p{i}", f"u{i}", START, 1000 * i, i, "p0" if i else None) for i in range(11)]
    chain = [("c", f"q{i}", f"v{i}", START, 1000 * i, i, f"q{i - 1}" if i else None) for i in range(11)]
    ev = spark.createDataFrame(star + chain, "cascade_id string, post_id string, user_id string, ts timestamp, timestamp_ms bigint, adoption_order int, parent_event_id string")
    tree = trees.cascade_tree(ev, edges(spark, [("zz", "yy")]))
    v = {r["cascade_id"]: r["virality"] for r in trees.structural_virality(trees.cascade_rows(ev, edges(spark, [("zz", "yy")]))).collect()}
    assert v == {"s": 1.8182, "c": 4.0} and tree.count() == 22
    follow = spark.createDataFrame([("f", f"p{i}", u, START, 1000 * i, i) for i, u in enumerate("ABC")], "cascade_id string, post_id string, user_id string, ts timestamp, timestamp_ms bigint, adoption_order int")
    got = {r["user_id"]: (r["parent"], r["depth"]) for r in trees.cascade_tree(follow, edges(spark, [("B", "A"), ("C", "B")])).collect()}
    assert got == {"A": (None, 0), "B": ("A", 1), "C": ("B", 2)}


def test_long_chain(spark):
    n = 5000
    rows = [(f"n{i}", f"n{i - 1}" if i else None, "r") for i in range(n)] + [("x", "y", "r"), ("y", "x", "r"), ("lone", None, "s")]
    t = spark.createDataFrame(rows, "id string, parent_id string, root_id string")
    got = {(r["tree"], r["node"]): (r["depth"], r["size"]) for r in trees.closure(t, "root_id", "id", "parent_id", with_size=True).collect()}
    assert got == {("r", f"n{i}"): (i, n - i) for i in range(n)} | {("s", "lone"): (0, 1)}
    assert trees.thread_tree(t).agg(F.max("depth")).first()[0] == n - 1
    with pytest.raises(ValueError):
        trees.closure(spark.createDataFrame([("a", None, "r"), ("a", "b", "r"), ("b", "a", "r")], t.schema), "root_id", "id", "parent_id")


def cliques(spark):
    a, b = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    return edges(spark, [(x, y) for c in (a, b) for x in c for y in c if x != y] + [("a0", "b0")])


def test_communities(spark):
    e = cliques(spark)
    part = graph.cluster_ids(graph.louvain(e))
    groups = {}
    for r in part.collect():
        groups.setdefault(r["community"], set()).add(r["node"][0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"]]
    assert graph.modularity(e, part).first()["modularity"] > 0.35
    assert graph.components(e).select("component").distinct().count() == 1
    assert graph.label_propagation(e).select("community").distinct().count() == 2


def test_ranks_and_bridges(spark):
    e = edges(spark, [(f"f{i}", "kol1") for i in range(10)] + [(f"g{i}", "kol2") for i in range(4)] + [("kol1", "x"), ("x", "kol2")])
    deg = {r["node"]: r["in_degree"] for r in graph.degrees(e).collect()}
    assert deg["kol1"] == 10 and deg["kol2"] == 5
    ranks = graph.pagerank(e)
    assert abs(sum(r["rank"] for r in ranks.collect()) - 1) < 1e-6
    assert graph.rank_leaders(ranks, graph.degrees(e), graph.betweenness(e)).first()["node"] in ("kol1", "kol2")
    line = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    between = {r["node"]: round(r["betweenness"], 6) for r in graph.betweenness(line).collect()}
    assert between == {"a": 0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0}
    part = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", -1)], "node string, community int")
    got = {r["node"]: r["ratio"] for r in graph.bridges(line, part).collect()}
    assert got == {"b": 0.5, "c": 0.5}
    assert graph.ego(line, "a", 2).count() == 3
    assert graph.spearman(spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "k string, x int, y int"), "x", "y", "k").first()["rho"] == 1.0


def test_weighted_betweenness_against_all_paths(spark):
    """Shortest paths by weight, of equal length several; all simple paths are walked here."""
    import random

    r = random.Random(2)
    rows = [(f"n{r.randint(0, 8)}", f"n{r.randint(0, 8)}", "FOLLOWS", float(r.choice([1, 1, 2, 3]))) for _ in range(28)]
    names, cost = sorted({x for row in rows for x in row[:2]}), {}
    for s, t, _, w in rows:
        cost[s, t] = max(w, cost.get((s, t), 0.0))  # of several the largest, as simple has it
    found = {}

    def walk(path, length):
        found.setdefault((path[0], path[-1]), []).append((length, path))
        for (s, t), w in cost.items():
            if s == path[-1] and t not in path:
                walk([*path, t], length + w)

    for x in names:
        walk([x], 0.0)
    want = dict.fromkeys(names, 0.0)
    for paths in found.values():
        best = [p for length, p in paths if length == min(paths)[0]]
        for p in best:
            for x in p[1:-1]:
                want[x] += 1 / len(best) / ((len(names) - 1) * (len(names) - 2))
    e = spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, weight double")
    got = {x["node"]: x["betweenness"] for x in graph.betweenness(e).collect()}
    assert sum(want.values()) > 0 and all(abs(got[x] - want[x]) < 1e-9 for x in names) and len(got) == len(names)


def test_planted_communities(spark):
    import random

    r = random.Random(3)
    names = [f"{c}{i:02d}" for c in "abcd" for i in range(20)]
    pairs = {(x, y) for x in names for y in names if x != y and r.random() < (0.4 if x[0] == y[0] else 0.01)}
    part = graph.louvain(edges(spark, sorted(pairs))).collect()
    assert len({(x["node"][0], x["community"]) for x in part}) == 4 and len({x["community"] for x in part}) == 4


def test_numbered(spark):
    from pulsegrid.operators.ranks import numbered, numbered_within

    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v", "cast(id % 3 as string) as g").repartition(7)
    assert all(r["place"] == r["v"] for r in numbered(rows, "v").collect())
    got = {}
    for r in numbered_within(rows, "g", F.desc("v")).collect():
        got.setdefault(r["g"], []).append((r["place"], -r["v"]))
    assert all([p for p, _ in sorted(x)] == list(range(len(x))) and sorted(x) == sorted(x, key=lambda y: y[1]) for x in got.values())


def test_betweenness_of_the_queries(spark, monkeypatch):
    from pulsegrid.plans import catalog

    line = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", "FOLLOWS", 1.0) for i in range(12)], "source_id string, target_id string, relation_type string, weight double")
    monkeypatch.setattr(catalog, "_edges", lambda s, d: line)
    want = {f"n{i:03d}": i * (12 - i) / (12 * 11) for i in range(13)}
    for name in ("betweenness", "kol_ranking"):
        got = {r["node"]: r["betweenness"] for r in catalog.QUERIES[name](spark, "").collect()}
        assert got and all(abs(want[n] - x) < 1e-4 for n, x in got.items())


def test_places_and_ages(spark):
    cases = {"San Francisco, CA, USA": ("San Francisco", "California", "US", 0.98), "Toronto, CA": ("Toronto", "Ontario", "CA", 0.95), "Bloomington, IN": ("Bloomington", "Indiana", "US", 0.95), "New Delhi, IN": ("Delhi", "Delhi", "IN", 0.95), "Wilmington, DE": ("Wilmington", "Delaware", "US", 0.95), "UT: 30.27,-97.74": ("Austin", "Texas", "US", 1.0), "": (None, None, None, 0.0), "California": (None, "California", "US", 0.85)}
    rows = spark.createDataFrame([(k,) for k in cases], "location_raw string")
    for r in D.resolve_location(rows).collect():
        g = r["geo"]
        assert (g["city"], g["state"], g["code"], g["confidence"]) == cases[r["location_raw"]], r
    ages = {"I am 21": "18-24", "25yo dev": "25-34", "turning 50": "50-64", "born in 1998": "25-34", "born '08": "18-24", "proud grandma": "65+", "hello": None, "age 7": None}
    got = {r["t"]: r["b"] for r in spark.createDataFrame([(k,) for k in ages], "t string").select("t", D.explicit_age(F.col("t"), 2026).alias("b")).collect()}
    assert got == ages


def test_small_groups(spark):
    g = spark.createDataFrame([("age", k, n) for k, n in (("a", 25), ("b", 15), ("c", 4), ("d", 2), ("e", 1))], "dimension string, key string, users bigint")
    assert {r["key"]: r["users"] for r in D.suppress_small(g, 5).collect()} == {"a": 25, "b": 15, D.OTHER: 7}


def test_diffusion(spark):
    rows = spark.createDataFrame([("c", "u1", 0, 1, 0.8, "positive"), ("c", "u2", 60000, 2, 0.4, "neutral"), ("c", "u3", 180000, 3, 0.65, "negative")], "cascade_id string, user_id string, timestamp_ms bigint, community_id int, sentiment_score double, effective_polarity string")
    r = diffusion.arrivals(rows, "community")
    t = diffusion.transitions(r).orderBy("place").collect()
    assert [x["latency_seconds"] for x in t] == [60.0, 120.0] and diffusion.drift(r).first()["drift"] == -1.45
    with pytest.raises(ValueError):
        diffusion.arrivals(rows, "planet")


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in vectors.knn(v, [1.0, 0.0], 2).collect()] == [1, 3]


def test_payloads(spark):
    raw = [
        ("twitter", '{"id":"1","text":"Hi #tech @bob","author_id":"9","created_at":"2023-10-15T14:30:00.000Z","public_metrics":{"like_count":42,"quote_count":2},"referenced_tweets":[{"id":"7"}]}', ("1", "9", ["tech"], 42, "7")),
        ("reddit", '{"id":"r1","title":"T","selftext":"b #ml","author":"x","created_utc":1697380200.0,"score":-5,"permalink":"/r/a"}', ("r1", "x", ["ml"], 0, None)),
        ("youtube", '{"id":"y1","snippet":{"videoId":"v","topLevelComment":{"snippet":{"textOriginal":"ok #dl","authorChannelId":{"value":"UC"},"likeCount":4,"publishedAt":"2023-10-14T09:15:00Z"}},"totalReplyCount":3}}', ("y1", "UC", ["dl"], 4, "video_v")),
        ("telegram", '{"message_id":5,"chat":{"id":-100,"username":"chan"},"text":"go #now","date":1697380200,"forwards":3,"reply_to_message":{"message_id":4}}', ("tg_-100_5", "-100", ["now"], 0, "tg_-100_4")),
        ("bluesky", '{"uri":"at://d/app.bsky.feed.post/k","author":{"did":"did:1","handle":"al"},"record":{"text":"x #AI","createdAt":"2024-03-01T12:00:00.000Z","reply":{"parent":{"uri":"at://d/app.bsky.feed.post/p"}}},"likeCount":42}', ("k", "did:1", ["AI"], 42, "p")),
    ]
    for name, payload, want in raw:
        df = spark.createDataFrame([(payload,), ("{}",)], "payload string")
        r = [x for x in platforms.NORMALISERS[name](df).collect()]
        assert len(r) == 1, name
        r = r[0]
        assert (r["id"], r["author_id"], r["hashtags"], r["metrics"]["likes"], r["parent_id"]) == want and r["ts"] is not None


def test_corpora(spark, tmp_path):
    import zipfile

    (tmp_path / "u.txt").write_bytes("1\tUT: 30.0,-97.0\n2\tAustin\nbad\n".encode() + b"3\tCaf\xe9\n")
    assert [r["location_raw"] for r in corpora.tsv_users(spark, str(tmp_path / "u.txt")).orderBy("id").collect()] == ["UT: 30.0,-97.0", "Austin", "Café"]
    (tmp_path / "t.txt").write_text("1\t10\thi #a\t2010-01-02 03:04:05\n1\t11\tbad\tnever\n")
    assert corpora.tsv_posts(spark, str(tmp_path / "t.txt")).count() == 1
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.sql", "INSERT INTO x VALUES (1,2),(3,4);\nother (5,6)\n")
    assert sorted((r["source_id"], r["target_id"]) for r in corpora.dump_edges(corpora.zipped_lines(spark, str(tmp_path / "d.zip"))).collect()) == [("2", "1"), ("4", "3")]


def test_limits():
    now = [0.0]
    b = limits.TokenBucket(1, 2, lambda: now[0])
    assert b.acquire() and b.acquire() and not b.acquire() and b.wait_time() == 1.0
    now[0] = 1.5
    assert b.acquire()
    q = limits.DailyQuota(150)
    assert q.spend("search") and not q.spend("search") and q.left == 50
    assert limits.parse_env("export A='x y' # c\nB=1 # note\n#C=2") == {"A": "x y", "B": "1"}


def test_connectors(spark):
    from pulsegrid.sources.connectors import Connector, group_targets, video_target

    assert not Connector("reddit", enabled=False).connect()
    with pytest.raises(ValueError):
        Connector("pigeon")
    made = Connector("bluesky", clock=lambda: 7.0)
    assert made.connect() and made.poll(spark, "solar", 20).count() == 20
    assert made.info()["state"] == "connected" and made.info()["stats"].messages == 20 and made.info()["stats"].last_active == 7.0
    asked = Connector("twitter", fetch=lambda q, n: ['{"id":"1","text":"' + q + '"}'] * (n + 5))
    assert asked.poll(spark, "hi", 3).select("text").distinct().first()["text"] == "hi" and asked.info()["stats"].messages == 3

    def broken(query, limit):
        raise RuntimeError("down")

    failing = Connector("twitter", fetch=broken)
    assert failing.poll(spark, "x", 4).count() == 4  # made posts stand in
    assert failing.info()["state"] == "error" and failing.info()["stats"].last_error == "down"
    slow = Connector("youtube", per_minute=1)
    assert slow.poll(spark, "a", 2).count() == 2 and slow.poll(spark, "a", 2).count() == 0 and slow.info()["state"] == "rate_limited"
    assert slow.disconnect() and slow.info()["state"] == "disconnected"

    assert group_targets("https://t.me/news") == (["@news"], None) and group_targets("@x") == (["@x"], None)
    assert group_targets("two words", ["@a"]) == (["@a"], "two words") and group_targets("solar") == (["@solar"], None)
    assert group_targets("a b") == (["@telegram"], "a b") and group_targets("") == (["@telegram"], None)
    assert video_target("video: abc") == {"videoId": "abc", "order": "relevance"}
    assert video_target("dQw4w9WgXcQ")["videoId"] == "dQw4w9WgXcQ" and video_target("UC" + "x" * 22)["order"] == "time"
    assert video_target("solar power", channel="UCc") == {"allThreadsRelatedToChannelId": "UCc", "searchTerms": "solar power", "order": "time"}
    assert video_target("solar power", search=lambda q: "found")["videoId"] == "found"


def test_ingest_command(spark, tmp_path):
    import json
    import zipfile

    from pulsegrid import ingest

    base = tmp_path / "in"
    base.mkdir()
    (base / "training_set_users.txt").write_text("1\tAustin, TX\n2\tBerlin\n2\tBerlin\n")
    (base / "test_set_users.txt").write_text("3\tUT: 30.0,-97.0\n")
    (base / "training_set_tweets.txt").write_text("1\t10\thi #a\t2010-01-02 03:04:05\n1\t11\tagain\t2010-01-02 03:04:06\n")
    (base / "distinct_users_from_search_table_real_map.csv").write_text("user_id,user_screen_name,indegree,outdegree,bad_user_id\n4,dan,5,x,0\n")
    with zipfile.ZipFile(base / "Cascade.zip", "w") as z:
        z.writestr("Cascade/c1.csv", "4,1000,1\n1,2000,2\n2,never,3\n")
    with zipfile.ZipFile(base / "link.zip", "w") as z:
        z.writestr("link.sql", "INSERT INTO link VALUES (1, 2, 0),(4, 1, 0);\n")
    summary = ingest.run(spark, ingest.options(["--base", str(base), "--out", str(tmp_path / "out"), "--tweets-limit", "1"]))
    assert summary["rows"] == {"users": 4, "posts": 1, "cascade_events": 2, "graph_edges": 2} and not summary["failed"]
    (base / "link.zip").unlink()
    again = ingest.run(spark, ingest.options(["--base", str(base), "--out", str(tmp_path / "out2"), "--full"]))
    assert again["rows"]["posts"] == 2 and list(again["failed"]) == ["graph_edges"] and json.dumps(again)


def test_conversations_and_records(spark):
    from pulsegrid.operators import analytics, records

    t = spark.createDataFrame([("r", None, "r", "a", 0), ("y", "r", "r", "b", 5), ("x", "r", "r", "b", 3), ("q", None, "q", "c", 0)], "id string, parent_id string, root_id string, author_id string, timestamp_ms bigint")
    assert [r["id"] for r in analytics.replies_in_order(t, "r").collect()] == ["x", "y"]
    none = spark.createDataFrame([], "post_id string, polarity string, score double, primary_emotion string, stance string")
    known = spark.createDataFrame([("r", "negative", -0.4, "anger")], "post_id string, effective_polarity string, sentiment_score double, primary_emotion string")
    got = {r["root_id"]: r for r in analytics.conversations(t, none, known).collect()}
    assert got["r"]["dynamics_from"] == "root" and got["r"]["against"] == 1.0 and got["r"]["mood"] == "anger" and got["q"]["dynamics_from"] == "none"
    with pytest.raises(ValueError):
        analytics.evaluated(t, "taste", "test")
    rows = spark.createDataFrame([(str(i), i) for i in range(20)], "id string, n int")
    assert records.with_ids(rows, [str(i) for i in range(0, 3000, 2)]).count() == 10


def test_network_versions(spark):
    from pulsegrid.operators.network import Network

    n = Network(cliques(spark))
    first = n.overview(least=2, leaders=3)
    assert n.overview(least=2, leaders=3) is first  # kept while nothing changes
    assert first["topology"].first()["components"] == 1 and first["leaders"].count() == 3
    more = n.add(edges(spark, [("a0", "b0"), ("z", "a0")]))
    assert more.revision == 1 and more.has("z", "a0") and not n.has("z", "a0") and more.counts().first()["nodes"] == 11
    assert more.cleared().counts().first()["nodes"] == 0


def test_scorer_is_loaded_once_a_worker(spark, tmp_path):
    from pulsegrid.operators import sentiment as S

    mark = str(tmp_path)

    def load():
        import os
        import uuid

        import pandas as pd

        open(os.path.join(mark, uuid.uuid4().hex), "w").close()
        return lambda texts: pd.DataFrame({"n": texts.str.len()})

    rows = spark.createDataFrame([(str(i), "x" * i) for i in range(200)], "id string, text string").repartition(8)
    out = S.scored(rows, load, "n int", batch=7)
    assert all(r["model"]["n"] == len(r["text"]) for r in out.collect())
    import os

    assert len(os.listdir(mark)) <= 8  # tasks share workers, batches never load again


def test_settings():
    assert limits.parse_env("A=a#b\nB='x # y' # z\nC=\"open\nexport D = 1\n=2\n#E=1") == {"A": "a", "B": "x # y", "C": "open", "D": "1"}


def test_ranges_are_checked_before_a_plan(spark):
    for name, (least, most) in trends.RANGES.items():
        trends.checked(**{name: least})
        trends.checked(**{name: most})
        for value in (least - 0.5, most + 0.5, float("nan")):
            with pytest.raises(ValueError, match=name):
                trends.bursts(None, **{name: value})
            with pytest.raises(ValueError, match=name):
                trends.overview(None, **{name: value})


def test_betweenness_over_small_blocks(spark, monkeypatch):
    """Blocks, chunks, pieces and slices of a few: weighted shortest paths, counted from every node by a loop of its own.
    What meets in a round is a row for a block and a piece of edges, not one for each edge and pivot."""
    import heapq
    import random

    from pulsegrid.operators import paths

    for name, v in (("BLOCK", 9), ("CHUNK", 7), ("PIECE", 20), ("_AT_ONCE", 16)):
        monkeypatch.setattr(paths, name, v)
    r = random.Random(5)
    pairs = sorted({(f"n{r.randint(0, 39):02d}", f"n{r.randint(0, 39):02d}") for _ in range(200)})
    rows = [(x, y, "FOLLOWS", float(r.choice([1, 1, 2, 3]))) for x, y in pairs]
    names, after = sorted({x for p in pairs for x in p}), {}
    for x, y, _, w in rows:
        if x != y:
            after.setdefault(x, []).append((y, w))
    want = dict.fromkeys(names, 0.0)
    for s in names:
        far, ways, before, done, heap = {s: 0.0}, {s: 1}, {s: []}, [], [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x] or x in done:
                continue
            done.append(x)
            for y, w in after.get(x, []):
                if d + w < far.get(y, 1e9):
                    far[y], ways[y], before[y] = d + w, 0, []
                    heapq.heappush(heap, (d + w, y))
                if d + w == far[y]:
                    ways[y] += ways[x]
                    before[y].append(x)
        share = dict.fromkeys(done, 0.0)
        for y in reversed(done):
            for x in before[y]:
                share[x] += ways[x] / ways[y] * (1 + share[y])
            want[y] += share[y] if y != s else 0.0
    n = len(names)
    e = spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, weight double")
    got = {x["node"]: x["betweenness"] * (n - 1) * (n - 2) for x in graph.betweenness(e).collect()}
    assert n == len(got) and all(abs(got[x] - want[x]) < 1e-9 for x in names), max(abs(got[x] - want[x]) for x in names)


def test_cut_forgets_estimated_sizes(spark):
    """Joins multiply the sizes that plans estimate; over rounds of cuts they must not build up."""
    from pulsegrid.sources.shared import cut

    rows = spark.range(3).select("id", F.col("id").cast("string").alias("name"), F.array("id").alias("ids"), F.lit(None).cast("int").alias("none"))
    kept = cut(rows)
    assert kept.schema == rows.schema and sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    for _ in range(4):
        rows = cut(rows.join(rows.select("id"), "id"))
    assert rows.count() == 3 and rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64


def test_intensity_by_plain_words(spark):
    """Against a loop over words: shouted words of any script, marks of several words, words within others."""
    import re

    from pulsegrid.functions import text as T

    texts = ["PANIC now", "so HYPED x", "an epicenter", "epic", "can't wait! GO", "ÄÖÜ", "äÖÜ", "ŠŠŠ a", "ABC1 x", "1234", "AB", "x\x0bABC\x1cD", "🚀🚀", "ǅǅǅ", "ﬀﬀﬀ HOPE", "", "panicPANIC", "A_B-C!", "ΣΣΣ", "looking forward, stress"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def want(t, feeling):
        score = 0.0
        for words, weight in zip(T.MARKERS[feeling], (1.0, 0.5), strict=True):
            score += weight * sum(bool(re.search(rf"\b{re.escape(w)}\b", t.lower(), re.ASCII)) if w.isascii() else w in t.lower() for w in words)
        loud = any(len(w) > 2 and w.upper() == w and w.lower() != w for w in re.split(r"[ \t\n\x0b\f\r]+", t))
        return round(min(1.0, (score + 0.25 * ("!" in t) + 0.25 * loud) / 2.0), 6)

    for feeling in T.MARKERS:
        plan = rows.select("i", F.round(T.intensity(F.col("t"), feeling), 6).alias("x"))
        assert {r["i"]: r["x"] for r in plan.collect()} == {i: want(t, feeling) for i, t in enumerate(texts)}
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in text  # not every word of a text is judged


def test_sums_of_fresh_pairs(spark, monkeypatch):
    """Crowded and sparse pairs, even and uneven weights, against a loop over edges; a value that all have is stored once."""
    import numpy as np
    import pyarrow as pa

    from pulsegrid.operators import paths

    r, width = np.random.default_rng(3), 8
    us = np.sort(r.integers(0, 40, 300)).astype(np.int32)
    names, to = np.unique(r.integers(0, 3, 300) << 32 | r.integers(0, 40, 300), return_inverse=True)
    for share in (0.02, 0.7):
        for even in (True, False):
            for at_once in (16, 1 << 18):
                monkeypatch.setattr(paths, "_AT_ONCE", at_once)
                key = np.flatnonzero(r.random(40 * width) < share)
                val, ws = (np.full(n, 2.0) if even else r.integers(1, 4, n).astype(float) for n in (len(key), len(us)))
                add, want = r.integers(1, 9, len(key)).astype(float), {}
                for k, x, n in zip(key.tolist(), val, add, strict=True):
                    for e in np.flatnonzero(us == k // width).tolist():
                        at, far = (int(names[to[e]] >> 32), int(names[to[e]] & 0xFFFFFFFF) * width + k % width), x + ws[e]
                        old = want.get(at, (far, 0.0))
                        want[at] = (far, n) if far < old[0] else (old[0], old[1] + n * (far == old[0]))
                edges = {k: paths._packed(x.astype(kind)) for (k, kind), x in zip(paths._EDGES.items(), (us, names, to, ws), strict=True)}
                row = paths._row(0, 5, None, (key, val, add))
                batch = pa.table({k: pa.array([x], pa.binary() if isinstance(x, bytes) else None) for k, x in (row | edges).items() if x is not None}).to_batches()
                got = {}
                for out in paths._sent(width)(iter(batch)):
                    fresh = paths._fresh({k: out.column(k)[0] for k in out.schema.names})
                    got |= {(out.column("b")[0].as_py(), int(k)): (x, n) for k, x, n in zip(*fresh, strict=True)}
                assert got == want and got
    many = np.arange(100_000)
    assert sum(len(x) for x in paths._row(0, 0, None, (many, many * 0.0, many * 0.0 + 1)).values() if isinstance(x, bytes)) < 1000


def test_rounds_of_paths_are_deleted(spark):
    """Of the states of many rounds no more than the last stays in the shared folder."""
    from pathlib import Path

    line = edges(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(6)])
    graph.betweenness(line.limit(0)).count()  # the folder is there from here on
    place = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = len(list(place.iterdir()))
    assert graph.betweenness(line).agg(F.max("betweenness")).first()[0] > 0
    assert len(list(place.iterdir())) - before < 12  # 14 rounds and some tables besides


def test_moves_to_the_best_community(spark):
    """On a random graph: when nodes took the best community of one side only, this ended at a modularity of 0.025."""
    import random

    r = random.Random(8)
    names = [f"n{i:02d}" for i in range(60)]
    e = edges(spark, sorted({(x, y) for x in names for y in names if x != y and r.random() < 0.15}))
    assert graph.modularity(e, graph.louvain(e)).first()["modularity"] > 0.15


def test_diversity_of_shared_bodies(spark, monkeypatch):
    """Bodies and tails give what whole texts give: shared words, tails with words, no stored tags, no author, no text. A term's
    posts are no rows of their own."""
    from pulsegrid.operators import trends

    for name in ("AUTHORS", "BODIES"):
        monkeypatch.setattr(trends, name, 2)
    bodies = spark.createDataFrame([(0, "alpha beta alpha the #Gamma"), (1, "beta delta https://x.org/y"), (2, None), (3, ""), (4, "omega #One")], "body_id long, body string")
    tails, tags = (" #t1 #k0", " delta alpha", " #t1"), (["t1", "k0"], [], ["T1"], None)
    rows = [(f"a{i * i % 7}" if i % 9 else None, i % 6, tails[i % 3], tags[i % 4]) for i in range(40)]
    parts = spark.createDataFrame(rows, "author_id string, body_id long, tail string, hashtags array<string>").withColumn("ts", F.lit(0).cast("timestamp"))
    posts = parts.join(bodies, "body_id").withColumn("text", F.concat("body", "tail"))
    for target in ("all", "hashtags", "keywords"):
        want = {r["term"]: r["diversity"] for r in trends.term_diversity(posts, target).collect()}
        assert {r["term"]: r["diversity"] for r in trends.term_diversity(parts, target, bodies).collect()} == want and want
