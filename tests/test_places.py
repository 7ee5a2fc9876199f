"""Names in texts and nearest places against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import demographics, places


def words(t):
    return re.findall(r"[^\W_]+", (t or "").replace(".", "").lower())


def greedy(text, names):
    """name by its words; from the left, the longest at each place."""
    w, i, out = words(text), 0, []
    most = max(map(len, names), default=0)
    while i < len(w):
        n = next((n for n in range(most, 0, -1) if tuple(w[i : i + n]) in names and i + n <= len(w)), 0)
        if n:
            out.append((names[tuple(w[i : i + n])], i, n))
        i += n or 1
    return out


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_names(spark, broadcast_rows):
    r = random.Random(1)
    vocabulary = [f"n{i}" for i in range(400)] + ["new", "york", "é", "D.C.", "st"]
    names = ["New York", "new york city", "York", "St. é", "st é", "D.C.", "", "...", "!?", None] + [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 4))) for _ in range(100_000)]
    texts = [None, "", "...", "New York City, new york; York", "st é D.C. dc", "new new york city york"] + [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80))) for _ in range(150)]
    texts += ["é " * 3000, texts[-1], texts[-1]]
    t = spark.createDataFrame([(i // 2, x, "n", "s") for i, x in enumerate(texts)], "id int, text string, name string, key string")
    n = spark.createDataFrame([(x, 1) for x in names], "name string, start int")
    known = {}
    for x in sorted((x for x in names if x), key=str):
        if words(x):
            known.setdefault(tuple(words(x)), x)
    got = sorted(map(tuple, places.names_in_texts(t, n, broadcast_rows=broadcast_rows).collect()))
    assert got == sorted((i // 2, *m) for i, x in enumerate(texts) for m in greedy(x, known)) and len(got) > 1000
    assert places.names_in_texts(t, n.limit(0)).count() == 0 and places.names_in_texts(t.limit(0), n).count() == 0


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_nearest(spark, broadcast_rows):
    r = random.Random(2)
    spots = [(i, round(r.uniform(-5, 5), 2), round(r.uniform(-5, 5), 2), f"p{i}") for i in range(300)] + [(300, 1.0, 1.0, "a"), (301, 1.0, 1.0, "b"), (302, None, 0.0, "none"), (303, -4.0, 4.0, None)]
    at = [(i, round(r.uniform(-6, 6), 2), round(r.uniform(-6, 6), 2)) for i in range(300)] + [(300, 1.0, 1.0), (300, 1.0, 1.0), (301, None, 1.0), (302, 80.0, 80.0), (None, 0.5, 0.5), (303, 1.8, 1.0)]
    p = spark.createDataFrame([(*x, "x", 3) for x in at], "id int, la double, lo double, far string, i int")
    q = spark.createDataFrame(spots, "i int, lat double, lon double, name string")
    for most in (0.8, 0.3):
        out = places.with_nearest(p, q, F.col("la"), F.col("lo"), most, broadcast_rows=broadcast_rows)
        assert out.columns == [*p.columns, "near"]
        got = sorted(((x["id"] is not None, x["id"] or 0, x["la"] or 0.0), x["near"] and (x["near"]["i"], x["near"]["name"], round(x["near"]["far"], 9))) for x in out.collect())
        want = []
        for i, la, lo in at:
            best = min(((math.sqrt((la - a) ** 2 + (lo - o) ** 2), k, n) for k, a, o, n in spots if a is not None), key=lambda x: x[:2]) if la is not None else (9,)
            want.append(((i is not None, i or 0, la or 0.0), (best[1], best[2], round(best[0], 9)) if best[0] <= most else None))
        assert got == sorted(want)
    assert places.with_nearest(p, q.limit(0), F.col("la"), F.col("lo")).filter("near is not null").count() == 0


def test_cities(spark):
    t = spark.createDataFrame([(1, "From Austin to BERLIN, back to austin."), (2, "nyc, New York; nycity"), (3, None)], "id int, text string")
    assert sorted(map(tuple, demographics.mentioned_cities(t).collect())) == [(1, "Austin", "United States"), (1, "Berlin", "Germany"), (2, "New York", "United States")]
    u = spark.createDataFrame([(1, "37.77, -122.42"), (2, "0.5, 0.5"), (3, "99, 3"), (4, None)], "id int, location_raw string")
    got = {x["id"]: x["geo"] for x in demographics.resolve_location(u).collect()}
    assert got[1]["city"] == "San Francisco" and got[2]["city"] is None and got[2]["confidence"] == 1.0 and got[3]["source"] == "unknown"


def test_nearest_looks_near_first(spark, monkeypatch):
    """Among many places in reach a point is held against those of small cells; spots, clusters and gaps give what a loop gives."""
    r = random.Random(5)
    spots = [(i, round(r.gauss(0, 0.05), 3), round(r.gauss(0, 0.05), 3)) for i in range(700)] + [(700 + i, round(r.uniform(-60, 60), 2), round(r.uniform(-90, 90), 2)) for i in range(300)]
    spots += [(1000 + i, 10.0, 10.0) for i in range(200)] + [(2000, None, 1.0)]
    at = [(i, round(r.uniform(-80, 80), 2), round(r.uniform(-120, 120), 2)) for i in range(250)] + [(250 + i, round(r.gauss(0, 0.1), 3), 0.0) for i in range(50)] + [(300, 10.0, 10.0), (301, None, 0.0), (302, 10.0, -10.0)]
    q, p = spark.createDataFrame(spots, "i int, lat double, lon double"), spark.createDataFrame(at, "id int, la double, lo double")
    sizes, most = places._sizes(q, 20.0), 20.0
    assert len(sizes) > 1 and sizes[-1] == most and sizes == sorted(sizes)
    held = max(len(x["_places"]) for x in places.cells(q.filter("i >= 700 and i < 1000"), "lat", "lon", sizes[0]).collect())
    assert held * 2 < max(len(x["_places"]) for x in places.cells(q.filter("i >= 700 and i < 1000"), "lat", "lon", most).collect())
    for crowd in (places.CROWD, 0.002):
        monkeypatch.setattr(places, "CROWD", crowd)
        got = {x["id"]: x["near"] and (x["near"]["far"], x["near"]["i"]) for x in places.with_nearest(p, q, F.col("la"), F.col("lo"), most).collect()}
        for i, la, lo in at:
            best = min((math.sqrt((la - a) * (la - a) + (lo - o) * (lo - o)), k) for k, a, o in spots if a is not None) if la is not None else (99, 0)
            assert got[i] == (best if best[0] <= most else None)
    assert len(places._sizes(q, most)) > 3
