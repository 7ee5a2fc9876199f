"""Languages, trained scorers, text vectors and topics by density: brute force, held-out accuracy, odd input."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import analytics, languages, sentiment, text_models, text_vectors, topics, vectors

DATA = Path("/root/testdata/sf0.01")
SAY = {"en": "the ship and the storm that was over there with all of them", "fr": "le bateau et la tempête qui était là avec tout le monde", "de": "das schiff und der sturm der mit allen über das meer ging"}


def said(lang, seed, n=12):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(SAY[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(f"{lang}{i}", lang, said(lang, i)) for lang in SAY for i in range(30)]
    rows += [("null", "en", None), ("empty", "fr", ""), ("digits", "de", "123 https://x.org #tag @me"), ("two", "en", "ab"), ("none", None, said("en", 99)), ("caps", "fr", "ÉTÉ 😀 Là-bas 𝐀")]
    return spark.createDataFrame([(*r, "x", [1]) for r in rows], "id string, lang string, text string, _model string, b array<int>")


def test_languages_by_hand(spark, spoken):
    """The same sums in plain Python, on the letters that Spark gives."""
    model = languages.train(spoken)
    rows = languages.detected(spoken, model).withColumn("_l", languages.letters(F.col("text"))).collect()
    grams = {r["id"]: [(ord(t[i]) * 961 + ord(t[i + 1]) * 31 + ord(t[i + 2])) % languages.BUCKETS for i in range(len(t) - 2)] if len(t := r["_l"]) >= 5 else [] for r in rows}
    counts, docs = defaultdict(Counter), Counter()
    for r in rows:
        if r["lang"] and grams[r["id"]]:
            counts[r["lang"]].update(grams[r["id"]])
            docs[r["lang"]] += 1
    for r in rows:
        got = r["language"]
        if not grams[r["id"]]:
            assert (got["lang"], got["confidence"], got["probabilities"]) == ("en", 0.0, {})
            continue
        logs = {k: math.log(docs[k] / sum(docs.values())) + sum(math.log((c[b] + 1) / (sum(c.values()) + languages.BUCKETS)) for b in grams[r["id"]]) for k, c in counts.items()}
        top = max(logs.values())
        total = sum(math.exp(x - top) for x in logs.values())
        assert got["lang"] == max(sorted(logs), key=logs.get) and got["confidence"] == pytest.approx(1 / total)
        assert got["probabilities"] == pytest.approx({k: math.exp(x - top) / total for k, x in logs.items()})
    assert {r["id"] for r in rows if not grams[r["id"]]} == {"null", "empty", "digits", "two"}
    assert {r["language"]["lang"] for r in languages.detected(spoken, languages.train(spoken.limit(0))).collect()} == {"en"}
    assert languages.detected(spoken.limit(0), model).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_languages_held_out(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    model = languages.train(docs.filter("doc_id % 5 != 0"))
    out = languages.detected(docs.filter("doc_id % 5 = 0"), model).select((F.col("language.lang") == F.col("lang")).cast("int").alias("ok"))
    assert out.agg(F.avg("ok")).first()[0] >= 0.95


def test_scorer(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3))
    good, bad = ["sunny", "lovely", "great"], ["awful", "dreadful", "nasty"]
    rows = [(i, " ".join([word() for _ in range(8)] + [r.choice(good if i % 2 else bad)] * 2), "positive" if i % 2 else "negative") for i in range(300)]
    rows += [(1000, None, "neutral"), (1001, "", "neutral"), (1002, "plain table", "neutral"), (1003, "lovely", None)] + [(2000 + i, f"plain {word()} table chair", "neutral") for i in range(80)]
    t = spark.createDataFrame([(*x, "m") for x in rows], "id int, text string, label string, model string")
    held = F.col("id") % 5 == 0
    metrics = {m["label"]: m for m in text_models.held_out_metrics(t.filter("label is not null"), held, features=4096).collect()}
    assert metrics["positive"]["accuracy"] >= 0.9 and set(metrics) == {"positive", "negative", "neutral"}
    model = text_models.train(t.filter(~held), features=4096)
    text_models.save(model, str(tmp_path / "m"))
    a = text_models.scored(t, model, name="found").collect()
    b = text_models.scored(t, str(tmp_path / "m"), name="found").collect()
    assert a == b and a[0].asDict().keys() == {"id", "text", "label", "model", "found"} and len(a) == len(rows)
    assert all(abs(sum(x["found"]["probabilities"].values()) - 1) < 1e-9 for x in a)
    columns = {"negative": "s_negative", "neutral": "s_neutral", "positive": "s_positive", "unknown": "irony"}
    full = analytics.decided(text_models.probabilities(t, str(tmp_path / "m"), columns))
    task = {m["label"]: m["f1"] for m in analytics.evaluated(full.filter(held & F.col("label").isNotNull()), "sentiment", "test").collect()}
    assert min(task.values()) > 0.8
    assert text_models.scored(t.limit(0), model).count() == 0
    pairs = text_models.train(t.filter(~held), features=1024, pairs=True)
    assert sentiment.classification(text_models.scored(t.filter("label is not null"), pairs).select(F.col("label").alias("truth"), F.col("model.label").alias("predicted"))).first()["accuracy"] > 0.8


THEMES = [[f"{t}{i}" for i in range(40)] for t in ("sea", "sun", "ice", "oak")]


def theme_rows(seed=6, each=60, n=40):
    r = random.Random(seed)
    return [(k * 1000 + i, " ".join(r.choice(words) for _ in range(n)), k) for k, words in enumerate(THEMES) for i in range(each)]


@pytest.fixture(scope="module")
def themed(spark):
    return spark.createDataFrame([(*x, "v") for x in theme_rows()], "id int, text string, theme int, vector string")


def test_factorisation(spark, themed):
    """The matrix by hand, its largest eigenvectors by numpy; the model spans the same space."""
    k, window = 4, 3
    model = text_vectors.fit(themed, dimensions=k, window=window, least=2, rounds=30)
    texts = [re.findall(r"\w+", t.lower()) for _, t, _ in theme_rows()]
    n = Counter(w for t in texts for w in t)
    order = sorted((w for w in n if n[w] >= 2), key=lambda w: (-n[w], w))
    assert model.words == order
    at = {w: i for i, w in enumerate(order)}
    c = np.zeros((len(order), len(order)))
    for t in texts:
        own = [at[w] for w in t if w in at]
        for step in range(1, window + 1):
            for i, j in zip(own, own[step:], strict=False):
                c[i, j] += 1
                c[j, i] += 1
    rows = c.sum(axis=1)
    with np.errstate(divide="ignore"):
        m = np.maximum(np.log(c * (rows**0.75).sum() / (rows[:, None] * rows[None] ** 0.75)), 0)
    m = (m + m.T) / 2
    values, vecs = np.linalg.eigh(m)
    best = np.argsort(-np.abs(values))[:k]
    want = vecs[:, best] * np.sqrt(np.abs(values[best]))
    assert np.allclose(model.vectors @ model.vectors.T, want @ want.T, atol=1e-3)


def test_vectors_of_texts(spark, themed):
    model = text_vectors.fit(themed, dimensions=16)
    rows = theme_rows()
    copies = [(-1 - i, t + " extra" if i % 2 else " ".join(t.split()[:-2]), k) for i, t, k in rows[::10]]
    odd = [(9000, None, 0), (9001, "", 0), (9002, "unheard of", 0), (9003, rows[0][1].upper(), 0)]
    out = text_vectors.transform(spark.createDataFrame([(*x, "v") for x in rows + copies + odd], themed.schema), model)
    assert out.columns == ["id", "text", "theme", "vector"]
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert [got[i] is None for i in (9000, 9001, 9002, 9003)] == [True, True, True, False] and got[9003] == pytest.approx(got[rows[0][0]])
    v = {i: np.array(x) for i, x in got.items() if x is not None}
    near = [v[-1 - i] @ v[i] for i, _, _ in rows[::10]]
    r = random.Random(7)
    far = [v[a[0]] @ v[b[0]] for a, b in ((r.choice(rows), r.choice(rows)) for _ in range(300)) if a[2] != b[2]]
    same = [v[a[0]] @ v[b[0]] for a, b in ((r.choice(rows), r.choice(rows)) for _ in range(300)) if a[2] == b[2] and a != b]
    assert min(near) > max(far) and np.mean(near) > np.mean(same) > np.mean(far) + 0.3
    empty = text_vectors.fit(themed.limit(0))
    assert empty.words == [] and text_vectors.transform(themed, empty).filter("vector is not null").count() == 0
    single = text_vectors.fit(spark.createDataFrame([("a",), ("a",), ("a",)], "text string"))
    assert single.words == ["a"]


def test_from_text_to_topic_persona_and_drift(spark, themed):
    model = text_vectors.fit(themed, dimensions=16)
    labelled = topics.fit_by_density(themed, "id", distance=0.3, least=4, model=model)
    by = {(r["theme"], r["topic"]): r["n"] for r in labelled.groupBy("theme", "topic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {t: k for k, t in by if t >= 0}
    assert len(found) == 4 and sum(n for (k, t), n in by.items() if t >= 0) >= 200 and len({k for k, t in by if t >= 0}) == 4
    assert {r["topic"] for r in topics.fit_by_density(themed.limit(2), "id").collect()} == {0}
    words = topics.top_words(labelled.withColumn("text", F.regexp_replace("text", r"\d+", "")), 1)
    assert {r["term"].split()[0] for r in words.filter("topic >= 0").collect()} == {"sea", "sun", "ice", "oak"}
    known = text_vectors.vectors_of(model, {"sailor": "sea1 sea2 sea3", "skier": "ice1 ice2 ice9", "nobody": "unheard"}, spark)
    assert set(known) == {"sailor", "skier"}
    who = text_vectors.transform(themed, model).withColumn("who", vectors.persona(F.col("theme").cast("string") + 1000, F.col("vector"), known))
    right = who.filter("theme in (0, 2)").select((F.col("who.persona") == F.when(F.col("theme") == 0, "sailor").otherwise("skier")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.95
    v = text_vectors.transform(themed, model)
    assert vectors.centroid_drift(v.withColumn("f", F.col("theme") > 1), "f", vec_col="vector").first()["is_semantic"]
    assert not vectors.centroid_drift(v.withColumn("f", F.col("id") % 2 == 1), "f", vec_col="vector").first()["is_semantic"]


def test_pairs_and_vectors_in_bounded_memory(spark, monkeypatch):
    """What a worker holds does not grow with the words of a batch; pieces of any size give the same pairs and vectors."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(4)
    texts = [[f"w{i}" for i in r.integers(0, 50, n)] for n in (9000, 3, 0, 1, 700, 200_000)]
    names = [f"w{i}" for i in range(49)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string()))], names=["w"])

    def pairs():
        got = Counter()
        for out in text_vectors._pairs(pa.array(names, pa.large_string()), 3)(iter([batch, batch])):
            for b, k, c in zip(*out.columns, strict=True):
                for key, count in zip(np.cumsum(text_vectors._unpacked(k.as_py())).tolist(), text_vectors._unpacked(c.as_py()).tolist(), strict=True):
                    got[key // 49 * text_vectors.BLOCKS + b.as_py(), key % 49] += count
        return got

    tracemalloc.start()
    whole = pairs()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000
    want = Counter()
    for t in texts:
        own = [int(w[1:]) for w in t if w != "w49"]
        for step in (1, 2, 3):
            for i, j in zip(own, own[step:], strict=False):
                want[i, j] += 2
                want[j, i] += 2
    assert whole == want
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string")
    model = text_vectors.Model(names, np.full(49, 1 / 49), r.standard_normal((49, 4)))
    found = lambda: {x["id"]: x["vector"] for x in text_vectors.transform(rows, model).collect()}
    vectors_whole = found()
    monkeypatch.setattr(text_vectors, "STEP", 64)
    monkeypatch.setattr(text_vectors, "GATHER", 100)
    assert pairs() == want
    small = found()
    assert small[2] is None and all(small[i] == pytest.approx(vectors_whole[i]) for i in (0, 1, 3, 4, 5) if vectors_whole[i])
