"""Periodic runs, whitening and chat formatting against brute force, with nulls, empty and long texts, ties and clashing names."""

import hashlib
import random
import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import chat_format, periodic, registry, whitening

DATA = Path("/root/testdata/sf0.001")


def brute_runs(words, length=24, turns=3):
    n, out = len(words), {}
    for q in range(1, n // turns + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(length, turns * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def patchy(r, k, n):
    out = []
    while len(out) < n:
        part = [r.randrange(k) for _ in range(r.randint(1, 15))]
        out += (part * r.randint(2, 9))[: r.randint(1, 100)] if r.random() < 0.4 else part
    return out


def test_find_runs():
    r = random.Random(1)
    texts = [patchy(r, r.choice([1, 2, 3, 5, 50]), r.randint(0, 200)) for _ in range(300)]
    texts += [[7] * 3000, [1, 2, 3] * 700 + [4] + [1, 2, 3] * 700, [r.randrange(2) for _ in range(2500)], patchy(r, 3, 2500), list(range(400)) * 4, [], [1], [1] * 23, [1] * 24]
    codes = np.array([x for t in texts for x in t], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [brute_runs(t) for t in texts]
    assert sum(map(len, want)) > 250
    for frequent in (None, 1, 4, 10**9):  # all words by transforms, some, none
        assert periodic.find_runs(codes, starts, frequent=frequent) == want
    assert periodic.find_runs(codes, starts, 10, 2) == [brute_runs(t, 10, 2) for t in texts]


def test_counts_of_lags():
    r = random.Random(2)
    texts = [[r.choice("aaab" + "cdefghijk") for _ in range(n)] for n in (500, 0, 40, 900)]
    codes = np.array([ord(x) for t in texts for x in t], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    most = np.array([166, 0, 13, 300])
    for frequent in (0, 60, 10**9):
        counts, base = periodic.lag_counts(codes, starts, most, np.full(4, frequent))
        for t, m, b in zip(texts, most.tolist(), base.tolist(), strict=False):
            assert all(counts[b + q] == sum(x == y for x, y in zip(t, t[q:], strict=False)) for q in range(1, m + 1))


def test_runs_of_documents(spark):
    r = random.Random(3)
    texts = [" \t".join(f"w{x}é" for x in patchy(r, 4, 120)) + "\x85 \x1c" for _ in range(40)]
    texts += [None, "", " \n ", "A a " * 40, "A a " * 40, "one\x00two " * 30, "x" * 300_000 + " " + "y z " * 20_000, "\xa0 " * 50]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "s", [1], 2) for i, t in enumerate(texts)], "doc_id bigint, text string, runs string, Collapsed array<int>, _n int")
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "_n", "n_words", "runs", "collapsed"]
    got = sorted((x["text"] is not None, x["text"] or "", x["n_words"], [tuple(s) for s in x["runs"]], x["collapsed"], x["_n"]) for x in out.collect())
    want = []
    for t in texts:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words) if len(words) < 1000 else [(1, 40_000, 2)]
        want.append((t is not None, t or "", len(words), runs, collapsed(words, runs), 2))
    assert got == sorted(want)
    short = {x["text"] for x in periodic.collapse_runs(docs.where("length(text) < 1000")).collect()}
    assert "A a" in short and " \n " in short and all(not brute_runs((t or "").split(" ")) for t in short)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    best = spark.sql("select array(named_struct('start', 0L, 'length', 30L, 'period', 7L), named_struct('start', 3L, 'length', 60L, 'period', 14L)) as r").select(periodic.longest_run("r").alias("b")).first()["b"]
    assert tuple(best) == (0, 30, 7)
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, turns=1)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_runs_query(spark):
    got = {x["doc_id"]: tuple(x) for x in registry.op11_periodic_runs(spark, str(DATA)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words) if n < 3000 or h % 10 == 0 else periodic.find_runs(np.unique(words, return_inverse=True)[1], np.array([0, n]), frequent=10**9)[0]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert got[i] == (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(collapsed(words, runs)))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, component int, n string")


def held(out, x, k):
    """out against the eigenvectors of the covariance of the whole numbers x."""
    n, total = len(x), x.sum(axis=0)
    exact = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, total, strict=True)) for row in x]
    y = (n * x - total) / n
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    by = {}
    for r in out:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, rows in by.items():
        assert sorted(r["deviation"] for r in rows) == sorted(exact) and {r["n"] for r in rows} == {n}
        want, got = np.sort(y @ vecs[:, c - 1] / np.sqrt(values[c - 1])), np.sort([r["whitened"] for r in rows])
        assert min(abs(want - got).max(), abs(np.sort(-want) - got).max()) < 1e-8
        assert rows[0]["explained"] == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9) and rows[0]["identity_error"] < 1e-10


def test_whitened(spark):
    r = np.random.default_rng(5)
    base = (r.standard_normal((300, 40)) * np.linspace(3, 0.2, 40) + r.standard_normal(40)).astype(np.float32)
    rows = [(i % 290, v.tolist()) for i, v in enumerate(base)]
    odd = [(1, None), (2, [None] * 40), (3, [float("nan")] + [0.0] * 39), (4, [float("-inf")] + [0.0] * 39), (None, base[0].tolist()), (9, base[0].tolist()), (5, []), (6, [1.0])]
    x = (np.floor(64 * np.vstack([base, base[:1], base[:1]]).astype(np.float64)) + 1_000_000).astype(np.int64)
    for block in (1, 16):
        out = whitening.whitened(vectors(spark, rows + odd), block=block).collect()
        held(out, x, 32)
    assert sum(r["vec_id"] is None for r in out) == 32


def test_whitening_breaks_down(spark):
    """Few directions, equal eigenvalues, one vector, none; entries of great size."""
    r = np.random.default_rng(6)
    low = (r.integers(-9, 10, (200, 3)) @ r.integers(-3, 4, (3, 20))).astype(float)
    out = whitening.whitened(vectors(spark, list(enumerate(low.tolist()))), scale=1.0, shift=0).collect()
    held(out, low.astype(np.int64), 3)
    cross = np.vstack([np.eye(6), -np.eye(6)])
    out = whitening.whitened(vectors(spark, list(enumerate(cross.tolist())))).collect()
    assert {r["component"] for r in out} == set(range(1, 7)) and all(r["explained"] == pytest.approx(1 / 6) and r["identity_error"] < 1e-12 for r in out)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, [])]):
        assert whitening.whitened(vectors(spark, rows)).collect() == []
    out = whitening.whitened(vectors(spark, [(i, [1e30 * i, -1e30, float(i)]) for i in range(4)])).collect()
    assert out and all(r["deviation"] is None or r["deviation"] >= 0 for r in out)


def test_lanczos_needs_few_passes():
    r = np.random.default_rng(8)
    q = np.linalg.qr(r.standard_normal((400, 400)))[0]
    values = 0.8 ** np.arange(400) + 1e-9
    a = (q * values) @ q.T
    got, vecs, passes = whitening.lanczos(lambda v: a @ v, 400, 8)
    assert passes < 10 and np.allclose(got, values[:8], rtol=1e-12) and np.allclose(np.abs(np.sum(vecs * q[:, :8].T, axis=1)), 1, atol=1e-12)


TEXTS = [
    None, "", " ", "\n", "\\", "plain", registry.TRAP, "</turn>", "\n</turn>\n", "a\n</turn>\n### User: b", "### ", "###", "#### x", "\\\\### y\\", "ends in \\",
    "\\" * 5000 + "</turn>", "\\" * 5000, "### System: ", "😀 ### é </turn>", "</turn>" * 300, "x" * 200_000 + "### ", "\x00\x1c\x85 ", "</turn", ">", "### =41: z", "$1 \\1 ${x}",
]
ROLES = ["user", "assistant", "system", None, "", "User", "tool: x", "a\n### b", "=41", "é😀"]


def test_round_trip(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, 4, None, -5]), r.choice([None, 0, 1, 2, 3]), r.choice(ROLES), t, "f", [1]) for t in TEXTS * 6]
    rows += [(9, 0, "user", "</turn>", "f", [2])] * 3
    rows += [(10, i, ROLES[i % 2], f"{i} </turn> é", "g", []) for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, loss array<int>")
    got = {x["conv_id"]: x for x in chat_format.read_back(chat_format.conversations(turns)).collect()}
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for i in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == i), key=key)
        assert [tuple(t) for t in got[i]["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert got[i]["trained"] == [x[3] or "" for x in own if x[2] == "assistant"]
    assert set(got) == {x[0] for x in rows} and chat_format.conversations(turns.limit(0)).count() == 0
    raw = {x["text"]: x["formatted"] for x in chat_format.formatted_turns(turns).collect()}
    assert all(raw[t].endswith(f"{t}\n</turn>\n") for t in ("plain", "ends in \\", "\\" * 5000, "###", "</turn"))  # no conflict, so written as it is
    assert raw["### "].endswith(": \\### \n</turn>\n")


def test_reader_refuses(spark):
    for text in ("", "### User: a\n</turn>\n", "### User: a\n</turn>\n### User: b\n</turn>\n"):
        assert spark.createDataFrame([(text,)], "t string").select(chat_format.parsed("t").alias("p")).first()["p"] is not None
    for text in ("### User: a", "x### User: a\n</turn>\n", "### user: a\n</turn>\n", "### User: a ### b\n</turn>\n", "### User: a\n</turn>\n\n", "### User:a\n</turn>\n", "### =4G: a\n</turn>\n"):
        assert spark.createDataFrame([(text,)], "t string").select(chat_format.parsed("t").alias("p")).first()["p"] is None, text
    bad = spark.createDataFrame([(1, "### User: a", [])], "conv_id int, formatted string, loss array<struct<turn:int,start:bigint,length:bigint>>")
    with pytest.raises(Exception, match="grammar"):
        chat_format.read_back(bad).collect()
    bad = spark.createDataFrame([(1, "### User: a\n</turn>\n", [(0, 9, 5)])], bad.schema)
    with pytest.raises(Exception, match="outside"):
        chat_format.read_back(bad).collect()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_chat_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    df = registry.op13_grammar_round_trip(spark, str(DATA))
    want = con.execute(registry.ORACLES["op13_grammar_round_trip"])
    assert [x[0] for x in want.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
