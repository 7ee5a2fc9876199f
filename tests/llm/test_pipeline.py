"""run() of the pipeline against a brute-force version on a small folder of tables."""

import random

import pytest

pytest.importorskip("public_tokenizers")
VOCAB = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "elit", "sed", "do", "eiusmod", "tempor"]


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice("abcdefghij") + r.choice("klmnopqrst") for _ in range(n))


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    passage = prose(7777, 12)
    rows = [(i, prose(i)) for i in range(120)] + [(200 + i, " ".join(x[:3] + "***" for x in prose(i).split())) for i in range(60)]
    rows += [(300, prose(1)), (301, prose(2) + " more"), (302, prose(3, 30) + " " + passage + " " + prose(4, 30)), (303, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows[:180]], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    from pulsegrid.llm import quality

    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"]}
    assert good >= set(range(120)) and not good & set(range(200, 260))
    texts = {i: t or "" for i, t in rows if i in good}
    latest = {}
    for i in sorted(texts):
        latest[texts[i]] = i
    left = {i: t for t, i in latest.items()}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in left.items() if (w := t.split())}
    for i in sorted(left):
        if any(j < i and j in left and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in shingles if i in shingles):
            del left[i]
    left = {i: t for i, t in left.items() if passage not in t}
    assert 300 in left and 301 not in left and 302 not in left and 1 not in left

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5


def test_odd_input(spark, tmp_path):
    """Nulls, repeated rows, very long and empty texts, columns with clashing names, and empty tables."""
    import corpus_pipeline

    long = prose(50, 30_000)
    rows = [(i, prose(i), None if i % 3 else "s") for i in range(30)] + [(None, prose(99), "s")] * 2 + [(5, prose(5), None)] * 3
    rows += [(100, None, None), (101, "", "s"), (102, long, "s"), (103, long + " end", "s")]
    schema = "doc_id bigint, text string, source string, _row int, _id string, _class string, _words int, _text string, _part int"
    full = [(i, t, s, 1, "x", None, 2, "y", 3) for i, t, s in rows]

    def written(name, docs, labels, bench):
        at = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
        return at

    at = written("odd", full, [], [])
    got = corpus_pipeline.run(spark, at).collect()
    assert {r["doc_id"] for r in got} == {*range(30), None, 101, 102}  # 103 is a near copy of 102, 100 an exact one of 101
    assert sum(r["length"] for r in got) == sum({(r["doc_id"], r["doc_tokens"]) for r in got} and {r["doc_id"]: r["doc_tokens"] for r in got}.values())
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    assert corpus_pipeline.run(spark, written("none", [], [(1, 1, 0)], [(1, "a b c")])).count() == 0
    marked = written("marked", full, [(i, 1, 0) for i in range(30)], [(1, prose(3)), (None, None), (2, "")])
    assert 3 not in {r["doc_id"] for r in corpus_pipeline.run(spark, marked).collect()}


def test_near_copies_leave_no_large_tables(spark):
    """Signatures and shingles go before the next stage writes; what classes are made of stays readable."""
    from pathlib import Path

    from pulsegrid.llm import near_dup
    from pulsegrid.llm.common import shared_dir

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"v{i}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = Path(shared_dir(spark).removeprefix("file:").replace("///", "/")) / "pulsegrid"
    large = lambda: {p.name for p in folder.glob("*") if p.name.split("-")[0] in ("signatures", "near", "shingles", "classes", "shared")}
    before = large()
    kept = near_dup.near_classes(docs)
    assert kept.count() == 2 and not large() - before
