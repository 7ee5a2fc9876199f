"""Lines of labelled corpora, read in pieces."""

from pulsegrid.sources import corpora


def test_lines_of_many_pieces_stay_paired(spark, tmp_path):
    at = tmp_path / "mood"
    for name in ("test_text.txt", "test_labels.txt"):
        (at / name).mkdir(parents=True)
    texts = [f"  text {i}" + ("  goes on " if i % 7 == 0 else "") + "." * (i % 90) for i in range(1500)]
    texts[3] = texts[900] = ""
    labels = [str(i % 5) if i % 11 else "none" for i in range(1500)]
    for name, rows, cuts in (("test_text.txt", texts, (0, 700, 701, 1500)), ("test_labels.txt", labels, (0, 40, 1500))):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            (at / name / f"part-{k:05d}.txt").write_text("".join(x + "\n" for x in rows[a:b]), encoding="utf-8")
    (at / "mapping.txt").write_text("0 bad\n1 good one\nnone here\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert corpora.numbered_lines(spark, str(at / "test_text.txt")).rdd.getNumPartitions() > 4
        got = {r["n"]: (r["text"], r["label_id"], r["label"]) for r in corpora.labelled(spark, str(tmp_path), "mood", "test").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    name = {0: "bad", 1: "good one"}
    assert got == {i: (texts[i].strip(), i % 5, name.get(i % 5, f"label_{i % 5}")) for i in range(1500) if i % 11}


def test_lines_are_written_compressed(spark):
    """A table of posts is written in its files' own format: its lines must not take the disk as they stand."""
    import os

    from pyspark.sql import functions as F

    from pulsegrid.plans.corpora_queries import _as_lines

    rows = spark.range(50_000).select(F.concat_ws("\t", F.lit("u1"), F.col("id").cast("string"), F.repeat(F.lit("some prose, "), 20)).alias("value"))
    at = _as_lines(spark, rows, "test")
    folder = at.removeprefix("file:")
    files = [f"{folder}/{x}" for x in os.listdir(folder) if x.startswith("part-")]
    assert len(files) > 2 and sum(map(os.path.getsize, files)) < 50_000 * 100
    assert corpora.lines(spark, at).exceptAll(rows).isEmpty() and corpora.lines(spark, at).count() == 50_000
