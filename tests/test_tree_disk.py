"""What walks over trees leave on disk, and parents against a plain search."""

import os
import random

from pulsegrid.operators import trees


def test_a_walk_leaves_one_table(spark):
    root = spark.sparkContext
    trees.closure(spark.createDataFrame([("t", "a", None)], "tree string, node string, parent string"), "tree", "node", "parent")
    folder = root._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    chain = spark.createDataFrame([("t", str(i), str(i - 1) if i else None) for i in range(200)], "tree string, node string, parent string")
    walked = trees.closure(chain, "tree", "node", "parent")
    assert len(set(os.listdir(folder)) - before) == 1  # eight rounds wrote nine
    assert {int(r["node"]): r["depth"] for r in walked.collect()} == {i: i for i in range(200)}


def test_parents_are_the_latest_earlier_followed(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        for k, u in enumerate(rng.sample(range(40), rng.randint(1, 30))):
            rows.append((f"c{c}", f"u{u}", f"p{c}_{u}", k, rng.randint(0, 15)))
    follows = [(f"u{a}", f"u{b}") for a, b in (rng.sample(range(45), 2) for _ in range(300))]
    of = {}
    for a, b in follows:
        of.setdefault(a, set()).add(b)
    want = {}
    for c, u, _, k, _ in rows:
        earlier = [(t, -o, v) for d, v, _, o, t in rows if d == c and o < k and v in of.get(u, ())]
        first = next(v for d, v, _, o, _ in rows if d == c and o == 0)
        want[c, u] = None if k == 0 else max(earlier)[2] if earlier else first
    a = spark.createDataFrame(rows, "cascade_id string, user_id string, post_id string, ord bigint, timestamp_ms bigint")
    got = trees.parents(a, spark.createDataFrame(follows, "source_id string, target_id string"))
    assert {(r["cascade_id"], r["user_id"]): r["parent"] for r in got.collect()} == want
