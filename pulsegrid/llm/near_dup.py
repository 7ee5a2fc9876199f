"""Near duplicates by ProbMinHash over weighted shingles, banding, exact verification and linked classes.

Signature: every shingle (five words) of weight w is a Poisson process of rate w whose arrivals fall on random
registers; a register keeps its earliest arrival's shingle. Two texts agree on a register with the probability
Jaccard similarity of their weights. Arrivals are drawn in rounds, the n-th of all shingles together, and a shingle
stops once its next arrival is later than the latest register: few shingles have a second round.

Exact copies are one node (half of the text's sha256). Nodes that agree on all registers of a band are in a bucket;
two nodes of a bucket are candidates. They are settled in two steps:

1. Rounds of heads. Every class (a node at first) of a bucket meets the bucket's head, the class that comes first by
   a hash order of the round, and of all heads it could meet only the first one: a pair a class and round, so a group
   of near copies of any size has as many pairs as nodes. Verified pairs contract classes. As each one leads to an
   earlier class, they are trees, and pointers are doubled to find the roots. Buckets hold one row for each class. The
   first round looks at FIRST_BANDS bands only. Rounds go on while most pairs are links (YIELD): they are there to make
   large groups small, and what they leave goes to the second step.
2. What is left are buckets of several classes. In one of at most BLOCK nodes all signatures are compared, and pairs
   of different classes that agree on LEAST_AGREEMENT of the registers are verified, in the first band they share. The
   nodes of larger ones are compared by an exact filter in place of all pairs: in one order of all shingles, rare ones
   first, a linked pair has a common shingle that lies in the first part (a mass of (1 - s) / (1 + s), see ``prefix``)
   of one and in the first 1 - s of the other. So only nodes that share such a shingle are compared, each two classes
   until a link is found; texts that share a long passage and differ in the rest share none. A shingle of more than
   BLOCK nodes is cut into blocks, each by itself at first; links contract classes, and then two blocks meet in a
   task, but those of one class. Large buckets come before small ones, which make no pairs of what is one class.

Both steps verify on all shingles of both texts (as 40-bit hashes). Linked: probability Jaccard of 0.8 or more; a
candidate whose sets have a Jaccard of 0.8 or more is linked too. Weight of a shingle: 1 + ln(its count) / 4, so a
repeated passage counts a little more, and the two measures seldom differ.

Defined cases: a null text is an empty one; texts without words are linked with equal texts only; a text of fewer
than five words has one shingle; repeated rows are copies; null ids are carried, and a class of null ids only has a
null class_id; an empty table gives an empty table; extra columns are carried by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bits, filter_power, free, key_filter, maybe_in, shared_dir, small_batches, stored, text_of
from .textvec import Words, five, from_five, lean, lean_group, mix, run_hashes, slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Bands of the first round, in which every node is a class of its own.
FIRST_BANDS = 4
#: Another round of heads follows if so large a share of the pairs were links.
YIELD = 2 / 3
#: A pair whose signatures agree on a smaller share goes no further: four standard deviations below 0.8.
LEAST_AGREEMENT = 0.65
#: Nodes of a block, two of which are compared in a task; rows of a task that compares several short lists.
BLOCK, TASK_ROWS = 256, 2048
#: Pairs whose signatures are compared at a time.
PAIRS_AT_ONCE = 4096
#: Bytes and rows of text that are worked on at a time: a row has REGISTERS times and values, 16 bytes each.
SIGN_CHARS, SIGN_ROWS = 500_000, 4_096
#: Counters of shingles, which give the order of ``prefix``, and those of a piece that travels as a row.
SKETCH, PIECE = 1 << 18, 1 << 12
_SEED = np.uint64(0x5851F42D4C957F2D)
_TEXT_BITS, _HASH_BITS = 24, 40


def weighted_shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (40-bit hashes) of each text in ascending order, their weights, and where each text's begin."""
    hashes, starts = run_hashes(Words(texts, lower=True), n)
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    keys = np.sort(owner << np.uint64(_HASH_BITS) | hashes >> np.uint64(_TEXT_BITS))  # at most BATCH_ROWS texts
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    per_text = np.bincount((keys >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=len(starts) - 1)
    return keys & np.uint64((1 << _HASH_BITS) - 1), 1 + np.log(counts) / 4, np.concatenate([[0], np.cumsum(per_text)])


def signatures(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """A row of m 32-bit values for each text; texts without shingles have zeros."""
    n = len(starts) - 1
    time, value = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    alive, now, k = np.arange(len(shingles)), np.zeros(len(shingles)), 0
    while len(alive):
        k += 1
        draw = mix(shingles[alive] + np.uint64(2 * k * int(_SEED) & 0xFFFFFFFFFFFFFFFF))
        now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights[alive]
        slot = owner[alive] * m + (mix(draw ^ _SEED) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(now < time[slot])
        np.minimum.at(time, slot[early], now[early])
        won = early[now[early] == time[slot[early]]]
        value[slot[won]] = shingles[alive[won]]
        going = now < time.reshape(n, m).max(axis=1)[owner[alive]]
        alive, now = alive[going], now[going]
    return (mix(value.reshape(n, m)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two weight vectors over the same elements: sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(y > 0, x / y, np.inf)
    order = np.argsort(ratio, kind="stable")
    rx, below_y = ratio[order], np.concatenate([[0], np.cumsum(y[order])])
    above_x = x.sum() - np.concatenate([[0], np.cumsum(x[order])])
    at = np.searchsorted(rx, ratio[both], "left")  # those before i in order have a smaller ratio: y_j / y_i is larger
    return float((1 / (above_x[at] / x[both] + below_y[at] / y[both])).sum())


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> bool:
    """Whether two texts, as (ascending shingles, weights), are similar enough."""
    (s, x), (t, y) = a, b
    if not len(s) or not len(t):
        return False
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    same = t[at] == s
    common = int(np.count_nonzero(same))
    if common >= least * (len(s) + len(t) - common):
        return True
    # Shares of the weight that they have in common bound the probability Jaccard, see ``prefix``.
    of_x, of_y = x[same].sum() / x.sum(), y[at[same]].sum() / y.sum()
    if of_x * of_y < (least - 1e-9) * (1 - (1 - of_x) * (1 - of_y)):
        return False
    every = np.union1d(s, t)
    in_x, in_y = np.zeros(len(every)), np.zeros(len(every))
    in_x[np.searchsorted(every, s)], in_y[np.searchsorted(every, t)] = x, y
    return probability_jaccard(in_x, in_y) >= least


@lean
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("_text"), SIGN_CHARS, SIGN_ROWS):
            shingles, weights, starts = weighted_shingles(batch.column("_text").slice(a, b - a))
            signature = signatures(shingles, weights, starts)
            empty = np.diff(starts) == 0
            blobs = [None if e else s.tobytes() for e, s in zip(empty, signature, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_node").slice(a, b - a), pa.array(blobs, pa.binary())], names=["_node", "_sig"]
            )


def _buckets(batch: pa.RecordBatch, bands: int) -> np.ndarray:
    """A row of buckets for each row's signature, one for each band."""
    sig = np.frombuffer(b"".join(batch.column("_sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)[:, :bands].astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), sig.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return h.view(np.int64)


def _banded(bands: int, shared: Bits | None, columns: list[str]):
    """A row for each bucket of a signature, of those that are in shared."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _buckets(batch, bands)
            row, band = np.nonzero(shared.has(h) if shared else np.ones(h.shape, bool))
            kept = [batch.column(c).take(pa.array(row)) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(h[row, band]), *kept], names=["_bucket", *columns])

    return rows


def _short(batches: Iterator[pa.RecordBatch], shared: Bits) -> Iterator[pa.RecordBatch]:
    """Rows of _banded with the number of the band and the signature."""
    for batch in batches:
        h = _buckets(batch, BANDS)
        row, band = np.nonzero(shared.has(h))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[row, band]), pa.array(band.astype(np.int32)), batch.column("_class").take(at), batch.column("_node").take(at), batch.column("_sig").take(at)],
            names=["_bucket", "_band", "_class", "_node", "_sig"],
        )


def _short_rows(shared: Bits):
    return lean(lambda batches: _short(batches, shared))


@lean_group
def _agreeing(rows: pa.Table) -> pa.Table:
    """(_class, _to, _a, _b): pairs of a bucket whose signatures agree, each in the first band that it shares."""
    bucket, band = rows.column("_bucket").to_numpy(), rows.column("_band").to_numpy()
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(c, len(number)) for c in rows.column("_class").to_pylist()])
    sig = np.frombuffer(b"".join(rows.column("_sig").to_pylist()), np.uint32).reshape(-1, REGISTERS)
    order = np.argsort(bucket, kind="stable")
    found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    waiting: list[np.ndarray] = []

    def compare() -> None:
        a, b = np.concatenate(waiting, axis=1)
        same = sig[a] == sig[b]
        first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        found.append(np.stack([a, b])[:, (same.mean(axis=1) >= LEAST_AGREEMENT) & (first == band[a])])
        waiting.clear()

    held = 0
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        for i in range(len(own) - 1):
            later = own[i + 1 :][of[own[i + 1 :]] != of[own[i]]]
            waiting.append(np.stack([np.full(len(later), own[i]), later]))
            held += len(later)
            if held > PAIRS_AT_ONCE:
                compare()
                held = 0
    if waiting:
        compare()
    a, b = (pa.array(x) for x in np.concatenate(found, axis=1))
    columns = {"_class": ("_class", a), "_to": ("_class", b), "_a": ("_node", a), "_b": ("_node", b)}
    return pa.table({k: rows.column(c).take(at).combine_chunks() for k, (c, at) in columns.items()})


def _touching(shared: Bits):
    """Rows that have a bucket in shared."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.has(_buckets(batch, BANDS)).any(axis=1)))

    return rows


@lean
def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("_text"), SIGN_CHARS, SIGN_ROWS):
            shingles, weights, starts = weighted_shingles(batch.column("_text").slice(a, b - a))
            ranges, w = list(zip(starts[:-1], starts[1:], strict=True)), weights.astype(np.float32)
            blobs = [five(shingles[i:j]) for i, j in ranges]
            plain = [b"" if (w[i:j] == 1).all() else w[i:j].tobytes() for i, j in ranges]  # all of weight 1: nothing
            yield pa.RecordBatch.from_arrays(
                [batch.column("_node").slice(a, b - a), pa.array(blobs, pa.binary()), pa.array(plain, pa.binary())],
                names=["_node", "_shingles", "_weights"],
            )


def _weighted(batch: pa.RecordBatch | pa.Table, i: int, k: str = "") -> tuple[np.ndarray, np.ndarray]:
    s = from_five(batch.column(f"_shingles{k}")[i].as_py())
    w = np.frombuffer(batch.column(f"_weights{k}")[i].as_py(), np.float32)
    return s, w.astype(np.float64) if len(w) else np.ones(len(s))


def _verified(least: float):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [linked(_weighted(batch, i, "_a"), _weighted(batch, i, "_b"), least) for i in range(batch.num_rows)]
            yield batch.select(["_class", "_to"]).filter(pa.array(same, pa.bool_()))

    return rows


def prefix(shingles: np.ndarray, weights: np.ndarray, common: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """Places of a text's first shingles, rare ones (by the counters ``common``) first, and how many are its core.

    Let a and b be the shares of the weight of x and of y on shingles that the other lacks. The probability Jaccard is
    at most (1 - a)(1 - b) / (1 - ab), and so is the Jaccard of the sets with shares of the counts. If it is s or
    more, neither a nor b is over 1 - s, and one of them is not over (1 - s) / (1 + s). Say a. If the core of x (the
    first shingles that weigh more than that share) ends before the first part of y (more than 1 - s) does, it has a
    shingle of y, which lies in y's part; else y's part has one of x, which lies in x's core. Both parts are as long
    as either measure asks.
    """
    order = np.lexsort((shingles, common[(shingles % np.uint64(len(common))).astype(np.int64)]))
    by_count = np.arange(1, len(order) + 1) / len(order)
    by_weight = np.cumsum(weights[order]) / weights.sum()

    def ends(share: float) -> int:
        return min(len(order), 1 + max(int(np.searchsorted(m, share + 1e-6, "right")) for m in (by_count, by_weight)))

    return order[: ends(1 - least)], ends((1 - least) / (1 + least))


@lean
def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have shingles of each counter: a row for each PIECE of counters."""
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for blob in batch.column("_shingles").to_pylist():
            np.add.at(total, (from_five(blob) % np.uint64(SKETCH)).astype(np.int64), 1)
    pieces = total.reshape(-1, PIECE)
    some = np.flatnonzero(pieces.any(axis=1))
    part = TaskContext.get().partitionId() % 64
    yield pa.RecordBatch.from_pydict(
        {"_part": pa.array([part] * len(some), pa.int32()), "_piece": pa.array(some.astype(np.int32)), "_n": pa.array([p.tobytes() for p in pieces[some]], pa.binary())}
    )


def _summed(rows: pa.Table) -> pa.Table:
    n = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("_n"))
    return pa.table({"_piece": rows.column("_piece")[:1], "_n": pa.array([n.tobytes()], pa.binary())})


def _sketch(texts: DataFrame) -> Broadcast:
    """Counters of the shingles of all texts, SKETCH of them: 2 MiB. They are summed in two steps, as tasks may be many."""
    parts = texts.select("_shingles").mapInArrow(_counters, "_part int, _piece int, _n binary")
    half = parts.groupBy("_part", "_piece").applyInArrow(_summed, "_piece int, _n binary")
    total = np.zeros(SKETCH, np.int64)
    for r in half.groupBy("_piece").applyInArrow(_summed, "_piece int, _n binary").collect():  # at most SKETCH / PIECE rows
        total[r["_piece"] * PIECE : (r["_piece"] + 1) * PIECE] = np.frombuffer(bytes(r["_n"]), np.int64)
    return texts.sparkSession.sparkContext.broadcast(total)


def _first_shingles(common: Broadcast, least: float, shared: Bits | None):
    """(_token, _node, _class, _core): the first shingles of each text, of those that are in shared."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, core, row = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                shingles, weights = _weighted(batch, i)
                at, n = prefix(shingles, weights, common.value, least)
                keep = shared.has(shingles[at].view(np.int64)) if shared else np.ones(len(at), bool)
                tokens.append(shingles[at][keep])
                core.append((np.arange(len(at)) < n)[keep])
                row.append(np.full(int(keep.sum()), i))
            row = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), batch.column("_node").take(row), batch.column("_class").take(row), pa.array(np.concatenate(core))],
                names=["_token", "_node", "_class", "_core"],
            )

    return rows


def _tile_links(least: float):
    """Links (_class, _to) between classes: nodes that share a shingle, one of them in its core, until links join them."""

    @lean_group
    def rows(tile: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        named = tile.column("_class").to_pylist()
        of = np.array([number.setdefault(c, len(number)) for c in named])  # renamed as links are found
        token, core = tile.column("_token").to_numpy(), tile.column("_core").to_numpy(zero_copy_only=False)
        key, node = np.array(tile.column("_key").to_pylist()), tile.column("_node").to_pylist()
        texts: dict[bytes, tuple] = {}
        tried, out = set(), []

        def text(i: int) -> tuple:
            if node[i] not in texts:
                texts[node[i]] = _weighted(tile, i)
            return texts[node[i]]

        order = np.argsort(token, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
            one_block = len(set(key[own])) == 1
            for place, i in enumerate(own):
                near = own[place + 1 :]
                near = near[(of[near] != of[i]) & (core[near] | core[i]) & (one_block | (key[near] != key[i]))]
                for j in near.tolist():
                    pair = (node[i], node[j]) if node[i] < node[j] else (node[j], node[i])
                    if of[i] == of[j] or pair in tried:
                        continue
                    tried.add(pair)
                    if linked(text(i), text(j), least):
                        out.append((named[i], named[j]))
                        of[of == of[j]] = of[i]
        return pa.table({k: pa.array([p[x] for p in out], pa.binary()) for x, k in enumerate(("_class", "_to"))})

    return rows


def node_of(text: Column) -> Column:
    """16 bytes of the text's sha256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _own_key(c: str) -> Column:
    """A join key that rows are not dealt by elsewhere, so that a large key can be split at run time."""
    return F.hex(c)


def _tiles(members: DataFrame, block: int, alone: bool = False) -> DataFrame:
    """(_tile, _token, _node, _class, _core, _key) of members (_token, _node, _class, _core).

    Short lists share tiles of about TASK_ROWS rows. Of a list of more than ``block`` nodes each two blocks are a tile;
    a class of at least ``block`` nodes in it has blocks of its own, which do not meet each other, and the smaller
    ones share blocks. ``alone``: blocks of nodes of all classes, each by itself, so rows are as many as members."""
    lists = members.groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    long = stored(lists.filter(F.col("_n") > block).select(F.hex("_token").alias("_k")), "long")
    tasks = max(1, members.count() // TASK_ROWS)
    short = members.withColumn("_k", _own_key("_token")).join(long, "_k", "left_anti")
    short = short.select(F.concat(F.lit("s"), F.pmod("_token", F.lit(tasks)).cast("string")).alias("_tile"), "_token", "_node", "_class", "_core", F.lit("").alias("_key"))
    if long.isEmpty():
        return short
    of = members.withColumn("_k", _own_key("_token")).join(long, "_k", "left_semi").drop("_k")
    if alone:
        groups = lists.filter(F.col("_n") > block).select("_token", F.ceil(F.col("_n") / block).alias("_blocks"))
        name = F.concat_ws("|", F.col("_token").cast("string"), F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("string"))
        return short.unionByName(of.join(groups, "_token").select(name.alias("_tile"), "_token", "_node", "_class", "_core", F.lit("").alias("_key")))
    sizes = of.groupBy("_token", "_class").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_token", "_class", "_n", F.when(F.col("_n") >= block, F.hex("_class")).otherwise("").alias("_own"))
    groups = sizes.groupBy("_token", "_own").agg(F.ceil(F.sum("_n") / block).alias("_blocks"))
    key = lambda i: F.concat_ws(":", "_own", i.cast("string"))
    blocks = groups.select("_token", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i"))
    blocks = blocks.select("_token", "_own", key(F.col("_i")).alias("_key"))
    pairs = blocks.join(blocks.toDF("_token", "_own_b", "_key_b"), "_token").filter("_key <= _key_b and (_own = '' or _own != _own_b)")
    name = F.concat_ws("|", F.col("_token").cast("string"), "_key", "_key_b")
    tiles = pairs.select("_token", name.alias("_tile"), F.explode(F.array_distinct(F.array("_key", "_key_b"))).alias("_key"))
    owned = of.join(sizes.select("_token", "_class", "_own"), ["_token", "_class"]).join(groups, ["_token", "_own"])
    keyed = owned.select("_token", "_node", "_class", "_core", key(F.pmod(F.xxhash64("_node"), F.col("_blocks"))).alias("_key"))
    return short.unionByName(keyed.join(tiles, ["_token", "_key"]).select("_tile", "_token", "_node", "_class", "_core", "_key"))


def connected(edges: DataFrame) -> DataFrame:
    """(_node, _class): the smallest node of each component of edges (_a, _b).

    Every node takes the smallest label around it, then that label's own label, until nothing changes; each step is
    pre-aggregated and written out, so lineage stays short and a hub is no single task's.
    """
    both = edges.select("_a", "_b").union(edges.select("_b", "_a")).toDF("_node", "_next").distinct().checkpoint()
    labels = both.groupBy("_node").agg(F.min("_next").alias("_m")).select("_node", F.least("_node", "_m").alias("_class")).checkpoint()
    while True:
        around = both.join(labels.select(F.col("_node").alias("_next"), "_class"), "_next").groupBy("_node").agg(F.min("_class").alias("_m"))
        nearer = labels.join(around, "_node", "left").select("_node", F.col("_class").alias("_old"), F.least("_class", "_m").alias("_class"))
        jump = nearer.select(F.col("_node").alias("_class"), F.col("_class").alias("_further"))
        step = nearer.join(jump, "_class", "left").select("_node", "_old", F.coalesce("_further", "_class").alias("_class")).checkpoint()
        labels = step.select("_node", "_class")
        if step.filter("_old != _class").isEmpty():
            return labels


def _roots(trees: DataFrame) -> DataFrame:
    """(_class, _to) with the root of each tree in place of the parent: pointers are doubled until none moves."""
    while True:
        further = trees.select(_own_key("_class").alias("_k"), F.col("_to").alias("_further"))
        step = trees.withColumn("_k", _own_key("_to")).join(further, "_k", "left")
        step = step.select("_class", F.coalesce("_further", "_to").alias("_to"), F.col("_further").isNotNull().alias("_moved")).checkpoint()
        trees = step.select("_class", "_to")
        if step.filter("_moved").isEmpty():
            return trees


def _relabelled(nodes: DataFrame, merged: DataFrame, *columns: str) -> DataFrame:
    """nodes (_node, _class, ...) with classes replaced by what merged (_class, _to) says."""
    to = merged.select(_own_key("_class").alias("_k"), "_to")
    named = nodes.withColumn("_k", _own_key("_class")).join(to, "_k", "left")
    return stored(named.select("_node", F.coalesce("_to", "_class").alias("_class"), *columns), "classes")


def _head_pairs(classed: DataFrame, shared: Bits, bands: int, salt: int) -> DataFrame:
    """(_class, _to, _a, _b): each class with the first head of its buckets; _a and _b are nodes of theirs in the bucket."""
    rows = classed.mapInArrow(_banded(bands, shared, ["_class", "_node"]), "_bucket bigint, _class binary, _node binary")
    held = stored(rows.groupBy("_bucket", "_class").agg(F.min("_node").alias("_node")), "buckets")
    order = F.xxhash64("_class", F.lit(salt))
    heads = held.groupBy("_bucket").agg(F.min(F.struct(order.alias("h"), "_class", "_node")).alias("_head"), F.count(F.lit(1)).alias("_n"))
    heads = heads.filter("_n > 1").select(_own_key("_bucket").alias("_k"), "_head")
    met = held.withColumn("_k", _own_key("_bucket")).join(heads, "_k").filter("_class != _head._class")
    first = met.groupBy("_class").agg(F.min(F.struct("_head.h", F.col("_head._class").alias("to"), F.col("_head._node").alias("b"), F.col("_node").alias("a"))).alias("_p"))
    return first.select("_class", F.col("_p.to").alias("_to"), F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"))


def _links_of(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(_class, _to) of pairs (_class, _to, _a, _b) whose nodes _a and _b are linked."""
    a, b = (shingles.toDF("_k", f"_shingles_{x}", f"_weights_{x}").withColumn("_k", _own_key("_k")) for x in "ab")
    # The partners of a node travel as one row to its shingles; in a bucket that is no more than BLOCK of them.
    of = pairs.groupBy("_a").agg(F.collect_list(F.struct("_class", "_to", "_b")).alias("_with")).withColumn("_k", _own_key("_a"))
    full = of.join(a, "_k").select("_shingles_a", "_weights_a", F.explode("_with").alias("_x")).select("_shingles_a", "_weights_a", "_x.*")
    full = full.withColumn("_k", _own_key("_b")).join(b, "_k")
    full = full.select("_class", "_to", "_shingles_a", "_weights_a", "_shingles_b", "_weights_b")
    return stored(full.mapInArrow(_verified(similarity), "_class binary, _to binary"), "found")


def _links_in_small(classed: DataFrame, small: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(_class, _to): links between nodes of different classes that share a bucket of small."""
    rows = classed.mapInArrow(_short_rows(Bits.of(small, "_bucket")), "_bucket bigint, _band int, _class binary, _node binary, _sig binary")
    tasks = max(1, (small.agg(F.sum("_n")).first()[0] or 0) // TASK_ROWS)
    pairs = rows.groupBy(F.pmod("_bucket", F.lit(tasks)).alias("_task")).applyInArrow(_agreeing, "_class binary, _to binary, _a binary, _b binary")
    return _links_of(pairs, shingles, similarity)


def _links_in_large(classed: DataFrame, large: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(_class, _to): links between the classes of nodes that have a bucket in large."""
    left = classed.mapInArrow(_touching(Bits.of(large, "_bucket")), classed.schema).select("_node", "_class")
    texts = stored(left.join(shingles, "_node"), "left")
    common = _sketch(texts)
    schema = "_token bigint, _node binary, _class binary, _core boolean"
    tokens = texts.mapInArrow(_first_shingles(common, similarity, None), schema)
    tokens = tokens.select("_token", "_core", F.xxhash64("_class").alias("_c"), *[F.xxhash64("_node", F.lit(i)).alias(f"_x{i}") for i in range(2)])
    # Shingles of the very same nodes are one list: texts that are nearly linked share many.
    met = tokens.groupBy("_token").agg(
        F.min("_c").alias("_least"), F.max("_c").alias("_most"), F.max("_core").alias("_any"),
        F.bit_xor("_x0").alias("_x0"), F.bit_xor("_x1").alias("_x1"), F.count(F.lit(1)).alias("_n"),
    )
    met = stored(met.filter("_least != _most and _any").select("_token", F.xxhash64("_x0", "_x1", "_n").alias("_list")), "met")
    posts = texts.mapInArrow(_first_shingles(common, similarity, Bits.of(met, "_token")), schema)
    posts = posts.withColumn("_k", _own_key("_token")).join(met.select(_own_key("_token").alias("_k"), "_list"), "_k")
    posts = posts.groupBy(F.col("_list").alias("_token"), "_node").agg(F.first("_class").alias("_class"), F.max("_core").alias("_core"))
    posts = stored(posts, "posts")
    free(met, texts)
    # Blocks by themselves first: most of a group of near copies is one class then, whose blocks need not meet.
    first = _links_of_tiles(_tiles(posts, BLOCK, alone=True), shingles, similarity)
    lists = posts.groupBy("_token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK).select(F.hex("_token").alias("_k"))
    posts = posts.withColumn("_k", _own_key("_token")).join(lists, "_k", "left_semi").drop("_k")
    if not first.isEmpty():
        posts = _relabelled(posts, _smallest(first), "_token", "_core")
    several = posts.groupBy("_token").agg(F.min("_class").alias("_least"), F.max("_class").alias("_most"))
    several = several.filter("_least != _most").select(F.hex("_token").alias("_k"))
    posts = stored(posts.withColumn("_k", _own_key("_token")).join(several, "_k", "left_semi").drop("_k"), "posts")
    return first if posts.isEmpty() else first.union(_links_of_tiles(_tiles(posts, BLOCK), shingles, similarity))


def _links_of_tiles(tiles: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(_class, _to): links between classes of nodes that meet in a tile."""
    tiles = tiles.withColumn("_k", _own_key("_node"))
    tiles = tiles.join(shingles.withColumnRenamed("_node", "_k").withColumn("_k", _own_key("_k")), "_k").drop("_k")
    return stored(tiles.groupBy("_tile").applyInArrow(_tile_links(similarity), "_class binary, _to binary"), "links")


def _smallest(links: DataFrame) -> DataFrame:
    """(_class, _to): what classes become by links (_class, _to) between them."""
    return connected(links.toDF("_a", "_b")).toDF("_class", "_to")


def _mixed(classed: DataFrame, shared: Bits) -> DataFrame:
    """(_bucket, _n) of the buckets of several classes, with their numbers of nodes."""
    rows = classed.mapInArrow(_banded(BANDS, shared, ["_class"]), "_bucket bigint, _class binary").select("_bucket", F.xxhash64("_class").alias("_c"))
    mixed = rows.groupBy("_bucket").agg(F.min("_c").alias("_least"), F.max("_c").alias("_most"), F.count(F.lit(1)).alias("_n"))
    return stored(mixed.filter("_least != _most").select("_bucket", "_n"), "mixed")


def _settled(classed: DataFrame, shared: Bits, shingles: DataFrame, similarity: float, kept: list[DataFrame]) -> DataFrame:
    """classed with classes that share a bucket and are linked made one. Large buckets come first: their groups are one
    class then and make no pairs in the small buckets that they also have. kept: gets the tables that were written."""
    mixed = _mixed(classed, shared)
    large = mixed.filter(F.col("_n") > BLOCK)
    if not large.isEmpty():
        links = _links_in_large(classed, large, shingles, similarity)
        if not links.isEmpty():
            classed = _relabelled(classed, _smallest(links), "_sig")
            kept.append(classed)
            mixed = _mixed(classed, shared)
    links = _links_in_small(classed, mixed.filter(F.col("_n") <= BLOCK), shingles, similarity)
    if not links.isEmpty():
        classed = _relabelled(classed, _smallest(links), "_sig")
        kept.append(classed)
    return classed


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(_node, _class) of the nodes that are linked to another; for _node see ``node_of``."""
    shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(text_of(text_col).alias("_text")).select(node_of(F.col("_text")).alias("_node"), "_text")
    signed = rows.mapInArrow(_signed, "_node binary, _sig binary").filter("_sig is not null")
    signed = stored(signed.groupBy("_node").agg(F.first("_sig").alias("_sig")), "signatures")
    buckets = signed.mapInArrow(_banded(BANDS, None, []), "_bucket bigint").groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    buckets = stored(buckets.filter("_n > 1").select("_bucket"), "shared")
    shared = Bits.of(buckets, "_bucket")
    # Most nodes share no bucket: their bands go no further than the task that made them.
    near = stored(signed.mapInArrow(_touching(shared), signed.schema), "near")
    power = filter_power(near.count())
    some = maybe_in(rows, [F.col("_node")], key_filter(near.select("_node"), [F.col("_node")], power), "_likely", power).filter("_likely")
    some = some.select("_node", "_text").mapInArrow(_shingled, "_node binary, _shingles binary, _weights binary")
    shingles = stored(some.groupBy("_node").agg(F.first("_shingles").alias("_shingles"), F.first("_weights").alias("_weights")), "shingles")

    free(signed)
    classed, kept = near.select("_node", F.col("_node").alias("_class"), "_sig"), [near, shingles, buckets]
    for salt in count():
        pairs = stored(_head_pairs(classed, shared, BANDS if salt else FIRST_BANDS, salt), "pairs")
        found = _links_of(pairs, shingles, similarity)
        tried, links = pairs.count(), found.count()
        if links:
            classed = _relabelled(classed, _roots(found), "_sig")
            kept.append(classed)
        free(pairs, found)
        if links <= YIELD * tried:
            break
    settled = _settled(classed, shared, shingles, similarity, kept)
    several = settled.filter("_node != _class").select("_node", "_class")
    out = stored(several.union(several.select("_class", "_class").distinct()), "linked")
    free(*kept)  # signatures and shingles would lie beside all that later stages write
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), class_size (rows), text_sha256."""
    classes = near_classes(docs, id_col, text_col, similarity)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), node_of(text).alias("_node"), F.sha2(text, 256).alias("_sha"))
    nodes = rows.groupBy("_node").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    nodes = nodes.join(classes, "_node", "left").withColumn("_class", F.coalesce("_class", "_node"))
    totals = nodes.groupBy("_class").agg(F.min("_least").alias("class_id"), F.sum("_rows").alias("class_size"))
    totals = totals.select(_own_key("_class").alias("_k"), "class_id", "class_size")
    named = nodes.withColumn("_k", _own_key("_class")).join(totals, "_k").select(_own_key("_node").alias("_k"), "class_id", "class_size")
    rows = rows.withColumn("_k", _own_key("_node")).join(named, "_k")
    return rows.select(F.col("_id").alias(id_col), "class_id", "class_size", F.col("_sha").alias("text_sha256"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row for each class, that of the smallest id; only rows of classes with several rows are shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), node_of(text_of(text_col)).alias("_node"))
    classes = near_classes(docs, id_col, text_col, similarity)
    copies = rows.groupBy("_node").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_node")
    copies = copies.join(classes, "_node", "left_anti").select("_node", F.col("_node").alias("_class"))
    grouped = stored(classes.union(copies), "classes")
    power = filter_power(grouped.count())
    rows = maybe_in(rows, [F.col("_node")], key_filter(grouped.select("_node"), [F.col("_node")], power), "_several", power)
    named = rows.filter("_several").join(grouped, "_node", "left").withColumn("_class", F.coalesce("_class", "_node"))
    best = named.groupBy("_class").agg(F.min_by("_row", F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_node"))).alias("_row"))
    return rows.filter("not _several").select("_row.*").union(best.select("_row.*"))
