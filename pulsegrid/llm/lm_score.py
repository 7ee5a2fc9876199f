"""Language-model scores from a log-frequency Bloom filter.

Counting: words of the training documents and pairs of neighbouring words (an end mark before the first and after the
last word of each text). Pairs are counted by 64-bit hashes that travel packed, a blob for each task and block of the
hash space, and are summed block by block.

The filter: an n-gram of count c has level 1 + floor(log(c) / log(BASE)) and is stored once for each level up to its
own, by PROBES bits each. A look-up probes level 1, 2, ... until one is missing, and so finds the level, or now and
then a higher one; the count it stands for is the middle of the level. All words and all pairs are stored, from a
count of 1 on. Bits are in blocks, and an n-gram's bits are all in the block of its hash, so blocks are built apart,
each in its own task and as large as FILTER_BITS_EACH bits for each level stored in it. The number of blocks grows
with the corpus (about BLOCK_TOKENS tokens each). They are a table in the shared folder and reach the workers in parts
of about PART_BITS, each a broadcast of its own; a worker holds one part at a time and probes it for all n-grams of a
slice of texts that fall in its blocks. So memory is bounded, while the work grows with parts times slices.

Probability of a word w after v: (c(v, w) + MU * p(w)) / (c(v) + MU), p(w) = (c(w) + 1) / (N + V + 1), all c from the
filter; N words and V different ones in training, end marks counted. The model's score is the sum of log10.

Base score: exact counts. The TOP_WORDS most frequent words are broadcast with theirs; the other words of a document
meet their counts in a join.

Defined cases: a null text is an empty one, which is one end mark; repeated rows count and are scored each; null ids
train and are scored; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, small_batches, stored, text_of
from .textvec import BATCH_CHARS, Words, five, from_five, give_back, lean, lean_group, mix, slices

FOLDS, HELD_OUT = 7, 2
BASE, PROBES, FILTER_BITS_EACH = 1.5, 3, 12
MU, TOP_WORDS = 400.0, 200_000
#: Tokens for each block of the filter, and blocks at least; their number is a power of two.
BLOCK_TOKENS, LEAST_BLOCKS = 200_000, 64
#: Pairs of texts that a task gathers before it hands on what differs.
GATHER = 4_000_000
#: Bits of the filter that are collected, broadcast and held by a worker at a time (a block at least).
PART_BITS = 1 << 29
#: Bytes of text that are scored together where the filter has several parts, each of which is read once for them.
PARTED_CHARS = 8_000_000
#: N-grams that are probed at a time: bounds what a worker holds beside the part.
PROBED = 1 << 16
END = " "  # no word has a blank in it
_END_HASH = np.uint64(0x2545F4914F6CDD1D)
_PAIR, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Hashes travel as what is left of them within a block: five bytes.
_REST_BITS = 40
#: No count that fits 63 bits has a higher level.
MOST_LEVELS = 128


def blocks_for(tokens: int) -> int:
    blocks = LEAST_BLOCKS
    while blocks * BLOCK_TOKENS < tokens:
        blocks *= 2
    return blocks


def _hash40(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block in the high bits, 40 bits within it."""
    return (h & np.uint64(blocks - 1)) << np.uint64(_REST_BITS) | (mix(h) & np.uint64((1 << _REST_BITS) - 1))


class Tokens:
    """Words of a batch with an end mark after each text: codes into ``hashes``; ``previous`` is the word before."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        self.dictionary = words.dictionary
        self.hashes = np.append(words.hashes(), _END_HASH)
        end, n = len(words.dictionary), np.diff(words.starts)
        self.counts = n + 1
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.codes = np.full(int(self.starts[-1]), end, np.int32)
        owner = np.repeat(np.arange(len(n)), n)
        self.codes[np.arange(len(words.codes)) + owner] = words.codes
        self.previous = np.empty_like(self.codes)
        if len(self.codes):
            self.previous[0] = end
            self.previous[1:] = self.codes[:-1]  # the end mark of the text before is the mark before this one

    def pairs(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        h = self.hashes
        return mix(h[self.previous[start:stop]] * _PAIR + h[self.codes[start:stop]])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _blobs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each block: hashes of count 1 (_ones), and those of more with their counts. keys ascend."""
    block = (keys >> np.uint64(_REST_BITS)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    ones, more, more_counts = [], [], []
    for a, b in zip(at, np.append(at[1:], len(block)), strict=True):
        once = counts[a:b] == 1
        ones.append(five(keys[a:b][once]))
        more.append(five(keys[a:b][~once]))
        more_counts.append(counts[a:b][~once].astype("<i8").tobytes())
    binary = pa.binary()
    return pa.RecordBatch.from_pydict(
        {"_block": pa.array(block[at]), "_ones": pa.array(ones, binary), "_more": pa.array(more, binary), "_counts": pa.array(more_counts, binary)}
    )


def _pair_blobs(blocks: int):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for a, b in slices(batch.column("_text")):
                k, c = np.unique(_hash40(Tokens(batch.column("_text").slice(a, b - a)).pairs(), blocks), return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > GATHER:
                    yield _blobs(*_merge(keys, counts))
                    keys.clear()
                    counts.clear()
        if keys:
            yield _blobs(*_merge(keys, counts))

    return rows


@lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, texts = [], 0
        for a, b in slices(batch.column("_text"), 16_000_000):
            words = Words(batch.column("_text").slice(a, b - a), lower=True)
            parts.append((words.dictionary, np.bincount(words.codes, minlength=len(words.dictionary))))
            texts += b - a
        for names, n in parts:
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n.astype(np.int64))], names=["_word", "_n"])
        yield pa.RecordBatch.from_pydict({"_word": pa.array([END]), "_n": pa.array([texts], pa.int64())})


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of each count of 1 or more."""
    return 1 + np.floor(np.log(counts.astype(np.float64)) / log(BASE) + 1e-9).astype(np.int64)


def level_counts(most: int = MOST_LEVELS) -> np.ndarray:
    """The count that each level stands for: the middle of the whole numbers in it."""
    low = BASE ** np.arange(most, dtype=np.float64)
    return np.concatenate([[0.0], (low + np.maximum(BASE * low, low + 1) - 1) / 2])[:most]


@dataclass
class Filter:
    """parts: runs of blocks, as functions that give their bits; first: the first block of each, and the number of all
    at the end; starts: the bit at which each block begins, counted over all parts."""

    parts: list[Callable[[], np.ndarray]]
    first: list[int]
    starts: np.ndarray
    tokens: int
    vocabulary: int

    @property
    def blocks(self) -> int:
        return len(self.starts) - 1

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams, by repeated membership probes."""
        out = np.zeros(len(keys), np.int16)
        sizes = np.diff(self.starts).astype(np.uint64)
        part_of = np.where(sizes > 0, np.searchsorted(self.first, np.arange(self.blocks), "right") - 1, -1).astype(np.int32)
        of = np.empty(len(keys), np.int32)
        for a in range(0, len(keys), PROBED):
            of[a : a + PROBED] = part_of[(keys[a : a + PROBED] >> np.uint64(_REST_BITS)).astype(np.int64)]
        for i, (part, first) in enumerate(zip(self.parts, self.first[:-1], strict=True)):
            own = np.flatnonzero(of == i)
            bits = None  # the part before goes first
            bits = part() if len(own) else None
            for a in range(0, len(own), PROBED):
                alive, level = own[a : a + PROBED], 0
                key = keys[alive]
                block = (key >> np.uint64(_REST_BITS)).astype(np.int64)
                size, start = sizes[block], self.starts[block] - self.starts[first]
                while len(alive) and level < MOST_LEVELS - 1:
                    level += 1
                    there = np.ones(len(alive), bool)
                    for at in _places(key, level, size):
                        at += start
                        there &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    alive, key, size, start = alive[there], key[there], size[there], start[there]
                    out[alive] = level
        return out

    @property
    def bits(self) -> np.ndarray:
        """All parts in one array."""
        return np.concatenate([part() for part in self.parts])


class Sent:
    """A part that is broadcast. With ``keep`` a worker holds it, else it is read anew at each call."""

    def __init__(self, sent: Broadcast, keep: bool):
        self.sent, self.keep = sent, keep

    def __call__(self) -> np.ndarray:
        bits = self.sent.value
        if not self.keep and getattr(self.sent, "_path", None):  # without a file (encrypted) it can be read only once
            self.sent.__dict__.pop("_value", None)
        return bits


def _places(keys: np.ndarray, level: int, sizes: np.ndarray | np.uint64) -> list[np.ndarray]:
    """Bits of n-grams on a level within their blocks: two hashes of 32 bits, and sums of them (double hashing)."""
    h = mix(keys + np.uint64(level * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF))
    low, high, mask = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1), np.uint64(0xFFFFFFFF)
    return [((((low + np.uint64(i) * high) & mask) * sizes) >> np.uint64(32)).astype(np.int64) for i in range(PROBES)]


def _summed(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a block, from what its tasks sent."""
    top = np.uint64(batch.column("_block")[0].as_py()) << np.uint64(_REST_BITS)
    ones, more = (from_five(b"".join(batch.column(c).to_pylist())) | top for c in ("_ones", "_more"))
    counts = np.frombuffer(b"".join(batch.column("_counts").to_pylist()), "<i8")
    return _merge([ones, more], [np.ones(len(ones), np.int64), counts])


@lean
def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of words, as _pair_blobs has them of pairs; _blocks is the number of blocks."""
    import xxhash

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("_word").to_pylist()
        h = np.fromiter((_END_HASH if w == END else xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
        keys, counts = _hash40(h, batch.column("_blocks")[0].as_py()), batch.column("_n").to_numpy()
        order = np.argsort(keys, kind="stable")
        yield _blobs(keys[order], counts[order])


@lean_group
def _bits_of(block: pa.Table) -> pa.Table:
    """The bits of a block, as many as its n-grams need; a multiple of 64."""
    keys, counts = _summed(block)
    n = levels(counts)
    size = -(-int(n.sum()) * FILTER_BITS_EACH // 64) * 64
    if size >> 31:
        raise ValueError("a block of the filter has over 2**31 bits: BLOCK_TOKENS is too large")
    bits = np.zeros(size, bool)
    for level in range(1, int(n.max()) + 1):
        for at in _places(keys[n >= level], level, np.uint64(size)):
            bits[at] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"_block": block.column("_block")[:1], "_size": pa.array([size], pa.int64()), "_bits": pa.array([packed], pa.binary())})


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


def word_table(texts: DataFrame) -> DataFrame:
    """(_word, _n): every word of the texts, and END, with its count."""
    return stored(texts.mapInArrow(_word_counts, "_word string, _n bigint").filter("_n > 0").groupBy("_word").agg(F.sum("_n").alias("_n")), "words")


def build_filter(texts: DataFrame, words: DataFrame, part_bits: int = PART_BITS) -> Filter:
    """The filter of the texts (_text) whose words are counted in words; one part at a time comes to the driver."""
    spark = texts.sparkSession
    tokens, vocabulary = words.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = blocks_for(tokens)
    schema = "_block bigint, _ones binary, _more binary, _counts binary"
    pairs = texts.mapInArrow(_pair_blobs(blocks), schema)
    both = pairs.union(words.withColumn("_blocks", F.lit(blocks)).mapInArrow(_block_rows, schema))
    made = stored(both.groupBy("_block").applyInArrow(_bits_of, "_block bigint, _size bigint, _bits binary"), "filter")
    sizes = np.zeros(blocks, np.int64)
    for r in made.select("_block", "_size").collect():  # a row for each block
        sizes[r["_block"]] = r["_size"]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first = [0]
    while first[-1] < blocks:
        first.append(max(first[-1] + 1, int(np.searchsorted(starts, starts[first[-1]] + part_bits, "right")) - 1))
    first[-1] = blocks
    parts: list[Callable[[], np.ndarray]] = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        bits = np.zeros(int(starts[b] - starts[a]) // 8, np.uint8)
        for r in made.filter((F.col("_block") >= a) & (F.col("_block") < b)).collect():  # at most part_bits, or a block
            at = int(starts[r["_block"]] - starts[a]) // 8
            bits[at : at + r["_size"] // 8] = np.frombuffer(r["_bits"], np.uint8)
        parts.append(Sent(spark.sparkContext.broadcast(bits), len(first) == 2))
    free(made)
    return Filter(parts, first, starts, int(tokens), int(vocabulary))


def log_probabilities(lm: Filter, tokens: Tokens, mu: float = MU) -> np.ndarray:
    """log10 probability of each token; beside a key and a result for each, only PROBED tokens are worked on at a time."""
    words, n = len(tokens.hashes), len(tokens.codes)
    keys = np.empty(words + n, np.uint64)
    keys[:words] = _hash40(tokens.hashes, lm.blocks)
    for a in range(0, n, PROBED):
        keys[words + a : words + a + PROBED] = _hash40(tokens.pairs(a, a + PROBED), lm.blocks)
    found = lm.level(keys)
    del keys
    word_counts = level_counts()[found[:words]]
    unigram = (word_counts + 1) / (lm.tokens + lm.vocabulary + 1)
    out = np.empty(n)
    for a in range(0, n, PROBED):
        codes, before = tokens.codes[a : a + PROBED], word_counts[tokens.previous[a : a + PROBED]]
        pair = level_counts()[found[words + a : words + a + PROBED]]
        pair = np.minimum(pair, np.minimum(before, word_counts[codes]))  # a pair is no more frequent than its words
        out[a : a + PROBED] = np.log10((pair + mu * unigram[codes]) / (before + mu))
    return out


def _scored(lm: Filter, top, mu: float):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId() << 33, 0
        best, best_n = top.value
        end = np.flatnonzero(best.to_numpy(zero_copy_only=False) == END)
        ends = best_n[end[0]] if len(end) else 0
        scale = log(lm.tokens + lm.vocabulary + 1)
        for batch in batches:
            for a, b in slices(batch.column("_text"), BATCH_CHARS if len(lm.parts) == 1 else PARTED_CHARS):
                tokens = Tokens(batch.column("_text").slice(a, b - a))
                give_back()  # what taking the texts apart took
                place = pc.fill_null(pc.index_in(tokens.dictionary.cast(best.type), value_set=best), -1).to_numpy(zero_copy_only=False)
                count = np.append(np.append(best_n, -1)[place], ends)  # place -1 is the last
                logs = np.where(count >= 0, np.log(np.maximum(count, 0) + 1.0) - scale, 0) / log(10)  # of each different word
                add = lambda x, s=tokens.starts: np.add.reduceat(x, s[:-1]) if len(x) else x
                # words whose counts are not here: once for each text, with how often
                open_ = np.flatnonzero((count < 0)[tokens.codes])
                owner = np.searchsorted(tokens.starts, open_, "right") - 1
                keys, often = np.unique(owner << 32 | tokens.codes[open_], return_counts=True)
                bounds = np.searchsorted(keys >> 32, np.arange(b - a + 1)).astype(np.int32)
                words = [tokens.dictionary.take(pa.array(keys & 0xFFFFFFFF)).cast(pa.string()), pa.array(often.astype(np.int64))]
                out = {
                    "_row": pa.array(part + row + np.arange(b - a)),
                    "_id": batch.column("_id").slice(a, b - a),
                    "held_out": batch.column("held_out").slice(a, b - a),
                    "n_tokens": pa.array(tokens.counts),
                    "_known": pa.array(add((count > 0).astype(np.int64)[tokens.codes])),
                    "_base": pa.array(add(logs[tokens.codes])),
                    "score": pa.array(add(log_probabilities(lm, tokens, mu))),
                    "_left": pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(words, names=["w", "k"])),
                }
                del tokens, owner, open_, keys, often, words
                give_back()
                yield pa.RecordBatch.from_pydict(out)
                row += b - a

    return rows


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD_OUT, mu: float = MU,
    part_bits: int = PART_BITS, top_words: int = TOP_WORDS,
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    small_batches(spark, PARTED_CHARS >> 20)
    held_out = fold_of(F.col(id_col), folds) == held
    rows = docs.select(F.col(id_col).alias("_id"), held_out.alias("held_out"), text_of(text_col).alias("_text"))
    texts = rows.filter("not held_out").select("_text")
    words = word_table(texts)
    lm = build_filter(texts, words, part_bits)
    first = words.orderBy(F.desc("_n"), "_word").limit(top_words).toArrow()  # at most top_words rows
    # As arrays, which are far smaller than a dictionary of Python objects in each worker.
    words_of = first.column("_word").cast(pa.large_string()).combine_chunks()
    top = spark.sparkContext.broadcast((words_of, first.column("_n").to_numpy().astype(np.int64)))
    del first
    left = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("k", T.LongType())]))
    kinds = {"_row": T.LongType(), "_id": id_type, "held_out": T.BooleanType(), "n_tokens": T.LongType(), "_known": T.LongType()}
    kinds |= {"_base": T.DoubleType(), "score": T.DoubleType(), "_left": left}
    scored = stored(rows.mapInArrow(_scored(lm, top, mu), T.StructType([T.StructField(k, t) for k, t in kinds.items()])), "scores")
    scale, zero = F.lit(float(lm.tokens + lm.vocabulary + 1)), F.lit(0)
    open_ = scored.select("_row", F.explode("_left").alias("x")).select("_row", F.col("x.w").alias("_word"), F.col("x.k").alias("_k"))
    met = open_.join(words, "_word", "left").select("_row", "_k", F.coalesce("_n", zero).alias("_n"))
    logs = F.log10(F.col("_n") + 1.0) - F.log10(scale)
    known = F.when(F.col("_n") > 0, F.col("_k")).otherwise(zero)
    sums = met.groupBy("_row").agg(F.sum(known).alias("_more"), F.sum(F.col("_k") * logs).alias("_rest"))
    return scored.drop("_left").join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("_known") + F.coalesce("_more", zero)).alias("n_known"),
        F.lit(lm.tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rest", F.lit(0.0))).alias("base_score"), "score",
    )
