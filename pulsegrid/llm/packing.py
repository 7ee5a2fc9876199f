"""Packing of token sequences with controlled mixture: deficit round-robin over one queue per source.

Every round gives each queue its quantum, the weight's share of ``window`` tokens. What a queue has not spent is its
deficit and is carried to the next round; a queue serves its next document as soon as that is paid for in full. A
document of more than ``part`` tokens is served in parts of that size. So documents stay whole, a deficit is below the
largest part, and while all queues have documents, a round is a window with the target proportions, give or take those
deficits; queues that are empty drop out, and the others go on in their proportions.

As credit is carried, a part whose tokens end at place e of its queue is served in the first round r with
r * quantum + credit >= e. That is a closed form, so no loop over rounds or queues is needed, at any number of sources:

1. Tokens are counted within each partition while documents are tokenised; sums by (source, partition) give each
   document its place in its queue. Ids are written to the shared folder.
2. Parts are ordered by (round, source, place). Their places in the stream of all tokens are running sums within
   blocks of BLOCK_ROUNDS rounds, after running sums of the blocks (``block_starts``). Only numbers travel here.
3. The places meet the ids, and the stream is cut every ``length`` tokens: no sequence but the last has padding, and a
   part of n tokens has at most n / length + 2 pieces.

A queue starts with a credit between nothing and its mean document, by a hash of the source: else all sources of one
document would be served in the last round.

Weights: those given; a source that is not named has its share of all tokens. Without any, the size to the power of
``temperature``: 1 gives every window the mixture of the corpus, less gives small sources more.

Defined cases: a null text is empty and has the end id only; a null source is the source ''; repeated rows are packed
each; an empty table gives an empty table; extra columns are not read; weights must be positive numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import block_starts, small_batches, stored
from .textvec import lean, ragged, slices

LENGTH, WINDOW, END_ID = 1024, 64 * 1024, 0
#: Largest part of a document that is served at once.
PART = WINDOW
#: Rounds whose parts are put in order by one task.
BLOCK_ROUNDS = 64
#: Starts of (source, partition) that are broadcast at most, each some 40 bytes.
BROADCAST_STARTS = 500_000


def _planes(ids: np.ndarray) -> bytes:
    """Low bytes, then high bytes: compresses better."""
    return ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _ids(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()


def _tokenised(path: str, end_id: int):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, served, row = TaskContext.get().partitionId(), {}, 0
        encode = encoder(path)
        if encode.vocabulary > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        for batch in batches:
            texts, sources = batch.column("_text"), batch.column("_source").to_pylist()
            for a, b in slices(texts):
                ids, counts = encode.encode(texts.slice(a, b - a).to_pylist())
                ends = np.cumsum(counts)
                at, blobs = [], []
                for s, e, n in zip(sources[a:b], ends.tolist(), counts.tolist(), strict=True):
                    blobs.append(_planes(np.append(ids[e - n : e], end_id)))
                    at.append(served.get(s, 0))
                    served[s] = at[-1] + n + 1
                out = {
                    "_row": pa.array((part << 40) + row + np.arange(b - a)),
                    "_id": batch.column("_id").slice(a, b - a),
                    "_source": pa.array(sources[a:b], pa.string()),
                    "_part": pa.array([part] * (b - a), pa.int32()),
                    "_at": pa.array(at, pa.int64()),
                    "_n": pa.array(counts + 1, pa.int64()),
                    "_ids": pa.array(blobs, pa.binary()),
                }
                row += b - a
                yield pa.RecordBatch.from_pydict(out)

    return rows


def cuts(start: np.ndarray, size: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of runs of tokens that lie at some places of the stream: index of the run, start, length, place."""
    first = place // length
    n = (place + size - 1) // length - first + 1
    i = np.repeat(np.arange(len(n)), n)
    k = first[i] + ragged(np.zeros(len(n), np.int64), n)
    low, high = np.maximum(place[i], k * length), np.minimum((place + size)[i], (k + 1) * length)
    return i, start[i] + low - place[i], high - low, low


def _cut(length: int, keep_ids: bool):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            served = batch.column("_served")
            flat = served.flatten()
            run = [flat.field(c).to_numpy() for c in ("_from", "_len", "_place")]
            owner = np.repeat(np.arange(len(batch)), np.diff(served.offsets.to_numpy()))
            index, start, size, place = cuts(*run, length)
            row = owner[index]
            crc, held, ids, words = [], -1, None, []
            for i, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                if i != held:
                    held, ids = i, _ids(batch.column("_ids")[i].as_py()).astype("<u4")
                piece = ids[s : s + k]
                crc.append(zlib.crc32(piece))
                if keep_ids:
                    words.append(piece.astype(np.int32))
            out = {
                "_id": batch.column("_id").take(pa.array(row)),
                "source": batch.column("_source").take(pa.array(row)),
                "start": start,
                "length": size,
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": batch.column("_n").take(pa.array(row)),
                "sequence_id": place // length,
                "offset": place % length,
            }
            if keep_ids:
                out["ids"] = pa.array(words, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return rows


def _queues(parts: DataFrame, weights: Mapping[str, float] | None, temperature: float, window: int) -> DataFrame:
    """(_source, _quantum, _credit) of (_source, _part, _total, _docs)."""
    if any(not w > 0 for w in (weights or {}).values()):
        raise ValueError("weights are positive")
    sizes = parts.groupBy("_source").agg(F.sum("_total").alias("_size"), F.sum("_docs").alias("_docs"))
    if weights:
        given = parts.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_source string, _given double")
        everything = F.lit(float(parts.agg(F.sum("_total")).first()[0] or 1))
        sizes = sizes.join(F.broadcast(given), "_source", "left")  # as many rows as the caller names sources
        weighted = sizes.withColumn("_weight", F.coalesce("_given", F.col("_size") / everything))
    else:
        weighted = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(float(temperature))))
    quantum = F.col("_weight") * F.lit(window / float(weighted.agg(F.sum("_weight")).first()[0] or 1))
    point = F.pmod(F.xxhash64("_source"), F.lit(1 << 20)) / (1 << 20)
    return weighted.select("_source", quantum.alias("_quantum"), F.floor(point * F.col("_size") / F.col("_docs")).alias("_credit"))


def schedule(tokens: DataFrame, weights: Mapping[str, float] | None, temperature: float, window: int, part: int) -> DataFrame:
    """(_row, _from, _len, _round, _place) of tokens (_row, _source, _part, _at, _n): each part of each document."""
    parts = stored(tokens.groupBy("_source", "_part").agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_docs")), "parts")
    before = F.sum("_total").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("_source", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    starts = stored(bases.join(_queues(parts, weights, temperature, window), "_source"), "starts")
    few = starts.count() <= BROADCAST_STARTS
    rows = tokens.select("_row", "_source", "_part", "_at", "_n").join(F.broadcast(starts) if few else starts, ["_source", "_part"])
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / part))))
    rows = rows.withColumn("_from", (F.col("_i") * part).cast("bigint")).withColumn("_len", F.least(F.lit(part), F.col("_n") - F.col("_from")))
    rows = rows.withColumn("_end", F.col("_base") + F.col("_at") + F.col("_from") + F.col("_len"))
    rows = rows.withColumn("_round", F.greatest(F.lit(1), F.ceil((F.col("_end") - F.col("_credit")) / F.col("_quantum"))).cast("bigint"))
    rows = rows.withColumn("_block", F.floor(F.col("_round") / BLOCK_ROUNDS)).select("_row", "_source", "_from", "_len", "_end", "_round", "_block")
    rows = stored(rows, "rounds")
    first = block_starts(rows.groupBy("_block").agg(F.sum("_len").alias("_sum")))
    order = Window.partitionBy("_block").orderBy("_round", "_source", "_end").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.withColumn("_within", F.coalesce(F.sum("_len").over(order), F.lit(0))).join(first, "_block")
    return ordered.select("_row", "_from", "_len", "_round", (F.col("_start") + F.col("_within")).alias("_place"))


def pack(
    docs: DataFrame, tokenizer: str, weights: Mapping[str, float] | None = None, length: int = LENGTH, window: int = WINDOW,
    end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    temperature: float = 1.0, part: int = PART,
) -> DataFrame:
    """One row per piece: id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    small_batches(docs.sparkSession)
    long, id_type = T.LongType(), docs.schema[id_col].dataType
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text(source_col).alias("_source"), text(text_col).alias("_text"))
    kept = {"_row": long, "_id": id_type, "_source": T.StringType(), "_part": T.IntegerType(), "_at": long, "_n": long, "_ids": T.BinaryType()}
    kept = T.StructType([T.StructField(k, t) for k, t in kept.items()])
    tokens = stored(rows.mapInArrow(_tokenised(tokenizer, end_id), kept), "tokens")
    served = schedule(tokens, weights, temperature, window, part)
    served = served.groupBy("_row").agg(F.collect_list(F.struct("_from", "_len", "_place")).alias("_served"))
    whole = tokens.select("_row", "_id", "_source", "_n", "_ids").join(served.hint("shuffle_hash"), "_row")
    fields = [T.StructField("_id", id_type), T.StructField("source", T.StringType())]
    fields += [T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return whole.mapInArrow(_cut(length, keep_ids), T.StructType(fields)).withColumnRenamed("_id", id_col)
