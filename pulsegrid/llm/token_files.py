"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

A file holds documents of one range of ids, in ascending order, of about FILE_TOKENS tokens (or one longer document),
so a task holds one file at a time, whatever its range. Files are numbered in order of ids. In a file each
id is replaced by its rank by frequency (a table of ids by rank is in the file, so any file can be read alone, and no
pass over the corpus comes before the first one is written). A rank takes 1, 2 or 3 bytes; two bits per rank say how
many, four ranks to a control byte, all control bytes together, before all data bytes. Decoding is table look-up:
a control byte gives four lengths, running sums give places, and the rank table gives ids.

    magic 'PGT1' | lengths of five sections, u64 each | document ids (Arrow stream) | ids by rank u32 |
    tokens per document u64 | control bytes | data bytes

Files are written under a task's own name and then renamed, so a task that runs again leaves one whole file.

Defined cases: a null text is empty and has the end id only; a null document id comes first; repeated rows are
written each, equal ids in the order of a hash of the text; an empty table gives no file; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import block_starts, scratch, small_batches, stored, text_of
from .textvec import BATCH_CHARS, lean, ragged, slices

END_ID = 2
MAGIC = b"PGT1"
#: Tokens of a file: a task that writes or reads one holds some 20 bytes each.
FILE_TOKENS = 8_000_000
#: Four lengths for each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids by rank, control bytes, data bytes."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    by_rank = used[np.lexsort((used, -counts[used]))].astype("<u4")
    if len(by_rank) > 1 << 24:
        raise ValueError("more than 2**24 different ids")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = rank_of[ids] if len(ids) else np.zeros(0, np.uint32)
    sizes = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16)
    two_bits = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    two_bits[: len(ids)] = sizes - 1
    control = (two_bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    ends = np.cumsum(sizes)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - sizes
    data[at] = ranks & 255
    for k in (1, 2):
        more = sizes > k
        data[at[more] + k] = (ranks[more] >> (8 * k)) & 255
    return by_rank, control, data


def decode_ids(by_rank: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    sizes = LENGTHS[control].ravel()[:n]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    ranks = data[at].astype(np.uint32)
    for k in (1, 2):
        more = np.flatnonzero(sizes > k)
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return by_rank[ranks].astype("<u4")


def _file_system(path: str):
    """Any store that pyarrow knows by its scheme; a bare path is local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_file(path: str, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
    by_rank, control, data = encode_ids(ids)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", doc_ids.type)])) as out:
        out.write_batch(pa.record_batch([doc_ids], names=["id"]))
    sections = [sink.getvalue().to_pybytes(), by_rank.tobytes(), counts.astype("<u8").tobytes(), control.tobytes(), data.tobytes()]
    store, at = _file_system(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    own = f"{at}.{context.taskAttemptId() if context else 0}"
    with store.open_output_stream(own) as out:
        out.write(MAGIC + np.array([len(s) for s in sections], "<u8").tobytes())
        for s in sections:
            out.write(s)
    store.move(own, at)


def read_file(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, token ids of all documents in a row, tokens per document."""
    store, at = _file_system(path)
    with store.open_input_stream(at) as f:
        raw = f.read()
    if raw[:4] != MAGIC:
        raise ValueError(f"{path} has no tokens")
    ends = 44 + np.cumsum(np.frombuffer(raw, "<u8", 5, 4))
    docs, rank, counts, control, data = (raw[a:b] for a, b in zip([44, *ends[:-1].tolist()], ends.tolist(), strict=True))
    counts = np.frombuffer(counts, "<u8").astype(np.int64)
    column = pa.ipc.open_stream(docs).read_all().column("id").combine_chunks()
    return column, decode_ids(np.frombuffer(rank, "<u4"), np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), int(counts.sum())), counts


def _written(path: str, tokenizer: str, end_id: int, most: int):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        encode = encoder(tokenizer)

        def out() -> pa.RecordBatch:
            n = np.concatenate(counts)
            write_file(file_name(path, part, number), pa.concat_arrays(names), np.concatenate(ids), n)
            row = {"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32())}
            for kept in (names, ids, counts):
                kept.clear()
            return pa.RecordBatch.from_pydict(row | {"docs": pa.array([len(n)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

        for batch in batches:
            texts = batch.column("_text")
            for a, b in slices(texts, min(BATCH_CHARS, most)):
                x, n = encode.encode(texts.slice(a, b - a).to_pylist())
                whole = np.full(len(x) + len(n), end_id, np.uint16 if encode.vocabulary <= 1 << 16 else np.uint32)
                ends = np.cumsum(n + 1)
                whole[ragged(ends - n - 1, n)] = x
                if counts and held + len(whole) > most:
                    yield out()
                    number, held = number + 1, 0
                names.append(batch.column("_id").slice(a, b - a))
                ids.append(whole)
                counts.append(n + 1)
                held += len(whole)
        if counts:
            yield out()

    return rows


def file_name(path: str, part: int, number: int) -> str:
    return f"{path}/part-{part:06d}-{number:06d}.pgt"


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, files: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", file_tokens: int = FILE_TOKENS,
) -> tuple[str, DataFrame]:
    """Writes the files of ``files`` ranges of ids; their folder, and a row for each: part (range), number (file of the
    range), docs, tokens, start (tokens in the files before)."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or scratch(spark, "token-files")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumns({"_h": F.xxhash64("_text"), "_tie": F.monotonically_increasing_id()})
    # The tie only tells rows apart that are equal in id and text, so that many of them are no single task's.
    ranged = rows.repartitionByRange(files, "_id", "_h", "_tie").sortWithinPartitions("_id", "_h", "_tie").select("_id", "_text")
    done = ranged.mapInArrow(_written(path, tokenizer, end_id, file_tokens), "part int, number int, docs bigint, tokens bigint")
    done = stored(done, "token-parts").withColumn("_block", F.col("part").cast("bigint") * (1 << 32) + F.col("number"))
    starts = block_starts(done.select("_block", F.col("tokens").alias("_sum")))
    return path, done.join(starts, "_block").select("part", "number", "docs", "tokens", F.col("_start").alias("start"))


def _read(path: str):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                names, ids, counts = read_file(file_name(path, file["part"], file["number"]))
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [names, pa.array(file["start"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "start", "n_tokens", "ids_crc32"])

    return rows


def read_tokens(spark: SparkSession, path: str, parts: DataFrame, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """A row for each document in the files: id, start, n_tokens, ids_crc32."""
    out = T.StructType([T.StructField("_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("part", "number", "start").repartition(n, "part", "number").mapInArrow(_read(path), out).withColumnRenamed("_id", id_col)
