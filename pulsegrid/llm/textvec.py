"""Whole batches of texts as arrays: words and hashes of runs of words, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters that are worked on at a time: bounds a worker's memory whatever the length of the texts.
BATCH_CHARS, BATCH_ROWS = 2_000_000, 32_768
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def whole(texts: pa.Array) -> pa.Array:
    """texts as large strings, null as empty, in buffers of their own.

    The string functions of pyarrow misread arrays that begin inside of their buffers, as slices do.
    """
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


@cache
def _allocator() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def lean(rows: Callable) -> Callable:
    """A function over batches whose worker gives the memory of a task back when it is done: workers live on."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def lean_group(rows: Callable) -> Callable:
    """The same for a function over the table of a group, after each group."""

    @wraps(rows)
    def run(group: pa.Table) -> pa.Table:
        out = rows(group)
        give_back()
        return out

    return run


def give_back() -> None:
    """Returns to the machine what this worker has freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_allocator(), "malloc_trim", None):
        trim(0)


def slices(texts: pa.Array, chars: int = BATCH_CHARS, rows: int = BATCH_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text each, at least one row and at most ``rows``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + chars, "right"))))
        yield start, stop
        start = stop


class Words:
    """The words of a batch: ``codes`` (of each word, into ``dictionary``) and ``starts`` (of each text, one more at the end)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = whole(texts)
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)  # white space: 20, 09-0D
        values = parts.values.slice(parts.offsets[0].as_py(), parts.offsets[-1].as_py() - parts.offsets[0].as_py()) if len(parts) else parts.values
        encoded = values.dictionary_encode()
        codes, self.dictionary = encoded.indices.to_numpy(), encoded.dictionary
        offsets = parts.offsets.to_numpy().astype(np.int64) - (parts.offsets[0].as_py() if len(parts) else 0)
        empty = pc.index(self.dictionary, "").as_py()
        if empty >= 0:  # what stands before white space at the start and after it at the end
            real = codes != empty
            kept = np.concatenate([[0], np.cumsum(real)])
            codes, offsets = codes[real], kept[offsets]
        self.codes, self.starts = codes, offsets if len(offsets) else np.zeros(1, np.int64)

    def hashes(self) -> np.ndarray:
        """64 bits for each entry of the dictionary."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(self.dictionary))


def run_hashes(words: Words, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words within a text, and where each text's begin (one more at the end).

    A text of fewer words than n, but not none, has one run of all its words.
    """
    h = (words.hashes() if hashes is None else hashes)[words.codes]
    counts = np.diff(words.starts)
    runs = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    starts = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(words.starts[:-1] - starts[:-1], runs) + np.arange(starts[-1])
    left = np.repeat(words.starts[1:], runs) - first
    out = np.full(len(first), n, np.uint64)
    for j in range(n):
        at = np.minimum(first + j, max(len(h) - 1, 0))
        nxt = mix(out * _MULTIPLIER + h[at]) if len(h) else out
        out = np.where(left > j, nxt, out)
    return out, starts


def five(x: np.ndarray) -> bytes:
    """Whole numbers below 2**40 in five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each pair, in one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
