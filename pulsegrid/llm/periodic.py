"""Periodic runs of words: stretches that repeat a passage back to back, however long the passage.

A run is a maximal stretch of words with smallest period q (words q apart are the same) of at least LEAST_LENGTH words
and LEAST_TURNS periods. For every lag the number of places whose words agree is counted first, exactly: for words that
a text holds often by autocorrelation (a Fourier transform of the places of each), for rare ones by the differences of
pairs of their places. A run of period q has max(LEAST_LENGTH - q, (LEAST_TURNS - 1) q) agreeing places in a row (an
island), so only lags with as many in all are scanned for islands. What runs found at a divisor of the lag account for
is subtracted before, so a text that is one long run is scanned at its period and not at all multiples.

An island that long meets at least eight of the places that are a multiple of an eighth of its length; only where
eight in a row agree is every place looked at. So a scan at lag q costs some n / q steps beside its islands.

A text is worked on whole, in one task; a batch holds some 2,000,000 characters or one longer text.

Defined cases: a null text has no words, so no runs, and collapses to an empty one; a text of white space too. Ids are
not read: repeated rows and null ids are carried like others. Words differ in case. Extra columns are carried; one
with the name of a new column gives way to it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, small_batches
from .textvec import Words, lean, slices, whole

LEAST_LENGTH, LEAST_TURNS = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Numbers of a Fourier transform that are worked on at a time.
_AT_A_TIME = 1 << 22


def frequent_from(n: int) -> int:
    """The frequency from which a transform costs less than all pairs of places do, for a text of n words."""
    size = max(2 * n, 2)
    return max(32, int(np.sqrt(2 * size * np.log2(size))))


def _heavy(codes: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Agreeing places at lags 0 to most of the words named, by autocorrelation."""
    size = 1 << int(len(codes) + most).bit_length()  # room enough that nothing wraps around
    step = max(1, _AT_A_TIME // size)
    power = np.zeros(size // 2 + 1)
    for i in range(0, len(words), step):
        f = np.fft.rfft(codes == words[i : i + step, None], size)
        power += (f.real**2 + f.imag**2).sum(axis=0)
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, starts: np.ndarray, most: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts starts[i]:starts[i+1] of codes: agreeing places at lags 0 to most[i], and where each text's begin."""
    sizes = np.diff(starts)
    base = np.concatenate([[0], np.cumsum(most + 1)])
    out = np.zeros(base[-1], np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    often = count > frequent[text[order[first]]]
    for t in np.unique(text[order[first[often]]]):
        own = first[often][text[order[first[often]]] == t]
        out[base[t] : base[t + 1]] += _heavy(codes[starts[t] : starts[t + 1]], codes[order[own]], int(most[t]))
    # Rare words: each place with the next of its word, the one after that, and so on, as far as a lag may go.
    place = order[np.repeat(~often, count)]
    key = key[np.repeat(~often, count)]
    at, k = np.arange(len(place)), 1
    while len(at := at[at + k < len(place)]):
        lag = place[at + k] - place[at]
        there = (key[at + k] == key[at]) & (lag <= most[text[place[at]]])
        at, lag = at[there], lag[there]
        np.add(out, np.bincount(base[text[place[at]]] + lag, minlength=len(out)), out=out) if len(at) > len(out) >> 4 else np.add.at(out, base[text[place[at]]] + lag, 1)
        k += 1
    return out, base


def islands(codes: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of at least ``least`` places i with codes[i] == codes[i + lag]."""
    n, step = len(codes) - lag, least // 8
    parts = [(0, n)]
    if step > 1:
        off = np.flatnonzero(np.append(codes[:n:step] != codes[lag : lag + n : step], True))
        before = np.append(-1, off[:-1])
        long = off - before > 8
        parts = [(max(0, a * step + 1), min(n, b * step)) for a, b in zip(before[long].tolist(), off[long].tolist(), strict=True)]
    out = []
    for a, b in parts:
        off = a + np.flatnonzero(np.append(codes[a:b] != codes[a + lag : b + lag], True))
        before = np.append(a - 1, off[:-1])
        long = off - before > least
        out += zip((before[long] + 1).tolist(), off[long].tolist(), strict=True)
    return out


def _runs(codes: np.ndarray, lags: np.ndarray, counts: np.ndarray, length: int, turns: int) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q, count in zip(lags.tolist(), counts.tolist(), strict=True):
        least = max(length - q, (turns - 1) * q, 1)
        known = sum(e - s - q for (s, e), p in found.items() if q % p == 0 and e - s >= turns * q)
        if count - known >= least:
            for a, b in islands(codes, q, least):
                found.setdefault((a, b + q), q)  # lags ascend: a stretch has its smallest period first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def find_runs(codes: np.ndarray, starts: np.ndarray, length: int = LEAST_LENGTH, turns: int = LEAST_TURNS, frequent: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, by start, then period. frequent: in place of ``frequent_from``."""
    sizes = np.diff(starts)
    most = np.where(sizes >= max(length, turns), sizes // turns, 0)
    from_ = np.full(len(sizes), frequent) if frequent else np.array([frequent_from(n) for n in sizes.tolist()], np.int64)
    counts, base = lag_counts(codes, starts, most, from_)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    lag = np.arange(len(counts)) - np.repeat(base[:-1], most + 1)
    enough = np.flatnonzero((lag > 0) & (counts >= np.maximum(length - lag, (turns - 1) * lag)))
    of = np.searchsorted(base, enough, "right") - 1
    for t in np.unique(of).tolist():
        own = enough[of == t] if len(of) < 64 else enough[np.searchsorted(of, t) : np.searchsorted(of, t, "right")]
        out[t] = _runs(codes[starts[t] : starts[t + 1]], lag[own], counts[own], length, turns)
    return out


def _kept(n: int, starts: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Whether each word stays: none of its text's runs holds it behind the run's first period."""
    change = np.zeros(n + 1, np.int64)
    for s, found in zip(starts.tolist(), runs, strict=False):
        for start, length, period in found:
            change[s + start + period] += 1
            change[s + start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _found(length: int, turns: int):
    """Of batches whose last column is the text."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = whole(batch.columns[-1])
            for a, b in slices(texts):
                w = Words(texts.slice(a, b - a), lower=False)
                runs = find_runs(w.codes, w.starts, length, turns)
                kept = _kept(len(w.codes), w.starts, runs)
                ends = np.concatenate([[0], np.cumsum(kept)])[w.starts]
                words = pa.LargeListArray.from_arrays(pa.array(ends), w.dictionary.take(pa.array(w.codes[kept])))
                spans = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(w.starts)), spans, pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=[*part.schema.names[:-1], "_n", "_runs", "_kept"])

    return rows


def periodic_runs(
    docs: DataFrame, text_col: str = "text", length: int = LEAST_LENGTH, turns: int = LEAST_TURNS, names: tuple[str, str, str] = ("n_words", "runs", "collapsed")
) -> DataFrame:
    """docs with the number of words, an array of runs by start, and the text without what repeats: the words that no run
    holds behind its first period, joined by one space."""
    if length < 2 or turns < 2:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)
    new = {n.lower() for n in names}
    carried = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in new]
    given = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    given = given.select(*[f"_c{i}" for i, _ in carried], F.col(f"_c{docs.columns.index(text_col)}").cast("string").alias("_text"))
    out = T.StructType([*given.schema.fields[:-1], T.StructField("_n", T.LongType()), T.StructField("_runs", T.DataType.fromDDL(f"array<{RUN}>")), T.StructField("_kept", T.StringType())])
    return given.mapInArrow(_found(length, turns), out).toDF(*[c for _, c in carried], *names)


def collapse_runs(docs: DataFrame, text_col: str = "text", length: int = LEAST_LENGTH, turns: int = LEAST_TURNS) -> DataFrame:
    """docs as they are, but with texts that hold a run collapsed."""
    n, runs, kept = free_names(docs, "_n", "_runs", "_kept")
    out = periodic_runs(docs, text_col, length, turns, (n, runs, kept))
    return out.withColumn(text_col, F.when(F.size(runs) > 0, F.col(kept)).otherwise(F.col(text_col))).select(*docs.columns)


def longest_run(runs):
    """Of an array of runs the one of the most periods, exactly; of equal ones the first. Null without runs."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
