"""Text quality by a generalised additive model with pairwise interactions.

Features of a text are counted on arrays; each is cut into at most BINS bins. Training is cyclic boosting: round by
round, feature by feature, a shallow tree (at most four leaves) over that feature's bins is fitted to what is left
and added to the feature's table, then the same with a few pairs of features whose joint table explains most of the
rest. A score is the logistic of one table entry per feature and pair: additions of looked-up values, no tree walk.

The model is fitted on the driver on at most ``sample`` labelled rows (chosen by a hash of the id, features only);
scoring reads every whole text. Rows with crc32(id as text) mod FOLDS = 0 never train.

Defined cases: a null text is empty and gets a score like any other; ids labelled more than once count with their
mean label; null labels don't count; with no labels, or one kind only, every score is the smoothed share of ones;
repeated rows are scored each; an empty table gives an empty table; other columns are carried by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of
from .textvec import Words, lean, slices, whole

FOLDS, SAMPLE, THRESHOLD = 5, 20_000, 0.3
BINS, PAIR_BINS, PAIRS = 32, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 150, 60, 0.1, 20
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "stop_mark", "symbol", "blank", "newline", "wide", "log_words",
    "word_bytes", "distinct_words", "top_word", "short_words", "unclean_words", "repeated_lines", "line_bytes",
)
_KINDS = 8


def _byte_kinds() -> np.ndarray:
    out = np.full(256, 4, np.uint8)  # symbols
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 3
    out[[0x20, 0x09, 0x0D]], out[0x0A], out[0x80:] = 5, 6, 7
    return out


_KIND = _byte_kinds()


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _per_text(text: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each text, and the count of its most frequent one."""
    pairs, counts = np.unique(text.astype(np.int64) << 32 | code.astype(np.int64), return_counts=True)
    owner = pairs >> 32
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, counts)
    return np.bincount(owner, minlength=n), top


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text, a column for each of FEATURES."""
    texts = whole(texts)
    n = len(texts)
    if not n:
        return np.zeros((0, len(FEATURES)))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    words = Words(texts, lower=True)
    count = np.diff(words.starts)
    owner = np.repeat(np.arange(n), count)
    length = pc.binary_length(words.dictionary).to_numpy().astype(np.int64)
    unclean = pc.match_substring_regex(words.dictionary, "[^A-Za-z\\x{80}-\\x{10FFFF}.,;:!?'\"()-]").to_numpy(zero_copy_only=False)
    total = lambda x: np.bincount(owner, x[words.codes].astype(np.float64), minlength=n)
    distinct, top = _per_text(owner, words.codes, n)
    lines = pc.split_pattern(texts, "\n")
    starts = lines.offsets.to_numpy()
    line_owner = np.repeat(np.arange(n), np.diff(starts))
    encoded = lines.flatten().dictionary_encode()
    line_size = pc.binary_length(encoded.dictionary).to_numpy()[encoded.indices.to_numpy()]
    real = line_size > 0
    line_count = np.bincount(line_owner[real], minlength=n)
    line_distinct, _ = _per_text(line_owner[real], encoded.indices.to_numpy()[real], n)
    return np.column_stack([
        np.log1p(size), *[_share(kinds[:, k], size) for k in range(_KINDS)], np.log1p(count),
        _share(total(length), count), _share(distinct, count), _share(top, count), _share(total(length <= 3), count), _share(total(unclean), count),
        _share(line_count - line_distinct, line_count), np.log1p(_share(size, line_count)),
    ])


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # of each feature's bins
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # of the bins that pairs use
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-out))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins: gain, and the number of bins left of it (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST_ROWS) | (n.sum() - nl < LEAST_ROWS)] = 0
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1 if gain[best] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """What a tree of at most 2**depth leaves adds to each bin."""
    cut = _split(g, h, n)[1] if depth else 0
    if not cut:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut along one feature, then one along the other on either side."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        G, H, N = (x.T if flip else x for x in (g, h, n))
        for c in range(1, len(G)):
            gain, out = -_gain(G.sum(), H.sum()), np.zeros_like(G)
            for part in (slice(0, c), slice(c, None)):
                a, b, m = G[part].sum(0), H[part].sum(0), N[part].sum(0)
                more, cut = _split(a, b, m)
                gain += more + _gain(a.sum(), b.sum())
                for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                    out[part, cols] = _leaf(a[cols].sum(), b[cols].sum())
            if gain > best[0]:
                best = (float(gain), out.T if flip else out)
    return best


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: a row of features for each labelled text; y: 0 to 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(bias=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges, model.coarse = [_edges(x[:, f], BINS) for f in range(k)], [_edges(x[:, f], PAIR_BINS) for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(k)]
    raw = np.full(len(y), model.bias)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = left()
            m = len(model.tables[f])
            step = RATE * _tree(*(np.bincount(bins[f], w, m) for w in (g, h, np.ones(len(y)))))
            model.tables[f] += step
            raw += step[bins[f]]
    coarse = [np.searchsorted(model.coarse[f], x[:, f], "right") for f in range(k)]

    def joint(a: int, b: int, w: np.ndarray) -> np.ndarray:
        m = len(model.coarse[b]) + 1
        return np.bincount(coarse[a] * m + coarse[b], w, (len(model.coarse[a]) + 1) * m).reshape(-1, m)

    g, h = left()
    ones = np.ones(len(y))
    gains = sorted(((_pair_tree(joint(a, b, g), joint(a, b, h), joint(a, b, ones))[0], a, b) for a, b in combinations(range(k), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = left()
            step = RATE * _pair_tree(joint(a, b, g), joint(a, b, h), joint(a, b, ones))[1]
            table += step
            raw += step[coarse[a], coarse[b]]
    return model


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


@lean
def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("_text")):
            x = features(batch.column("_text").slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column("_h").slice(a, b - a), batch.column("_label").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["_h", "_label", "_x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), folds) != 0))
    chosen = usable.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_label")).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_h", "_label", "_text")
    found = rows.mapInArrow(_feature_rows, "_h bigint, _label double, _x array<double>")
    got = found.orderBy("_h", "_label", "_x").limit(sample).toPandas()  # numbers of at most ``sample`` rows, however often an id stands
    x = np.array(got["_x"].tolist()).reshape(len(got), len(FEATURES))
    order = np.lexsort(x.T[::-1])  # so that repeated rows come in one order
    return fit(x[order], got["_label"].to_numpy()[order])


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    parts = [model.score(features(texts.slice(a, b - a))) for a, b in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    small_batches(docs.sparkSession)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(model, batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["_id", "held_out", "score", "predicted"])

    out = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    rows_in = docs.select(F.col(id_col).alias("_id"), (fold_of(F.col(id_col), folds) == 0).alias("held_out"), text_of(text_col).alias("_text"))
    return rows_in.mapInArrow(rows, out).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject, as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at).cast(pa.string())) >= threshold))

    return docs.mapInArrow(rows, docs.schema)
