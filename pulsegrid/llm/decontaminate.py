"""Benchmark decontamination by a broadcast hash set of the test set's word windows.

Words are runs of characters outside the ASCII non-alphanumerics, A-Z lower-cased. A window is ``width`` consecutive
words of an item, or a shorter item whole. Three steps, all within the row but for the last:

1. A window of k words that occurs in a document covers a whole chunk of (k + 1) // 2 words that starts at a multiple
   of that number. Only documents with such a chunk in the hash set of the windows' chunks go on: n / 5 look-ups for
   n words, and no false negatives.
2. In those, every window's hash is looked up in the hash set of windows.
3. Hits are verified as text by a join with the windows, which also gives the items.

The two hash sets are constants of the plan and reach the workers with the broadcast task: as sets of up to
INLINE_HASHES hashes, beyond as a Bloom filter of BITS_A_HASH bits for each hash, at most MOST_BITS. So the filter
stands at every size of the test set; beyond some 10**7 windows it lets more pass to step 3, which is exact. No text is
shuffled.

Defined cases: a null or empty text has no words and is clean; items without words have no windows; a null item_id
contaminates but is not listed; repeated rows are judged each; extra columns are carried by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, let, text_of

WIDTH = 10
#: Hashes that are sent as sets at most, about 40 bytes each.
INLINE_HASHES = 100_000
#: Bits of a Bloom filter for each hash, and at most (32 MiB), and those that a hash sets.
BITS_A_HASH, MOST_BITS, PROBES = 32, 1 << 28, 4
#: Windows that are broadcast for verification at most (each some 100 bytes).
BROADCAST_WINDOWS = 200_000
#: Shares that a window's rows are dealt into where windows are too many to be broadcast.
SALTS = 16
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return let(F.trim(F.regexp_replace(ascii_lower(text), _NOT_WORD, " ")), lambda flat: F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ")))


def _hash_at(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, (at + j).cast("int")) for j in range(k)])


def windows_of(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: _k (words), _window (words with spaces) and _items (ids of their items as sorted strings)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_item"), words_of(text_of(text_col)).alias("_w")).filter(F.size("_w") > 0)
    k = F.least(F.size("_w"), F.lit(width))
    rows = items.select("_item", k.alias("_k"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.array_join(F.slice("_w", i, k), " "))).alias("_window"))
    return rows.groupBy("_k", "_window").agg(F.collect_set("_item").alias("_items"))


def _chunk_hashes(words: Column, last: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), last), lambda i: _hash_at(words, i, k))


def _bloom(hashes: DataFrame, count: int) -> Callable[[Column], Column]:
    """Whether a hash may be among those of a column h: tests of bits in a constant of the plan."""
    size = 1 << 15
    while size < min(count * BITS_A_HASH, MOST_BITS):
        size *= 2
    place = lambda h, i: F.pmod(F.xxhash64(h, F.lit(i)), F.lit(size))
    at = hashes.select(F.explode(F.array(*[place(F.col("h"), i) for i in range(PROBES)])).alias("at"))
    pages = at.select(F.shiftright("at", 15).cast("int").alias("page"), F.col("at").bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    bits = bytearray(size >> 3)
    for r in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("b")).collect():  # at most MOST_BITS
        bits[r["page"] << 12 : (r["page"] + 1) << 12] = r["b"]
    sent = F.lit(bits)

    def has(h: Column) -> Column:
        byte = lambda x: F.conv(F.hex(F.substring(sent, (F.shiftright(x, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = lambda x: F.getbit(byte(x), x.bitwiseAND(F.lit(7)).cast("int")) == 1
        return reduce(lambda a, i: a & let(place(h, i), bit), range(1, PROBES), let(place(h, 0), bit))

    return has


def _any_chunk_in(words: Column, n: Column, k: int, has: Callable[[Column], Column]) -> Column:
    return (n > 0) & F.exists(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: has(_hash_at(words, i * k, k)))


def _windows_in(words: Column, k: int, has: Callable[[Column], Column]) -> Column:
    last = F.size(words) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(starts, lambda i: has(_hash_at(words, i, k)))
    window = lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " ")
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(k).alias("k"), window(i).alias("window")))


class HashSets:
    """Tests of hashes of the windows and of their chunks, by number of words."""

    def __init__(self, windows: DataFrame, inline: int = INLINE_HASHES):
        words = windows.select("_k", F.split("_window", " ").alias("_w")).persist()
        try:
            self.sizes: list[int] = sorted(r["_k"] for r in words.select("_k").distinct().collect())  # at most ``width`` rows
            self.count = words.count()
            whole, parts = {}, {}
            for k in self.sizes:
                c, own = (k + 1) // 2, words.filter(F.col("_k") == k)
                whole[k] = own.select(_hash_at(F.col("_w"), F.lit(0), k).alias("h"))
                chunks = own.select(F.explode(_chunk_hashes(F.col("_w"), F.lit(k - c), c)).alias("h")).distinct()
                parts[c] = parts[c].union(chunks) if c in parts else chunks
            self.windows, self.chunks = ({k: self._test(h, inline) for k, h in by.items()} for by in (whole, parts))
        finally:
            words.unpersist()

    @staticmethod
    def _test(hashes: DataFrame, inline: int) -> Callable[[Column], Column]:
        some = hashes.limit(inline + 1).collect()  # bounded by inline
        if len(some) > inline:
            return _bloom(hashes, hashes.count())
        known = sorted({r["h"] for r in some})
        return lambda h: h.isin(known)

    def suspects(self, words: Column) -> Column:
        """Whether a document has a chunk in the hash set."""

        def any_of(w: Column) -> Column:
            out = F.lit(False)
            for c, has in self.chunks.items():
                out = out | _any_chunk_in(w, F.floor(F.size(w) / c).cast("int"), c, has)
            return out

        return let(words, any_of)

    def hits(self, words: Column) -> Column:
        """array<struct<start, k, window>> of the windows in the hash set."""
        if not self.sizes:
            return F.array().cast("array<struct<start:int,k:int,window:string>>")
        return let(words, lambda w: F.concat(*[_windows_in(w, k, self.windows[k]) for k in self.sizes]))


def _verified(rows: DataFrame, windows: DataFrame, sets: HashSets, most: int | None = None) -> DataFrame:
    """rows (with _words) by row key: _starts, the verified hits, and _found, the sorted ids of their items.

    Up to ``most`` windows (BROADCAST_WINDOWS) are broadcast. Beyond, the join is dealt: a row without hits goes by a key
    of its own, and each window stands SALTS times, so that one in very many texts is no single task's."""
    few = sets.count <= (BROADCAST_WINDOWS if most is None else most)
    hit = F.when(sets.suspects(F.col("_words")), sets.hits(F.col("_words")))
    keep = [c for c in rows.columns if c != "_words"]
    hits = rows.select(*keep, F.explode_outer(hit).alias("_hit")).select(*keep, F.col("_hit.start").alias("_start"), F.col("_hit.k").alias("_k"), F.col("_hit.window").alias("_window"))
    if few:
        joined = hits.join(F.broadcast(windows), ["_k", "_window"], "left")
    else:
        own = F.xxhash64(*keep, F.coalesce("_start", F.lit(-1)))
        none = F.concat(F.lit("\n"), own.cast("string"))  # no window has a line end
        dealt = hits.withColumn("_salt", F.pmod(own, F.lit(SALTS)).cast("int")).withColumn("_w", F.coalesce("_window", none)).drop("_window")
        salted = windows.withColumnRenamed("_window", "_w").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.withColumn("_k", F.coalesce("_k", F.lit(0))).join(salted, ["_k", "_w", "_salt"], "left")
    # a struct's field is null, not the struct, for the rows without a hit
    at = F.when(F.col("_items").isNotNull(), F.struct("_start", "_k"))
    return joined.groupBy(*keep).agg(F.collect_list(at).alias("_starts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_found"))


def _covered(starts: Column) -> Column:
    """Positions of the words under any hit."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["_start"], s["_start"] + s["_k"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", inline: int = INLINE_HASHES) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted ids as strings), contaminated."""
    windows = windows_of(benchmark, width)
    sets = HashSets(windows, inline)
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), words_of(text_of(text_col)).alias("_words"))
    rows = rows.withColumn("_n", F.size("_words").cast("bigint"))
    return _verified(rows, windows, sets).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.size(_covered(F.col("_starts"))).cast("bigint").alias("n_hit"), F.col("_found").alias("items"), (F.size("_starts") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, text_col: str = "text", inline: int = INLINE_HASHES) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the words under hits taken out of their texts.

    What a text contains depends on the text alone, so hits meet their documents by digest. Documents without a chunk
    in the hash set pass unshuffled.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    windows = windows_of(benchmark, width)
    sets = HashSets(windows, inline)
    words, flag, sha, gone = free_names(docs, "_words", "_suspect", "_sha", "_gone")
    rows = docs.withColumn(words, words_of(text_of(text_col))).withColumn(flag, sets.suspects(F.col(words)))
    clean = rows.filter(~F.col(flag)).select(*[f"`{c}`" for c in docs.columns])
    suspects = rows.filter(flag).withColumn(sha, F.sha2(text_of(text_col), 256))
    texts = suspects.select(F.col(sha).alias("_key"), F.col(words).alias("_words")).dropDuplicates(["_key"])
    found = _verified(texts, windows, sets).filter(F.size("_starts") > 0)
    if remove == "documents":
        dirty = found.select(F.col("_key").alias(sha))
        return clean.union(suspects.join(dirty, sha, "left_anti").select(*[f"`{c}`" for c in docs.columns]))
    cut = found.select(F.col("_key").alias(sha), _covered(F.col("_starts")).alias(gone))
    return clean.union(suspects.join(cut, sha, "left").select(*[without_words(F.col(f"`{c}`"), F.col(gone)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]))


def without_words(text: Column, positions: Column) -> Column:
    """text without the words at some positions (null: as it is); what stands between words stays."""
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    words = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    gone = F.map_from_arrays(positions, positions)
    kept = let(gone, lambda m: F.transform(words, lambda w, i: F.when(F.map_contains_key(m, i), F.lit("")).otherwise(w)))
    merged = F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return F.when(positions.isNull() | (F.size(positions) == 0), text).otherwise(merged)


__all__: Sequence[str] = ["contamination", "decontaminate", "windows_of", "words_of", "without_words"]
