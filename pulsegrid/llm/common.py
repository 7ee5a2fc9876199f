"""Shared storage, bounded membership filters and small expressions for the text operators."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a membership filter for each row it may be made of, and their least and most powers of two (64 MiB).
BITS_A_ROW, LEAST_POWER, MOST_POWER = 32, 20, 29
_ROW_BITS = 15
#: Blocks that are summed up in one window; more are summed in groups of GROUP first.
MOST_BLOCKS, GROUP = 100_000, 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; only where that is unset (tests) a local one.

    On a cluster a folder of one machine is of no use to the others, so there the setting must be there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='pulsegrid-')}"
        shared_dir.own = found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, megabytes: int = 2) -> None:
    """Bounds what a task hands to its Python worker at a time in bytes (the default of 64 MiB stands several times in
    the task's memory, and texts differ in length), for this session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/pulsegrid/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: later reads need none of its lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _tidy(spark)
    return out


def _tidy(spark: SparkSession, every: float = 15.0) -> None:
    """Spark removes the files of a shuffle when the driver's collector finds that no plan needs it. It may run seldom,
    so that all shuffles of a long operator pile up; this asks for it now and then."""
    if time.monotonic() - getattr(_tidy, "last", 0.0) > every:
        spark._jvm.java.lang.System.gc()
        _tidy.last = time.monotonic()


def free(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that no one reads any more; they would go when the driver ends."""
    for df in tables:
        _remove(df.sparkSession, df._stored_at)


def text_of(name: str) -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, _UPPER, _LOWER)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted which df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def filter_power(rows: int) -> int:
    """The size of a filter over the keys of so many rows, as a power of two of bits."""
    power = LEAST_POWER
    while power < MOST_POWER and 1 << power < rows * BITS_A_ROW:
        power += 1
    return power


def key_filter(keys: DataFrame, key: Sequence[Column], power: int) -> DataFrame:
    """A bitmap over hashed keys in rows of 4096 bytes, at most 64 MiB in all, so it can always be broadcast.

    Beyond some 10**8 keys it fills up and lets more rows through; whoever uses it joins what it lets through exactly.
    """
    h = F.pmod(F.xxhash64(*key), F.lit(1 << power))
    return (
        keys.select(F.shiftright(h, _ROW_BITS).alias("_fb"), h.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_fp"))
        .groupBy("_fb")
        .agg(F.bitmap_construct_agg("_fp").alias("_fbits"))
    )


def maybe_in(df: DataFrame, key: Sequence[Column], bitmap: DataFrame, name: str, power: int) -> DataFrame:
    """df with a boolean column: false means that the key is not among the filter's (of the same power)."""
    h, b, bits = free_names(df, f"_h_{name}", f"_b_{name}", f"_bits_{name}")
    bitmap = bitmap.withColumnsRenamed({"_fb": b, "_fbits": bits})
    df = df.withColumn(h, F.pmod(F.xxhash64(*key), F.lit(1 << power)))
    at = F.col(h).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        df.join(F.broadcast(bitmap), F.shiftright(F.col(h), _ROW_BITS) == F.col(b), "left")
        .withColumn(name, F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)))
        .drop(h, b, bits)
    )


class Bits:
    """A Bloom filter for Python workers over 64-bit keys that are hashes already: two places from a key's two halves.

    It has BITS_A_KEY bits a key within LEAST_BITS and MOST_BITS (64 MiB), a bound on what is broadcast. Beyond some
    10**7 keys it lets more and more through, which costs time only: who uses it counts what it lets through.
    """

    BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 29

    def __init__(self, sent: Broadcast, size: int):
        self.sent, self.size = sent, size

    @classmethod
    def of(cls, keys: DataFrame, key: str) -> Bits:
        """Of a column of a stored table, which is read twice."""
        size = cls.LEAST_BITS
        wanted = keys.count() * cls.BITS_A_KEY
        while size < min(wanted, cls.MOST_BITS):
            size *= 2
        places = F.array(F.col(key).bitwiseAND(F.lit(size - 1)), F.shiftright(key, 32).bitwiseAND(F.lit(size - 1)))
        at = keys.select(F.explode(places).alias("_at"))
        page, bit = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        pages = at.select(page.cast("int").alias("_page"), bit.alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        out = np.zeros(size >> 3, np.uint8)
        step = 1 << (_ROW_BITS - 3)
        for r in pages.collect():  # at most MOST_BITS
            out[r["_page"] * step : (r["_page"] + 1) * step] = np.frombuffer(bytes(r["_bits"]), np.uint8)
        return cls(keys.sparkSession.sparkContext.broadcast(out), size)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each int64 key may be there."""
        bits, last = self.sent.value, np.int64(self.size - 1)
        at = keys & last
        there = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        at = (keys >> np.int64(32))[there] & last
        there[there] = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return there


def block_starts(sums: DataFrame, most: int = MOST_BLOCKS, group: int = GROUP) -> DataFrame:
    """(_block, _start) of (_block, _sum): the sum of all blocks before. No task sums more than most or group rows."""
    before = lambda w: F.coalesce(F.sum("_sum").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if sums.count() <= most:
        return sums.select("_block", before(Window).alias("_start"))
    grouped = sums.withColumn("_group", F.floor(F.col("_block") / group))
    above = stored(grouped.groupBy("_group").agg(F.sum("_sum").alias("_sum")).withColumnRenamed("_group", "_block"), "blocks")
    above = block_starts(above, most, group).toDF("_group", "_above")
    within = grouped.select("_group", "_block", before(Window.partitionBy("_group")).alias("_within"))
    return within.join(above, "_group").select("_block", (F.col("_above") + F.col("_within")).alias("_start"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row: a plain column would be put in each place, within lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of longs, in blocks so that long arrays stay cheap."""

    def of_blocks(blocks: Column) -> Column:
        inner = F.transform(blocks, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: array_sum(F.slice(x, F.lit(1), i))))
        before = let(F.transform(blocks, array_sum), lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: array_sum(F.slice(t, F.lit(1), i))))
        return F.flatten(F.zip_with(inner, before, lambda x, o: F.transform(x, lambda v: v + o)))

    def of(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, F.lit(block)))
        return F.when(F.size(a) > 0, let(blocks, of_blocks)).otherwise(F.array().cast("array<bigint>"))

    return let(values, of)
