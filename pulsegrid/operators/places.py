"""Places by joins with a gazetteer of any size: names in free texts, and the place nearest to a point.

Names: the words of a text are taken apart once, runs of as many words as the longest name has are joined with the names
by what they say, and of overlapping matches the one that begins first stays, of those that begin together the longest.

Points: the plane of degrees is cut into square cells. A place is entered in its own cell and the eight around it, so a
point finds every place as near as a cell is wide in one cell, by one join, and takes the nearest there without a shuffle
of its own. Cells are small at first, by how close the places stand; a point that has found none so near looks on in
larger ones, up to cells of the largest distance that counts.

A gazetteer of at most BROADCAST_ROWS rows is broadcast, a larger one is joined by shuffles, which Spark splits where a
name or cell is hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import once
from ..sources.shared import cut

BROADCAST_ROWS = 100_000
#: Of so many places at most all are looked at in cells of the largest distance; of more a smallest cell holds at least CROWD on average.
FEW, CROWD, MOST_HALVINGS = 64, 2, 12


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has few rows; only so many are looked at to know."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words(text: Column) -> Column:
    """Words of letters and digits in lower case; dots are left out, so that d.c. is dc."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("."), F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))


def _apart(found: Column) -> Column:
    """Of matches (start, -words, ...) in order those that begin behind the end of the last one taken."""
    end = lambda taken: F.coalesce(F.element_at(taken, -1)["start"] - F.element_at(taken, -1)["less"], F.lit(0))
    return F.aggregate(found, F.slice(found, 1, 0), lambda taken, m: F.when(m["start"] >= once(taken, lambda t: F.when(F.size(t) > 0, end(t)).otherwise(0)), F.concat(taken, F.array(m))).otherwise(taken))


def names_in_texts(texts: DataFrame, names: DataFrame, text_col: str = "text", id_col: str = "id", name_col: str = "name", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, name, start, words): each place where a text has a name as words; start counts words from 0.

    Defined cases: null and empty texts have none; names without words are no names; of names that read the same the first
    by order counts. Ids need not be unique: each row's matches are its own."""
    known = names.select(F.col(name_col).alias("name"), words(F.col(name_col)).alias("_w")).filter(F.size("_w") > 0)
    known = known.groupBy(F.array_join("_w", " ").alias("_key")).agg(F.min("name").alias("name"), F.first(F.size("_w")).alias("_n"))
    sizes = sorted(r["_n"] for r in known.select("_n").distinct().collect())  # lengths of names
    listed = texts.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("_row"), words(F.col(text_col)).alias("_w"))
    last = F.size("_w")

    def runs(n: int) -> Column:
        starts = F.when(last >= n, F.sequence(F.lit(0), F.greatest(last - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(-n).alias("less"), F.array_join(F.slice("_w", i + 1, n), " ").alias("key")))

    none = F.array().cast("array<struct<start:int,less:int,key:string>>")
    every = listed.select("id", "_row", F.explode(F.concat(none, *[runs(n) for n in sizes])).alias("_m")).select("id", "_row", "_m.*")
    hits = every.join(_small(known.select("_key", "name"), broadcast_rows), F.col("key") == F.col("_key"))
    own = F.array_sort(F.collect_list(F.struct("start", "less", "name")))
    found = hits.groupBy("_row").agg(F.first("id").alias("id"), own.alias("_all"))
    return found.select("id", F.explode(_apart(F.col("_all"))).alias("_m")).select("id", "_m.name", "_m.start", (-F.col("_m.less")).alias("words"))


def cells(places: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    """(_cy, _cx, _places): the places of each cell and of the eight around it, as structs of all their columns."""
    step = F.array(*map(F.lit, (-1, 0, 1)))
    at = lambda c: F.floor(F.col(c) / size)
    rows = places.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    rows = rows.select(F.struct("*").alias("_p"), at(lat).alias("_y"), at(lon).alias("_x")).select("_p", "_x", F.explode(F.transform(step, lambda d: F.col("_y") + d)).alias("_cy"))
    rows = rows.select("_p", "_cy", F.explode(F.transform(step, lambda d: F.col("_x") + d)).alias("_cx"))
    return rows.groupBy("_cy", "_cx").agg(F.collect_list("_p").alias("_places"))


def with_nearest(points: DataFrame, places: DataFrame, lat: Column, lon: Column, most: float = 0.8, order: str = "i", name: str = "near", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """points with a struct ``name``: far (degrees) and the columns of the nearest place (lat, lon, ...) within ``most``; of equally
    near ones the first by ``order``. Null for points without coordinates or without such a place."""
    kind = places.schema
    sizes = _sizes(places, most)
    if len(sizes) > 1:  # of places on one spot the first is enough
        first = places.groupBy("lat", "lon").agg(F.min(F.struct(F.col(order).alias("_o"), F.struct("*").alias("_p"))).alias("_m"))
        places = cut(first.select("_m._p.*"))
    far = lambda p: F.sqrt((lat - p["lat"]) * (lat - p["lat"]) + (lon - p["lon"]) * (lon - p["lon"]))
    scored = F.transform("_places", lambda p: F.struct(far(p).alias("far"), p[order].alias("_o"), p.alias("_p")))
    rows = points.withColumn(name, F.lit(None))
    for i, size in enumerate(sizes):
        # Within one cell of a point is what is nearer than a cell is wide; a little less, as cells are found by a division.
        near = F.col("_best")["far"] <= (size * (1 - 1e-9) if size < most else most)
        best = F.when(near, F.struct(F.col("_best")["far"].alias("far"), *[F.col("_best")["_p"][f.name].alias(f.name) for f in kind]))
        y, x = F.floor(lat / size), F.floor(lon / size)
        if i:  # points that have found theirs look for a cell that is not there, dealt out
            y = F.when(F.col(name).isNull(), y).otherwise(-(1 << 50) - F.pmod(F.xxhash64(lat, lon), F.lit(1 << 20)))
        table = cells(places, "lat", "lon", size)
        met = rows.withColumns({"_y": y, "_x": x}).join(_small(table, broadcast_rows), (F.col("_y") == F.col("_cy")) & (F.col("_x") == F.col("_cx")), "left")
        met = met.withColumn("_best", F.array_min(scored))
        rows = met.withColumn(name, F.coalesce(name, best) if i else best).drop("_y", "_x", "_cy", "_cx", "_places", "_best")
    return rows


def _sizes(places: DataFrame, most: float) -> list[float]:
    """Widths of cells to look in, one after the other."""
    known = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    n, *ends = known.agg(F.count(F.lit(1)), *[f(F.col(c).cast("double")) for c in ("lat", "lon") for f in (F.min, F.max)]).first()
    if n <= FEW or not all(map(math.isfinite, ends)):
        return [most]
    wanted = math.sqrt(CROWD * (ends[1] - ends[0]) * (ends[3] - ends[2]) / n) or most
    halvings = min(MOST_HALVINGS, max(0, math.floor(math.log2(most / wanted))))
    return [most / 2**k for k in range(halvings, 0, -2)] + [most]
