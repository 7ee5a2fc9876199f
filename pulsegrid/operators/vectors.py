"""Vectors in a table: nearest neighbours, centroids and the classes nearest to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import once
from ..sources.shared import cut
from .tables import upsert


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column) -> Column:
    """a with a norm of 1; the zero vector as it is."""
    return once(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return once(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(0.0))


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k most similar vectors to one query vector; top k of each task first, then of those."""
    out = vectors.withColumn("score", cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])))
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), id_col).limit(k)


def centroids(vectors: DataFrame, by: str, vec_col: str = "embedding") -> DataFrame:
    """(by, centroid): the mean of normalised vectors, normalised."""
    unit = vectors.select(by, F.posexplode(scaled(F.col(vec_col))).alias("i", "x"))
    means = unit.groupBy(by, "i").agg(F.avg("x").alias("x")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("_c"))
    return means.select(by, scaled(F.col("_c")).alias("centroid"))


def centroid_drift(vectors: DataFrame, flag: str, threshold: float = 0.25, vec_col: str = "embedding") -> DataFrame:
    """One row: 1 - cosine between the centroids of the rows with flag false and true, and whether that is a drift."""
    c = centroids(vectors, flag, vec_col)
    both = c.agg(F.max(F.when(~F.col(flag), F.col("centroid"))).alias("a"), F.max(F.when(F.col(flag), F.col("centroid"))).alias("b"))
    return both.select(F.round(F.coalesce(1 - dot(F.col("a"), F.col("b")), F.lit(0.0)), 4).alias("drift")).withColumn("is_semantic", F.col("drift") >= threshold)


def nearest_class(vectors: DataFrame, classes: dict[str, Sequence[float]], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, class, similarity): the best of a fixed list of class vectors, an expression in the row."""
    scores = F.array(*[F.struct(cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in v])).alias("s"), F.lit(name).alias("c")) for name, v in sorted(classes.items(), reverse=True)])
    best = F.array_max(scores)
    return vectors.select(id_col, best["c"].alias("class"), F.round(F.greatest(F.lit(0.0), best["s"]), 3).alias("similarity"))


def softmax(scores: Column, temperature: float = 0.15) -> Column:
    powers = once(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp((x - top) / max(1e-3, temperature))))
    return once(powers, lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda t: F.transform(e, lambda x: x / t)))


# --- ids and collections -------------------------------------------------------------------------------------------

# Fixed value: the namespace of names that are domain names.
_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def _uuid(h: Column) -> Column:
    """32 hex digits with hyphens."""
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])


def point_id(c: Column) -> Column:
    """The id that a vector store takes: a whole number of 64 bits without a sign as it is, a UUID in its usual form,
    and for any other text the UUID (version 5) of that name."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^\+?\d+(_\d+)*$|^-0+$"), F.regexp_replace(text, "[+_-]", "")).try_cast("decimal(38,0)")
    bare = F.lower(F.regexp_replace(F.regexp_replace(c.cast("string"), "^(urn:)?(uuid:)?", ""), r"^[{}]+|[{}]+$|-", ""))
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS)), F.encode(c.cast("string"), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"), F.lit(1))
    made = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    whole = F.when((number >= 0) & (number <= F.lit("18446744073709551615").cast("decimal(38,0)")), number.cast("string"))
    return F.coalesce(whole, F.when(bare.rlike("^[0-9a-f]{32}$"), _uuid(bare)), _uuid(made))


def points(rows: DataFrame, id_col: str = "id", vec_col: str = "embedding", payload: Sequence[str] = ()) -> DataFrame:
    """(point_id, original_id, vector, payload): rows of a collection; the payload is JSON of some columns."""
    cells = [F.col(c) for c in payload] + [F.col(id_col).cast("string").alias("_original_id")]
    return rows.select(point_id(F.col(id_col)).alias("point_id"), F.col(id_col).cast("string").alias("original_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vector"), F.to_json(F.struct(*cells)).alias("payload"))


class Collections:
    """Named tables of points; a collection is a table that each upsert gives anew."""

    def __init__(self) -> None:
        self._tables: dict[str, DataFrame] = {}

    def create(self, name: str) -> bool:
        """False if it is there already."""
        if name in self._tables:
            return False
        self._tables[name] = None
        return True

    def upsert(self, name: str, new: DataFrame) -> None:
        old = self._tables[name]
        merged = upsert(new.limit(0) if old is None else old, new, ["point_id"])
        self._tables[name] = cut(merged)

    def delete(self, name: str) -> bool:
        return self._tables.pop(name, False) is not False

    def count(self, name: str) -> int:
        table = self._tables.get(name)
        return 0 if table is None else table.count()

    def search(self, name: str, query: Sequence[float], k: int = 10, threshold: float | None = None) -> DataFrame:
        """(original_id, point_id, score, payload) of the k nearest."""
        table = self._tables[name]
        return knn(table, query, k, threshold, "point_id", "vector").select("original_id", "point_id", "score", "payload")


# --- persona and age -----------------------------------------------------------------------------------------------

GENERAL = "General & Everyday Lifestyle"


def full_text(bio: Column, texts: Column, most: int | None = 5) -> Column:
    """A bio and the first texts that aren't blank, with blanks between."""
    parts = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.coalesce(t != "", F.lit(False)))
    own = F.trim(F.coalesce(bio, F.lit("")))
    parts = F.slice(parts, 1, most) if most else parts
    return F.trim(F.concat_ws(" ", F.when(own != "", own), F.array_join(parts, " ")))


def persona(text: Column, vector: Column, classes: dict[str, Sequence[float]], general: str = GENERAL) -> Column:
    """struct<persona, confidence>: the nearest class, clipped to 0..1, three digits; under four characters general and 0."""
    scores = [F.struct(cosine(vector, F.array(*[F.lit(float(x)) for x in v])).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("c")) for i, (name, v) in enumerate(classes.items())]
    best = F.array_max(F.array(*scores))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), best["s"])), 3)
    short = F.length(text) < 4
    return F.when(short, F.struct(F.lit(general).alias("persona"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(best["c"].alias("persona"), confidence.alias("confidence")))


def interests(similar: Column, known: dict[str, Sequence[str]], least: float = 0.35, most: int = 5) -> Column:
    """Interests of the nearest persona and two of the next one if that is nearer than ``least``; similar is an array of
    similarities in the order of known."""
    table = F.array(*[F.array(*map(F.lit, v)) for v in known.values()])
    order = F.reverse(F.array_sort(F.transform(similar, lambda s, i: F.struct(s.alias("s"), (-i).alias("i")))))
    own = F.get(table, -order[0]["i"])
    second = F.when(F.get(order, F.lit(1))["s"] > least, F.slice(F.get(table, -F.get(order, F.lit(1))["i"]), 1, 2)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_union(own, second), 1, most)


def age_shares(text: Column, similar: Column, stated: Column, other: Column | None, brackets: Sequence[str]) -> Column:
    """struct<bracket, confidence, source, shares>: how old by the ensemble of what a text states and what is near it.

    stated: the bracket of explicit words or null; it decides with 0.90. Else the softmax of similarities to the
    brackets' anchors (equal shares under three characters), with 0.6 beside 0.4 of ``other`` (shares of a text model)
    where there is one; shares have four digits, and what rounding leaves goes to the largest."""
    n = len(brackets)
    by_words = F.array(*[F.when(stated == b, 0.90).otherwise(0.02) for b in brackets])
    near = F.when(F.length(F.trim(text)) < 3, F.array_repeat(F.lit(1.0 / n), n)).otherwise(softmax(similar))
    mixed = near if other is None else F.when(other.isNotNull(), F.zip_with(near, other, lambda a, b: 0.6 * a + 0.4 * b)).otherwise(near)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def settled(raw: Column) -> Column:
        """Rounded shares that sum to 1."""
        return once(total(raw), lambda t: once(F.transform(raw, lambda x: F.when(t > 0, F.round(x / t, 4)).otherwise(x)), lambda s: once(F.array_position(s, F.array_max(s)), lambda at: F.transform(s, lambda x, i: F.when(i + 1 == at, F.round(x + F.round(1 - total(s), 4), 4)).otherwise(x)))))

    shares = F.when(stated.isNotNull(), by_words).otherwise(once(F.transform(mixed, lambda x: F.round(x, 4)), settled))
    names = F.array(*map(F.lit, brackets))
    source = F.when(stated.isNotNull(), "regex").when(F.lit(False) if other is None else other.isNotNull(), "ensemble").otherwise("bio_vector")
    return once(shares, lambda s: F.struct(F.get(names, (F.array_position(s, F.array_max(s)) - 1).cast("int")).alias("bracket"), F.array_max(s).alias("confidence"), source.alias("source"), s.alias("shares")))


def taxonomy(spark: SparkSession, classes: dict[str, Sequence[float]], interests_of: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The rows that a collection of personas starts with: (id, embedding, interests)."""
    rows = [(name, [float(x) for x in v], list((interests_of or {}).get(name, ()))) for name, v in classes.items()]
    return spark.createDataFrame(rows, "id string, embedding array<double>, interests array<string>")
