"""The language of a text by a multinomial model of its character trigrams, trained on labelled texts.

A trigram falls into one of BUCKETS by its code points. The model is a table of one row a language (prior, and the
logarithm of each bucket's share, one count added), so its size is languages times buckets, whatever it was trained on;
scoring adds up look-ups in the row, without a shuffle.

Defined cases: texts of under LEAST characters of letters (null ones too) are DEFAULT with a confidence of 0, and aren't
trained on; rows without a language aren't either. Letters beyond the basic plane count as blanks. Of equally likely
languages the first by name is taken. A model of no rows gives DEFAULT and 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import once
from ..functions.text import language_text
from ..sources.shared import cut

BUCKETS, LEAST, DEFAULT = 16_384, 3, "en"
_FIRST, _SECOND = 961, 31


def letters(text: Column) -> Column:
    """Letters of a text in lower case with a blank between words and at both ends."""
    bare = language_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x{0}-\x{FFFF}]", " "))
    return F.concat(F.lit(" "), F.lower(bare), F.lit(" "))


def trigrams(written: Column) -> Column:
    """The buckets of all trigrams of ``letters``."""
    points = F.transform(F.split(written, ""), lambda c: F.ascii(c).cast("bigint"))
    bucket = lambda p, i: (F.get(p, i) * _FIRST + F.get(p, i + 1) * _SECOND + F.get(p, i + 2)) % BUCKETS
    of = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: bucket(p, i))
    return F.when(F.length(written) >= LEAST + 2, once(points, of)).otherwise(F.array().cast("array<bigint>"))


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, prior, shares): a row a language, written out."""
    rows = texts.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("_t")).filter(F.length("_t") >= LEAST + 2)
    counted = rows.select("lang", F.explode(trigrams(F.col("_t"))).alias("b")).groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    shares = counted.groupBy("lang").agg(F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("_n"))  # BUCKETS entries at most
    every = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BUCKETS - 1).cast("bigint")), lambda b: F.log((F.coalesce(F.element_at("_n", b), F.lit(0)) + 1) / (F.col("_total") + BUCKETS)))
    docs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_d"))
    total = docs.agg(F.sum("_d").alias("_all"))  # one row
    return cut(shares.join(docs, "lang").join(F.broadcast(total)).select("lang", F.log(F.col("_d") / F.col("_all")).alias("prior"), every.alias("shares")))


def detected(texts: DataFrame, model: DataFrame, text_col: str = "text", name: str = "language") -> DataFrame:
    """texts with a struct ``name`` of lang, confidence (its share of probability) and probabilities (by language)."""
    held = "_model"
    while held in texts.columns:
        held = f"_{held}"
    one = model.agg(F.array_sort(F.collect_list(F.struct("lang", "prior", "shares"))).alias(held))  # one row, languages times buckets
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def scored(grams: Column) -> Column:
        logs = F.transform(held, lambda m: F.aggregate(grams, m["prior"], lambda x, b: x + F.get(m["shares"], b.cast("int"))))
        powers = once(logs, lambda p: once(F.array_max(p), lambda top: F.transform(p, lambda x: F.exp(x - top))))
        shares = once(powers, lambda e: once(total(e), lambda t: F.transform(e, lambda x: x / t)))
        names = F.transform(held, lambda m: m["lang"])
        best = lambda s: F.struct(F.get(names, (F.array_position(s, F.array_max(s)) - 1).cast("int")).alias("lang"), F.array_max(s).alias("confidence"), F.map_from_arrays(names, s).alias("probabilities"))
        return F.when((F.size(grams) > 0) & (F.size(held) > 0), once(shares, best))

    none = F.struct(F.lit(DEFAULT).alias("lang"), F.lit(0.0).alias("confidence"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("probabilities"))
    rows = texts.join(F.broadcast(one))
    return rows.withColumn(name, F.coalesce(once(trigrams(letters(F.col(text_col))), scored), none)).drop(held)
