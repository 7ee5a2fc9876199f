"""Classifiers of texts that are trained here: hashed words, and a multinomial regression.

A model is a pipeline of Spark's own stages, so it is fitted, saved, loaded and applied by the JVM in each task; its size
is FEATURES times classes, whatever it was trained on. ``probabilities`` names the columns that ``analytics.decided``
takes, so texts go from a labelled corpus (``corpora.labelled``) to stored analytics and to ``analytics.evaluated``.

Defined cases: a null text is an empty one; rows without a label aren't trained on; a text without known words gets the
classes' shares; of equally likely classes the first by name is taken. Two classes at least are needed to train.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tweet_normalised
from . import sentiment

#: Hashed words, and the texts that a word must be in to count.
FEATURES, LEAST = 1 << 18, 3


def words(text: Column) -> Column:
    """Words and signs of a text in lower case, as the models read it."""
    return F.regexp_extract_all(F.lower(tweet_normalised(F.coalesce(text, F.lit("")))), F.lit(r"(?U)[\p{L}\p{N}_@']+|[!?]"), F.lit(0))


def _prepared(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.withColumn("_words", words(F.col(text_col)))


def train(
    rows: DataFrame, text_col: str = "text", label_col: str = "label", features: int = FEATURES, pairs: bool = False, penalty: float = 1e-3, sparse: float = 0.5, rounds: int = 30
) -> PipelineModel:
    """The fitted stages; rows: texts with labels of any type. Words count once a text and more the rarer they are; pairs of
    words are features too if asked for. sparse: the share of the penalty that sets weights to zero."""
    known = _prepared(rows.filter(F.col(label_col).isNotNull()).withColumn("_label", F.col(label_col).cast("string")), text_col).select("_label", "_words")
    hashed = [HashingTF(inputCol="_words", outputCol="_one", numFeatures=features, binary=True)]
    if pairs:
        two = HashingTF(inputCol="_pairs", outputCol="_two", numFeatures=features, binary=True)
        hashed += [NGram(n=2, inputCol="_words", outputCol="_pairs"), two, VectorAssembler(inputCols=["_one", "_two"], outputCol="_both")]
    stages = [
        StringIndexer(inputCol="_label", outputCol="_class", stringOrderType="alphabetAsc"), *hashed,
        IDF(inputCol="_both" if pairs else "_one", outputCol="_rare", minDocFreq=LEAST), Normalizer(inputCol="_rare", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_class", family="multinomial", regParam=penalty, elasticNetParam=sparse, maxIter=rounds, probabilityCol="_shares", rawPredictionCol="_raw", predictionCol="_at"),
    ]
    return Pipeline(stages=stages).fit(known)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def scored(rows: DataFrame, model: PipelineModel | str, text_col: str = "text", name: str = "model") -> DataFrame:
    """rows with a struct ``name``: label, confidence, probabilities (by class). model: fitted, or the path of a saved one."""
    model = load(model) if isinstance(model, str) else model
    names = F.array(*map(F.lit, classes(model)))
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), words(F.col(text_col)).alias("_words"))  # no name clashes with a stage's
    out = PipelineModel(model.stages[1:]).transform(given).withColumn("_p", vector_to_array("_shares"))
    best = F.struct(F.get(names, (F.array_position("_p", F.array_max("_p")) - 1).cast("int")).alias("label"), F.array_max("_p").alias("confidence"), F.map_from_arrays(names, F.col("_p")).alias("probabilities"))
    return out.select(*[F.col("_row")[c].alias(c) for c in rows.columns if c != name], best.alias(name))


def probabilities(rows: DataFrame, model: PipelineModel | str, columns: Mapping[str, str], text_col: str = "text") -> DataFrame:
    """rows with a column for each class: columns names them by class, as {"0": "s_negative", ...}. A class that the model doesn't
    know has a probability of 0."""
    out = scored(rows, model, text_col, "_scores")
    return out.withColumns({name: F.coalesce(F.col("_scores.probabilities")[label], F.lit(0.0)) for label, name in columns.items()}).drop("_scores")


def held_out_metrics(rows: DataFrame, held_out: Column, text_col: str = "text", label_col: str = "label", **options) -> DataFrame:
    """``sentiment.classification`` of the rows held out, by a model of the others."""
    flagged = rows.withColumn("_held", held_out)
    model = train(flagged.filter(~F.col("_held")), text_col, label_col, **options)
    out = scored(flagged.filter("_held"), model, text_col, "_scores")
    return sentiment.classification(out.select(F.col(label_col).cast("string").alias("truth"), F.col("_scores.label").alias("predicted")))
