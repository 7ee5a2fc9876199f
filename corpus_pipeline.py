"""A corpus from documents: quality, exact copies, near copies, benchmark passages, packed sequences.

Every stage takes (spark, docs, sf_dir), reads what its predecessor kept, and returns the columns of documents, but
for the last, which returns the pieces of packed sequences.

Defined cases: a null text is an empty one, and is judged, kept or dropped like any other (all empty texts are copies);
a null source is the source ''; null ids are carried, and come before no other id where the largest or smallest counts;
repeated rows are copies, of which one stays; of equal scores and ties by id the stages' own rules hold; an empty table
of documents gives no pieces, one of labels keeps what the smoothed share of good ones keeps (all), one of the benchmark
drops nothing; extra columns are carried up to packing, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontaminate, exact_dedup, near_dup, packing, quality
from pulsegrid.llm.common import stored
from pulsegrid.llm.registry import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the smallest id."""
    return near_dup.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens in the corpus's own mixture of sources."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Neither a trained model nor a tokenizer has a form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
