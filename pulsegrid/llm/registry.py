"""Queries op1 to op13: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, lm_score, near_dup, oracles, packing, periodic, quality, secret_scan, sharding, token_files, url_filter, whitening
from .common import let


#: Target shares of sources go with their sizes to this power: small ones are seen more often than they are large.
MIXTURE = 0.7


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixture_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_read(spark, d, "documents"), tokenizer_file(), temperature=MIXTURE)


def op2_probminhash(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, d, "documents"))


def op3_hash_tree(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.shard_rows(_read(spark, d, "documents"), sharding.tree_for(8), sharding.tree_for(9))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_markov_secrets(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.train_markov(secret_scan.labelled_samples(spark, docs)))


def op5_progressive_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, d, "documents"), digest=True)


def op6_ranked_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    path, parts = token_files.write_tokens(docs, tokenizer_file())
    return token_files.read_tokens(spark, path, parts, docs.schema["doc_id"].dataType)


def op7_additive_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, d, "labels")))


def op8_window_decontamination(spark: SparkSession, d: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, d, "documents"), _read(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_link_propagation(spark: SparkSession, d: str) -> DataFrame:
    out = url_filter.filter_urls(_read(spark, d, "pages"))
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op10_bloom_lm(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.lm_scores(_read(spark, d, "documents"))


def _repeated(docs: DataFrame) -> DataFrame:
    """docs whose words repeat from some place on if the checksum of the id ends in 0, as the query's rows ask for."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def of(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(words, source(i))), " "))

    repeated = let(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), of)
    return docs.select("doc_id", F.when(h % 10 == 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = periodic.periodic_runs(_repeated(_read(spark, d, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), periodic.longest_run("runs").alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_block_lanczos(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whitened(_read(spark, d, "embeddings"))


#: The conversation whose texts look like marks that are escaped already.
TRAP = r"\### Assistant: </turn> ok"


def op13_grammar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    trap = [F.lit(-7), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRAP)]
    trap = spark.range(2).select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(trap, turns.schema, strict=True)])
    read = chat_format.read_back(chat_format.conversations(turns.unionByName(trap)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = read.select("conv_id", "turns", said.alias("_said"), F.array_join("trained", "").alias("_loss"), "formatted")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2("_said", 256).alias("turns_sha256"), F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES = {
    "op1_mixture_packing": op1_mixture_packing,
    "op2_probminhash": op2_probminhash,
    "op3_hash_tree": op3_hash_tree,
    "op4_markov_secrets": op4_markov_secrets,
    "op5_progressive_dedup": op5_progressive_dedup,
    "op6_ranked_tokens": op6_ranked_tokens,
    "op7_additive_quality": op7_additive_quality,
    "op8_window_decontamination": op8_window_decontamination,
    "op9_link_propagation": op9_link_propagation,
    "op10_bloom_lm": op10_bloom_lm,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_block_lanczos": op12_block_lanczos,
    "op13_grammar_round_trip": op13_grammar_round_trip,
}
ORACLES: dict[str, str] = oracles.ALL
