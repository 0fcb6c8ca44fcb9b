"""Registered queries of the corpus operators, on the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.llm import (
    backoff_lm,
    byte_bpe,
    conversation_trie,
    fm_decon,
    license_scan,
    maxscore,
    merkle,
    mixing,
    ngram_join,
    oracles,
    site_quality,
    suffix_dedup,
    token_codes,
    toxicity,
)
from rankfield.llm.stage import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op4_source_mixing": oracles.SOURCE_MIXING,
    "op5_maxscore_top_k": oracles.TOP_K,
    "op10_benchmark_decontamination": oracles.DECONTAMINATION,
    "op11_conversation_trie": oracles.CONVERSATION_TRIE,
    "op12_merkle_manifest": oracles.MERKLE,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the machine keeps a tokenizer's file. Imported here, so that all other queries work without the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query
def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return site_quality.site_quality(table(spark, sf_dir, "documents"), labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


@query
def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.encoded(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer("byte_bpe_50k.json"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


@query
def op5_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return maxscore.top_k(vectors, F.col("vec_id") % 50 == 0)


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"), license_scan.default_templates(spark))


@query
def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.lm_scores(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decon.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    borrowed = F.crc32(conv_id.cast("string").cast("binary")) % 4
    return conversation_trie.trie(*conversation_trie.rebuilt(table(spark, sf_dir, "conversations"), conv_id - conv_id % 20, borrowed))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.proofs(table(spark, sf_dir, "documents"), F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks_path=tokenizer("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
