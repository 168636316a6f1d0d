"""Queries over the given tables, one for each operator, and the SQL that can check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, lexical, linededup, mixing, neardup, ngramjoin, prefixtrie, quality, sharding, topk, toxicity, warc
from .common import table


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), rank_path(), pattern())


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), rank_path())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_byte_bpe, op2_embedding_neardup, op3_toxicity, op4_language_id, op5_sharding, op6_mixing, op7_warc, op8_line_dedup, op9_ngram_join, op10_top_k, op11_prefix_trie, op12_lexical_search, op13_quality)
    return {query.__name__: query for query in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_neardup": neardup.DUPLICATES_SQL,
        "op6_mixing": mixing.MIXTURE_SQL,
        "op7_warc": warc.READ_BACK_SQL,
        "op8_line_dedup": linededup.DIGEST_SQL,
        "op9_ngram_join": ngramjoin.CLASSES_SQL,
        "op10_top_k": topk.NEAREST_SQL,
        "op11_prefix_trie": prefixtrie.TRIE_SQL,
        "op12_lexical_search": lexical.RANKED_SQL,
    }
