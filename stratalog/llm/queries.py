"""The thin queries over the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import bpe, decontaminate, embeddings, mixing, multiset, pii, prefix_trie, quality, sharding, simhash, spelling, toxicity, warc
from stratalog.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op4_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(spark, table(spark, sf_dir, "documents"))


def op5_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprint_documents(spark, table(spark, sf_dir, "documents"))


def op8_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op9_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(spark, table(spark, sf_dir, "documents"), shards=8)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark, table(spark, sf_dir, "conversations"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_bpe_encode": op2_bpe_encode,
        "op3_warc_archive": op3_warc_archive,
        "op4_mixing_rates": op4_mixing_rates,
        "op5_simhash_near_dup": op5_simhash_near_dup,
        "op6_personal_data": op6_personal_data,
        "op7_multiset_fingerprint": op7_multiset_fingerprint,
        "op8_embedding_near_dup": op8_embedding_near_dup,
        "op9_shard_by_bytes": op9_shard_by_bytes,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_decontaminate": op12_decontaminate,
        "op13_spelling_groups": op13_spelling_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_archive": warc.ARCHIVE_SQL,
        "op11_conversation_trie": prefix_trie.TRIE_SQL,
        "op12_decontaminate": decontaminate.DECONTAMINATE_SQL,
        "op13_spelling_groups": spelling.SPELLING_SQL,
    }
