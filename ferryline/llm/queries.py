"""The registered queries of the operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ferryline.llm import (
    bpe,
    caps,
    conversations,
    licenses,
    minhash,
    mixing,
    prefix_tokens,
    quality_rules,
    sharding,
    spelling,
    subword,
    suffix_tree,
    warc,
)
from ferryline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: The vocabularies of the encoding and of the counts, of a fixed size.
RANKS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op5_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.share_ranks(spark, public_tokenizers.path(RANKS))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = prefix_tokens.share_vocabulary(spark, public_tokenizers.path(PIECES))
    return prefix_tokens.counted(table(spark, sf_dir, "documents"), pieces)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(given), ids=given)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_derivatives,
        op2_suffix_tree,
        op3_minhash,
        op4_quality_rules,
        op5_shuffle_shards,
        op6_bpe,
        op7_mixture,
        op8_cap_filters,
        op9_license_scan,
        op10_subword_quality,
        op11_prefix_tokens,
        op12_spelling,
        op13_conversations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash": minhash.sql(),
    "op4_quality_rules": quality_rules.sql(),
    "op8_cap_filters": caps.sql(),
    "op9_license_scan": licenses.sql(),
}
