"""From raw documents to a training mixture: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm import bpe, minhash, mixing, quality_rules, subword
from ferryline.llm.common import Scratch, broadcast_if_few, settled, table
from ferryline.llm.queries import RANKS

#: Stages on word shingles link at five words and 0.8 or more. 72 bands of 6 miss a pair at 0.8 with a chance of 3 in 10 ** 10.
NEAR = minhash.Settings(width=5, similar=80, bands=72, rows=6)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are made up like their language."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones.

    It learns from the labelled documents as they came: what is left has few bad ones.
    """
    given = table(spark, sf_dir, "documents")
    model = subword.fit(given, table(spark, sf_dir, "labels"))
    return subword.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group, with all texts it has; of repeated ones each once."""
    found = minhash.near_duplicates(docs, NEAR)
    gone = settled(found.where(~F.col("kept")).select("doc_id").distinct())
    left = docs.join(broadcast_if_few(gone), "doc_id", "left_anti").select(*docs.columns)
    ids = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count()
    again = settled(ids.where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    again = broadcast_if_few(again)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    others = left.join(again, "doc_id", "left_anti")
    return others.select(*docs.columns).unionByName(once.select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them: small sources again, large ones in part."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each drawn document, and digests of them and of what they decode to."""
    ranks = bpe.share_ranks(spark, public_tokenizers.path(RANKS))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can neither train the classifier nor encode; see the tests for what stands in for it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    with Scratch(spark) as scratch:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        return settled(docs)
