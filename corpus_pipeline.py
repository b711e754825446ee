"""From raw documents to token ids, in stages that are each written and read again.

A stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return the columns of ``documents``. Nulls, empty texts and repeated rows are treated as each
operator's docstring says; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay.llm import bpe_rounds, code_language, pair_ranking, shingle_copies, split_tree
from hearsay.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return pair_ranking.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous."""
    return code_language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, which share four fifths of their five-word
    shingles: the one with the smallest id."""
    return shingle_copies.one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents the mix leaves out go, others come up to three times."""
    return split_tree.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the text they decode to."""
    return bpe_rounds.encode(docs, keep=("doc_id", "source", "lang"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates),
          ("mixing", mixing), ("encoding", encoding)]

#: Fitted models, fingerprints and merges can't be written as SQL; tests/llm holds every stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
