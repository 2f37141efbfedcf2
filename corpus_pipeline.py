"""From raw documents to packed training sequences, in stages that are each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factspan.llm import language, mixing, near_dedup, packing, toxicity
from factspan.llm.queries import TOKENIZER
from factspan.llm.shared import bucket_of, table
from factspan.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language. What has no letter, or fits no language, goes."""
    labelled = docs.where(bucket_of("doc_id", 3) != 1).selectExpr("doc_id as id", "text", "lang")
    return language.accepted(docs, language.fit(labelled, profiled=True))


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit of toxicity."""
    marks = toxicity.marked(docs, table(spark, sf_dir, "labels"), bucket_of("id", 4) != 2)
    return toxicity.accepted(docs, toxicity.fit(marks, docs.selectExpr("doc_id as id", "text")))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned out to their sources' targets."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, every window with the mixture of all documents."""
    return packing.pack(docs, TOKENIZER).withColumnsRenamed({"id": "doc_id", "tokens": "doc_tokens"})


STAGES = [
    ("language_id", language_id),
    ("toxicity", non_toxic),
    ("near_dedup", near_distinct),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of all documents that the stages keep.

    Languages and toxicity are judged first, as both look at single texts and make all later work
    smaller; near copies go before the mixture is drawn, so that no source counts its copies; packing
    comes last. Every stage reads what the one before has written, so a lost executor costs a stage.

    Defined cases: rows with a null id are judged and packed as all others, and are copies of
    nothing; rows that repeat an id are judged each, and one of them stays at the near copies. Null,
    empty and wordless texts go at the first stage. Texts of any length are judged whole. Columns that
    documents have beside their own are passed on up to the packing. Empty tables give no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# Learned models and a tokenizer decide, which SQL cannot state.
ORACLE_SQL = None
