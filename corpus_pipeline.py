"""From raw documents to packed training sequences: five stages, each a table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocara.llm.common import materialize, read_table
from vocara.llm.mixing import Mix, mix_sources
from vocara.llm.ngram_jaccard import ngram_jaccard_join
from vocara.llm.packing import pack
from vocara.llm.pii import redact
from vocara.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; rows without a doc_id go here, as no later stage
    could name them."""
    return reject_toxic(docs.where("doc_id is not null"), read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    groups = ngram_jaccard_join(docs)
    kept = materialize(groups.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens follow the target weights; one epoch, so ids stay unique."""
    drawn = materialize(mix_sources(docs, Mix(epochs=1)).select("doc_id"), "drawn")
    return docs.join(drawn.hint("merge"), "doc_id", "left_semi").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL: three of the stages learn, hash or pack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
