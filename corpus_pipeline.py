"""A corpus pipeline over documents: toxicity, quality, near duplicates, benchmark decontamination, packing.

Each stage works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import decontamination, ngram_join, packing, quality, toxicity
from kinloom.llm.common import dealt, held_out, materialize, table
from kinloom.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are scored toxic go; the classifier learns from the labels outside its test fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    scored = toxicity.scores(dealt(docs), labels, docs.columns, source=table(spark, sf_dir, "documents"))
    return scored.where("predicted = 0").select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are scored poor go; the classifier learns from the labels outside its test fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scored = quality.scores(docs, labels, docs.columns, source=table(spark, sf_dir, "documents"))
    return scored.where("predicted = 1").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more over five-word shingles connect, the one of least id stays."""
    return ngram_join.one_of_each(docs, ngram_join.Likeness()).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that what is left is packed into."""
    return packing.pack(docs, *vocabulary())


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Training, hashing and the tokenizer are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
