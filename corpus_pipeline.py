"""A training corpus from raw documents, in five stages.

Each stage takes all that the one before it kept, written as Parquet, and all but
the last return the columns of ``documents``. The last returns where each piece of
each kept document goes.

Defined cases: null, empty and letterless texts go in the first stage. Rows that
repeat a text leave one. Rows that share a doc_id are told apart by their texts in
the second stage; in the third they stay or go together, and rows without a doc_id
stay. A null source is a source of its own. Further columns pass through the first
four stages, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from tessera.plans.session import show_package
from tessera.plans.storage import materialise, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or null, have no language and go."""
    show_package(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # as one column, no name can clash
    found = language_id.predict(rows, language_id.train(docs), ["row"])
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    show_package(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays: five-word shingles, similarity 0.8."""
    show_package(spark)
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    dropped = materialise(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    show_package(spark)
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every copy and the sequence that each goes to."""
    show_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language ID, packing and the Jaccard join can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            after = materialise(after, name)
            release(docs)  # written anew: nothing reads the stage before any more
        docs = after
    return docs
