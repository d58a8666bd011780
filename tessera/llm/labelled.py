"""A bounded sample of labelled documents, and the split that keeps others out of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``, is ``rest``. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, rows: int, longest: int) -> pa.Table:
    """text and label of at most ``rows`` labelled documents outside the held-out part.

    The labelled doc_ids with the smallest hashes are taken, and of their documents
    those of at most ``longest`` characters: both bounds hold for training only. A
    doc_id with several labels has the largest; null labels and doc_ids are skipped.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.col("text").cast("string")
    found = documents.select("doc_id", text.alias("text")).filter(F.length("text") <= longest).join(F.broadcast(known), "doc_id")
    return found.select("doc_id", "text", "label").orderBy("doc_id", "text").limit(rows).select("text", "label").toArrow()
