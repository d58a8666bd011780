"""What an embedder is fed, how its settings are told apart, and a stand-in for it made of hashed terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 32-bit FNV-1a hash, and the stand-in's dimension.
FNV_OFFSET, FNV_PRIME, DIMENSION = 2166136261, 16777619, 64
MOST_CHARACTERS = 8000


def templated(text: Column, template: str | None, most: int = MOST_CHARACTERS) -> Column:
    """The text, cut to ``most`` characters, in a template like ``query: {text}``."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, most)
    return cut if not template else F.replace(F.lit(template), F.lit("{text}"), cut)


def fingerprint(settings: Sequence[Column]) -> Column:
    """Settings in one text; nulls are empty, true and false are 1 and 0."""
    return F.array_join(F.array(*[F.coalesce(s.cast("string"), F.lit("")) for s in settings]), "|")


def fnv1a(term: Column) -> Column:
    """FNV-1a over the UTF-16 code units of the term, as a long from 0 to 2**32 - 1."""
    units = F.hex(F.encode(term, "UTF-16BE"))
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.length(units) / 4), F.lit(1)).cast("int")), lambda i: F.conv(F.substring(units, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    step = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    start = F.lit(FNV_OFFSET).cast("long")
    return F.when(F.length(units) == 0, start).otherwise(F.aggregate(places, start, step))


def term_bins(terms: DataFrame, key: str, dimension: int = DIMENSION) -> DataFrame:
    """key, bin, weight: the filled bins of each key's unit vector of hashed terms (key, term; repeated terms count)."""
    counts = terms.groupBy(key, F.pmod(fnv1a(F.col("term")), F.lit(dimension)).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bin", (F.col("n") / F.col("norm")).alias("weight"))


def bin_cosines(queries: DataFrame, chunks: DataFrame, least: float = 0.12) -> DataFrame:
    """query_id, chunk_id, score above ``least`` of :func:`term_bins` of both, bin by bin; a query's bins are few, so they are what is broadcast or shuffled."""
    met = queries.select("query_id", "bin", F.col("weight").alias("_w")).join(chunks, "bin")
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("_w") * F.col("weight")), 6).alias("score")).filter(F.col("score") > least)
