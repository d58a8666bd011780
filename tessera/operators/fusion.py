"""Fusion of ranked lists, lexical boost, and the choice between keyword and vector results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(ranked: DataFrame, k: int = K) -> DataFrame:
    """query_id, chunk_id, score from rows (query_id, chunk_id, rank from 1, and weight if there is one)."""
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in ranked.columns else F.lit(1.0)
    return ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def best_by_chunk(hits: DataFrame) -> DataFrame:
    """Of hits that several variants found, the one with the largest score; the earlier variant on ties."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.col("score").desc(), F.col("variant"))
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def lexical_boost(hits: DataFrame, most: float = 0.05) -> DataFrame:
    """score raised by at most ``most`` of the query's best score, in proportion to the lexical score ``lex``."""
    query = Window.partitionBy("query_id")
    lift = most * F.greatest(F.max("score").over(query), F.lit(1e-9)) * F.coalesce("lex", F.lit(0)) / F.max(F.coalesce("lex", F.lit(0))).over(query)
    return hits.withColumn("boosted", F.round(F.when(F.max(F.coalesce("lex", F.lit(0))).over(query) > 0, F.col("score") + lift).otherwise(F.col("score")), 9))


def hybrid(keyword: DataFrame, vector: DataFrame, k: int = 8, least_cosine: float = 0.85) -> DataFrame:
    """Keyword and vector results of each query as one list.

    A phrase hit needs no vectors; without keyword hits only vectors of at least
    ``least_cosine`` count; without vectors keyword hits stay as they are; else both
    are fused by rank. ``keyword``: query_id, chunk_id, score, rank, step.
    """
    flags = keyword.groupBy("query_id").agg(F.max((F.col("step") == "phrase").cast("int")).alias("phrase"))
    lone = vector.join(flags, "query_id", "left_anti").filter(F.col("score") >= least_cosine).withColumn("mode", F.lit("vector"))
    paired = vector.join(flags.filter("phrase = 0"), "query_id", "left_semi")
    both = paired.select("query_id").distinct()
    alone = keyword.join(both, "query_id", "left_anti").withColumn("mode", F.lit("keyword"))
    lists = keyword.join(both, "query_id", "left_semi").select("query_id", "chunk_id", "rank").unionByName(paired.select("query_id", "chunk_id", "rank"))
    columns = ["query_id", "chunk_id", "score", "mode"]
    every = lone.select(*columns).unionByName(alone.select(*columns)).unionByName(rrf(lists).withColumn("mode", F.lit("fused")).select(*columns))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
