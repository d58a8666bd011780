"""Rankers for offline evaluation.

Each takes queries (query_id, text) and a corpus (chunk_id, content) and ranks every
chunk that scores: query_id, chunk_id, score, rank. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import fusion, lexical, rewrites


def _ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scores.filter("score > 0").select("query_id", "chunk_id", "score", F.row_number().over(order).alias("rank"))


def _by_terms(queries: DataFrame, corpus: DataFrame, haystack: Column) -> DataFrame:
    terms = lexical.search_terms(queries).select("query_id", F.col("term").alias("token"))
    return _ranked(lexical.by_query_block(corpus.select("chunk_id", haystack.alias("content")), terms, fn.covered_characters))


def keyword(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Characters of the content that the query's terms cover."""
    return _by_terms(queries, corpus, F.coalesce("content", F.lit("")))


def keyword_fields(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """As ``keyword``, over the content and the tokens of its four fields."""
    content = F.coalesce("content", F.lit(""))
    return _by_terms(queries, corpus, F.concat_ws(" ", content, *[F.array_join(tokens, " ") for tokens in lexical.fields(content).values()]))


def multi_query(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``keyword_fields`` of every variant of a query, fused by rank with the variants' weights."""
    each = rewrites.variants(queries).select(F.struct("query_id", "variant").alias("query_id"), "text", "weight")
    lists = keyword_fields(each.select("query_id", "text"), corpus).join(each.select("query_id", "weight"), "query_id")
    return _ranked(fusion.rrf(lists.select(F.col("query_id.query_id").alias("query_id"), "chunk_id", "rank", "weight")))


RANKERS = {"keyword": keyword, "keyword_fields": keyword_fields, "multi_query": multi_query}
