"""A batch of retrieval requests from end to end: tier, variants, keyword and vector lists, fusion and cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import fusion, lexical, rewrites, vectors
from tessera.plans.storage import materialise

# Results of a request; what the ladder hands on; how many vectors are asked for.
TOP = 8
TIERS = ("lite", "balanced", "quality")


def breadth(top: int = TOP) -> dict[str, int]:
    """How many candidates each part is asked for so that ``top`` remain."""
    return {"candidates": max(top * 5, 40), "single": max(top * 3, 24), "vectors": top * 2, "variant": max(top * 2, 16)}


def tier(asked: Column, caps: dict[str, Column]) -> dict[str, Column]:
    """The tier that runs (effective) and why it isn't the one asked for (reasons, each once).

    ``caps``: embedding, index_ready (null: not probed), semantic_enabled, reranker,
    pressure (high or normal) and memory (the highest tier that the machine bears).
    """
    no = F.lit(False)
    ready = F.coalesce(caps["embedding"], no) & ~F.coalesce(~caps["index_ready"], no)
    why = (
        F.when(F.coalesce(caps["embedding"], no) & F.coalesce(~caps["index_ready"], no), "VECTOR_INDEX_NOT_READY")
        .when(~caps["semantic_enabled"], "SEMANTIC_SEARCH_DISABLED")
        .otherwise("SEMANTIC_RUNTIME_UNAVAILABLE")
    )
    quality = ~asked.isin("lite", "auto", "balanced")
    first = F.when((asked == "lite") | ~ready, 0).when(~quality | ~caps["reranker"], 1).otherwise(2)
    pressed = F.when((first > 0) & (caps["pressure"] == "high"), 0).otherwise(first)
    bears = F.when(caps["memory"] == "lite", 0).when(caps["memory"] == "balanced", 1).otherwise(2)
    none = F.lit(None).cast("string")
    reasons = F.array(
        F.when((asked != "lite") & ~ready, why).otherwise(none),
        F.when(quality & ready & ~caps["reranker"], "RERANKER_UNAVAILABLE").otherwise(none),
        F.when(quality & ready & ~caps["reranker"], "QUALITY_RETRIEVAL_UNAVAILABLE").otherwise(none),
        F.when((first > 0) & (caps["pressure"] == "high"), "RESOURCE_PRESSURE").otherwise(none),
        F.when(pressed > bears, "QUALITY_RETRIEVAL_UNAVAILABLE").otherwise(none),
    )
    effective = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.least(pressed, bears) + 1)
    return {"effective": effective, "reasons": F.array_distinct(F.array_compact(reasons))}


def fused_variants(lists: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, chunk_id, score, rank from the ranked lists of a query's variants (query_id, variant, chunk_id, score, rank, weight).

    Where one variant alone found anything, its own scores and order stay.
    """
    several = lists.groupBy("query_id").agg(F.count_distinct("variant").alias("_n"))
    marked = lists.join(several, "query_id")
    fused = fusion.rrf(marked.filter("_n > 1").select("query_id", "chunk_id", "rank", "weight"))
    alone = marked.filter("_n = 1").select("query_id", "chunk_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return fused.unionByName(alone).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def retrieve(queries: DataFrame, chunks: DataFrame, entries: DataFrame | None = None, query_vectors: DataFrame | None = None, top: int = TOP, variants: bool = True) -> DataFrame:
    """query_id, chunk_id, score, rank for queries (query_id, text).

    Each variant climbs its own ladder; only the query itself (variant 0) looks into the
    vectors (``entries``: chunk_id, document_id, vector; ``query_vectors``: query_id, vector).
    ``chunks``: chunk_id, document_id, content.
    """
    ask = breadth(top)
    each = rewrites.variants(queries) if variants else rewrites.variants(queries).filter("variant = 0")
    keyed = each.select((F.col("query_id") * 8 + F.col("variant")).alias("query_id"), "text", "variant", "weight", F.col("query_id").alias("_query"))
    keyed = materialise(keyed, "keyed")  # what follows is small and read several times
    found = lexical.ladder(lexical.query_plans(keyed.select("query_id", "text")), chunks.select("chunk_id", "content"), ask["variant"] if variants else ask["single"])
    found = materialise(found, "found")
    if entries is not None and query_vectors is not None:
        own = keyed.filter("variant = 0").select("query_id", F.col("_query"))
        vector = query_vectors.join(own.withColumnRenamed("query_id", "_key"), F.col("query_id") == F.col("_query")).select(F.col("_key").alias("query_id"), "vector")
        hits = found.join(own.select("query_id"), "query_id", "left_semi").join(chunks.select("chunk_id", "document_id"), "chunk_id")
        near = materialise(vectors.planned_top(vector, entries, materialise(hits.select("query_id", "document_id", "step"), "hits"), ask["vectors"]), "near")
        first = fusion.hybrid(found.join(own.select("query_id"), "query_id", "left_semi"), near, ask["variant"])
        found = first.select("query_id", "chunk_id", "score", "rank").unionByName(found.join(own.select("query_id"), "query_id", "left_anti").select("query_id", "chunk_id", "score", "rank"))
    lists = found.join(keyed.select("query_id", "variant", "weight", "_query"), "query_id").select(F.col("_query").alias("query_id"), "variant", "chunk_id", "score", "rank", "weight")
    return fused_variants(lists, top)
