import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import context, evaluation, fusion, lexical, vectors

CHUNKS = "chunk_id long, content string"


def ladder(spark, chunks, *queries):
    plans = lexical.query_plans(spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"))
    rows = lexical.ladder(plans, spark.createDataFrame(chunks, CHUNKS)).orderBy("query_id", "rank").collect()
    return [[(r.chunk_id, r.step) for r in rows if r.query_id == q] for q in range(len(queries))]


def test_phrase_beats_scattered_words(spark):
    chunks = [(1, "Passive Mobs are harmless"), (2, "mobs that are passive"), (3, "passive income for mobs")]
    assert ladder(spark, chunks, "Passive Mobs") == [[(1, "phrase")]]


def test_all_terms_and_no_silent_or(spark):
    chunks = [(1, "知识 引擎 的 介绍"), (2, "知识 管理"), (3, "引擎 与 知识")]
    found = ladder(spark, chunks, "知识 引擎", "知识 天气")
    assert {c for c, _ in found[0]} == {1, 3}
    assert found[1] == []


def test_compound_needs_the_run(spark):
    chunks = [(1, "钠离子电池的优势"), (2, "离子与电池，钠"), (3, "电池")]
    assert ladder(spark, chunks, "钠离子电池") == [[(1, "phrase")]]


def test_traditional_text_answers_a_simplified_query(spark):
    assert [c for c, _ in ladder(spark, [(1, "請先設置訪問權限"), (2, "其他")], "访问")[0]] == [1]


def test_minimum_match_and_explicit_or(spark):
    chunks = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma"), (3, "alpha"), (4, "omega")]
    found = ladder(spark, chunks, "what about alpha beta gamma omega", "alpha OR omega")
    assert found[0] == [(2, "minimum_match"), (1, "minimum_match")] or {c for c, _ in found[0]} == {1, 2}
    assert {c for c, _ in found[1]} == {1, 2, 3, 4} and {s for _, s in found[1]} == {"explicit_or"}


def test_a_batch_is_as_single_runs(spark):
    chunks = [(i, f"alpha w{i} beta w{i % 3}") for i in range(20)]
    queries = ["alpha beta", "w1 beta", "w7"]
    together = ladder(spark, chunks, *queries)
    assert together == [ladder(spark, chunks, q)[0] for q in queries]


def test_fields_and_weights(spark):
    found = lexical.postings(spark.createDataFrame([(1, "Node.js 反向代理 café")], CHUNKS)).collect()
    by = {(r.field, r.token): r.tf for r in found}
    assert by["exact", "node"] == 1 and by["zh", "反向代理"] == 1 and by["zh", "向代"] == 1 and by["en", "cafe"] == 1 and by["mixed", "js"] == 2
    total = {r.token: r.tf for r in lexical.weighted(lexical.postings(spark.createDataFrame([(1, "Node.js")], CHUNKS))).collect()}
    assert total["node"] == 8 + 3 + 2 * 2
    assert lexical.language_fields("en") == ["en", "mixed", "exact"]


def ranked(spark, lists):
    rows = [(1, c, r + 1, float(w)) for ids, w in lists for r, c in enumerate(ids)]
    return {r.chunk_id: r.score for r in fusion.rrf(spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, weight double")).collect()}


def test_rank_fusion(spark):
    plain = ranked(spark, [(["a", "b"], 1), (["b", "c"], 1)])
    assert plain["b"] > plain["a"] > plain["c"]
    weighted = ranked(spark, [(["a", "b"], 2.0), (["b", "a"], 0.5)])
    assert weighted["a"] > weighted["b"]
    assert ranked(spark, [(["b", "a"], 0.5), (["a", "b"], 2.0)]) == weighted


def test_hybrid_choices(spark):
    keyword = spark.createDataFrame([(1, 10, 3.0, 1, "phrase"), (2, 20, 2.0, 1, "all"), (2, 21, 1.0, 2, "all"), (4, 40, 1.0, 1, "all")], "query_id long, chunk_id long, score double, rank int, step string")
    vector = spark.createDataFrame([(1, 99, 0.99, 1), (2, 21, 0.5, 1), (3, 30, 0.9, 1), (3, 31, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    got = {}
    for r in fusion.hybrid(keyword, vector).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r["mode"]))
    assert sorted(got[1]) == [(1, 10, "keyword")]
    assert sorted(got[2]) == [(1, 21, "fused"), (2, 20, "fused")]
    assert sorted(got[3]) == [(1, 30, "vector")]
    assert sorted(got[4]) == [(1, 40, "keyword")]


def test_cosine_top_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    entries = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)] + [(99, [0.0, 0.0])], "chunk_id long, vector array<double>").repartition(3)
    queries = entries.filter("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in vectors.cosine_top(queries, entries, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    for q in range(5):
        want = sorted(((-round(math.cos(q - i), 6), i) for i in range(30)))[:3]
        assert [c for _, c in sorted(got[q])] == [i for _, i in want]


def test_diversify_and_neighbours(spark):
    hits = spark.createDataFrame([(1, "a1", "A", 1), (1, "a2", "A", 2), (1, "b1", "B", 3)], "query_id long, chunk_id string, document_id string, rank int")
    assert [r.chunk_id for r in context.diversify(hits).orderBy("place").collect()] == ["a1", "b1", "a2"]
    candidates = spark.createDataFrame([(1, f"n{i}", "D", r, i) for i, r in ((1, "x"), (2, "x"), (3, "x"))] + [(1, "other", "D", "y", 1)], "query_id long, chunk_id string, document_id string, revision_id string, position int")
    found = context.neighbours(candidates.filter("chunk_id = 'n2'"), candidates)
    assert sorted(r.chunk_id for r in found.collect()) == ["n1", "n3"]


def test_packing_stops_at_the_first_overflow(spark):
    items = spark.createDataFrame([(1, 1, "x" * 20), (1, 2, "x" * 100), (1, 3, "x"), (2, 1, "x" * 100)], "query_id long, place int, content string")
    got = sorted((r.query_id, r.place, r.truncated) for r in context.pack(items, 30).collect())
    assert got == [(1, 1, False), (2, 1, True)]


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case_id long")
    rankings = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "y", 2), (3, "z", 1)], "case_id long, chunk_id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (2, "y"), (2, "w")], "case_id long, chunk_id string")
    got = {r.case_id: r for r in evaluation.by_case(cases, rankings, relevant).collect()}
    assert (got[1].hit_5, got[1].mrr, got[1].ndcg, got[1].top1) == (1, 1, 1, 1)
    assert got[2].mrr == 0.5 and got[2].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-9)
    assert got[3].hit_5 == 0 and got[4].hit_5 == 1  # nothing relevant: right only if nothing came back


def test_gates_and_comparison(spark):
    metrics = spark.createDataFrame([("mrr", 0.6), ("false", 0.6)], "metric string, value double")
    limits = spark.createDataFrame([("mrr", 0.6, False), ("false", 0.5, True)], "metric string, threshold double, at_most boolean")
    assert {r.metric: r.passed for r in evaluation.gate(metrics, limits).collect()} == {"mrr": True, "false": False}
    other = metrics.withColumn("value", F.col("value") - 0.1)
    assert all(r.regressed for r in evaluation.compare(metrics, other, ["metric"]).collect())


@pytest.mark.parametrize("p", [1, 50, 95, 100])
def test_percentile_by_ranges_matches_sorting(spark, p):
    rng = random.Random(p)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("inf"), -1.5, 0.0, *[float(x) for x in range(40)]])) for _ in range(600)] + [("one", 7.0), ("none", None)]
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    nearest = lambda xs: sorted(xs)[max(math.ceil(len(xs) * p / 100), 1) - 1]
    table = spark.createDataFrame(rows, "kind string, x double")
    assert {r.kind: r.value for r in evaluation.percentile(table, "x", p, "kind").collect()} == {k: nearest(v) for k, v in groups.items()}
    assert [r.value for r in evaluation.percentile(table, "x", p).collect()] == [nearest([v for _, v in rows if v is not None])]
    assert evaluation.percentile(table.filter("x is null"), "x", p, "kind").count() == 0


def test_percentile_holds_no_group_in_one_task(spark):
    """Raw rows never meet in a window; only counts of different values do."""
    plan = evaluation.percentile(spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") % 7).alias("x")), "x", 95, "k")
    window = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 1000" not in window and "_range" in window


@pytest.mark.parametrize("dealt", [1, 6])
def test_areas_are_added_in_the_order_of_the_boxes(spark, dealt):
    boxes = [(0.38, 0.06, 0.01, 0.02), (0.25, 0.11, 0.07, 0.01), (0.15, 0.24, 0.215, 0.09), (0.37, 0.43, 0.16, 0.01), (0.46, 0.19, 0.08, 0.08), (0.28, 0.25, 0.235, 0.09)]
    for order, degraded in (([0, 1, 2, 3, 4, 5], False), ([0, 1, 2, 4, 5, 3], True)):  # the box is three times the areas, but for rounding
        rows = [(1, place, *boxes[i]) for place, i in enumerate(order)]
        for given in (rows, rows[::-1], rows[3:] + rows[:3]):
            df = spark.createDataFrame(given, "page long, row int, x double, y double, width double, height double").repartition(dealt)
            assert [r.degraded for r in context.union_boxes(df, ["page"], ["row"]).collect()] == [degraded]
