"""Ranking metrics over tables of rankings and relevant ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import materialise


def by_case(cases: DataFrame, rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 8), k: int = 10) -> DataFrame:
    """hit rates at ``ks``, MRR and nDCG at ``k`` and top1 of each case.

    A case without relevant ids scores 1 if nothing was returned, else 0.
    """
    wanted = relevant.groupBy("case_id").agg(F.count("*").alias("n_relevant"))
    returned = rankings.groupBy("case_id").agg(F.count("*").alias("n_returned"))
    met = rankings.join(relevant, ["case_id", "chunk_id"], "left_semi")
    gain = met.groupBy("case_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    all_ = cases.join(wanted, "case_id", "left").join(returned, "case_id", "left").join(gain, "case_id", "left")
    empty = F.when(F.coalesce("n_returned", F.lit(0)) == 0, 1.0).otherwise(0.0)
    score = lambda value: F.round(F.when(F.col("n_relevant").isNull(), empty).otherwise(F.coalesce(value, F.lit(0.0))), 9)
    within = lambda n: F.when(F.col("first") <= n, 1.0)
    return all_.select(
        *cases.columns, *[score(within(n)).alias(f"hit_{n}") for n in ks], score(F.when(F.col("first") <= k, 1 / F.col("first"))).alias("mrr"),
        score(F.col("gain") / ideal).alias("ndcg"), score(within(1)).alias("top1"),
    )


def by_group(metrics: DataFrame, *keys: str) -> DataFrame:
    """Means of each group, and how many cases it has."""
    names = [c for c in metrics.columns if c in ("mrr", "ndcg", "top1") or c.startswith("hit_")]
    return metrics.groupBy(*keys).agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 9).alias(c) for c in names])


def by_strategy(cases: DataFrame, rankings: dict[str, DataFrame], relevant: DataFrame) -> DataFrame:
    """strategy and the metrics of :func:`by_case` for every strategy's rankings (case_id, chunk_id, rank) and every case."""
    each = [by_case(cases, df, relevant).select(F.lit(name).alias("strategy"), "*") for name, df in rankings.items()]
    return reduce(DataFrame.unionByName, each)


def as_rows(means: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, value of a table of means."""
    names = [c for c in means.columns if c not in keys and c != "cases"]
    return means.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def summary(metrics: DataFrame) -> DataFrame:
    """One row of means over cases (category, gated, n_returned, and the metrics of :func:`by_case`).

    Recall, MRR and nDCG count gated cases; a group without cases counts as 1, and the
    share of cases without an answer that got one as 0.
    """
    gated = F.col("gated")
    mean = lambda c, which, empty=0.0: F.round(F.coalesce(F.avg(F.when(which, c)), F.lit(empty)), 9)
    of = lambda *names: gated & F.col("category").isin(*names)
    return metrics.agg(
        mean(F.col("hit_5"), gated).alias("recall_at_5"), mean(F.col("hit_8"), gated).alias("recall_at_8"), mean(F.col("mrr"), gated).alias("mrr_at_10"), mean(F.col("ndcg"), gated).alias("ndcg_at_10"),
        mean((F.col("n_returned") > 0).cast("double"), F.col("category") == "no_answer").alias("no_answer_false_recall"), mean(F.col("top1"), of("exact"), 1.0).alias("exact_top1"),
        mean(F.col("hit_8"), of("zh→en", "en→zh"), 1.0).alias("cross_lingual_recall_at_8"), mean(F.col("hit_8"), of("zh→zh"), 1.0).alias("zh_zh_recall_at_8"), mean(F.col("hit_8"), of("en→en"), 1.0).alias("en_en_recall_at_8"),
    )


# Categories that a set of cases must hold.
CATEGORIES = ("zh→zh", "en→en", "zh→en", "en→zh", "mixed", "zh-Hans↔zh-Hant", "exact", "paraphrase", "long_query", "conflict", "no_answer")


def fixture_errors(corpus: DataFrame, cases: DataFrame) -> DataFrame:
    """error and id of all that is wrong with a set: corpus (id, document_id, text) and cases (id, category, query, relevant, expect_no_answer)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    named = lambda df, error: df.select(F.lit(error).alias("error"), F.col("id").cast("string").alias("id"))
    ids = corpus.select(F.col("id").alias("_known")).distinct()
    wanted = cases.select("id", F.explode("relevant").alias("_known"))
    missing = cases.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "id string").join(cases.select(F.col("category").alias("id")).distinct(), "id", "left_anti")
    parts = [
        named(corpus.filter(empty("id") | empty("document_id") | F.col("text").isNull()), "bad_chunk"),
        named(corpus.filter("id is not null").groupBy("id").count().filter("count > 1"), "repeated_chunk"),
        named(cases.filter(empty("id") | ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)) | empty("query") | F.col("relevant").isNull()), "bad_case"),
        named(cases.filter("id is not null").groupBy("id").count().filter("count > 1"), "repeated_case"),
        named(wanted.join(ids, "_known", "left_anti").select("id").distinct(), "unknown_chunk"),
        named(cases.filter(F.col("expect_no_answer") & (F.size("relevant") > 0)), "answer_of_no_answer"),
        named(missing, "missing_category"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def percentile(values: DataFrame, column: str, p: float, *keys: str) -> DataFrame:
    """Nearest-rank percentile.

    Counts of different values are dealt into ranges by (keys, value), and each range
    starts from what the ranges before it add up to; so no task holds a whole group.
    """
    by = [F.col(k) for k in keys]
    counted = values.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    # Written, as ranges are drawn from a sample and must not change between two readings.
    ranges = materialise(counted.repartitionByRange(*by, F.col(column)).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    of_key = Window.partitionBy(*keys)
    all_ = F.sum("_sum").over(of_key)
    before = F.sum("_sum").over(of_key.orderBy("_range")) - F.col("_sum")
    placed = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), before.alias("_before"), F.greatest(F.ceil(all_ * p / 100), F.lit(1)).alias("_rank"), "_sum")
    met = placed.filter("_before < _rank and _rank <= _before + _sum")  # the range of each group that holds its rank
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(column))
    found = ranges.join(met, same).withColumn("_upto", upto)
    return found.filter("_rank <= _upto and _upto - _n < _rank").select(*keys, F.col(column).alias("value"))


def gate(metrics: DataFrame, thresholds: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``metrics`` (metric, value and what else they have) with threshold and passed; ``thresholds``: metric, threshold, at_most."""
    ok = F.when(F.col("at_most"), F.col("value") <= F.col("threshold") + tolerance).otherwise(F.col("value") >= F.col("threshold") - tolerance)
    return metrics.join(thresholds, "metric").select(*metrics.columns, "threshold", ok.alias("passed"))


def compare(before: DataFrame, after: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Values of two runs side by side, and whether the later is worse by more than the tolerance."""
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), keys, "full_outer")
    return joined.withColumn("delta", F.round(F.col("after") - F.col("before"), 9)).withColumn("regressed", F.col("before") - F.col("after") > tolerance)
