"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A document is kept if no rule rejects it. Every rule takes some time and rejects
some share of the documents; both are measured on a sample, and the cascade asks
the rules in the order of rejection per cost, so that most rejected documents are
rejected by their first, cheap rule. The order changes the time, and which of several
rules is named, never the verdict.

Defined cases: a null text has no words and fails the first base rule, as does an
empty one; repeated rows are judged alike; a null doc_id is passed on; further
columns are ignored; an empty table gives an empty result (and the rules in their
written order). A row's words are held in memory as one array.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import materialise, release

#: Rows of the sample, about, on which costs and selectivities are estimated, and its partitions.
SAMPLE_ROWS, SAMPLE_PARTS = 2000, 8
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, whatever the optimiser merges."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in the row.

    Hashes of the windows show whether any repeats at all; only then the windows
    themselves are sorted, equal neighbours marked, and the union of the marked
    windows measured from the gaps between their starts.
    """

    def windows(make: Callable[[Column, Column], Column], ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: make(F.slice(ws, i, F.lit(width)), i))

    def pairs(xs: Column, f: Callable[[Column, Column], Column]) -> Column:
        return F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), f)

    def covered(starts: Column) -> Column:
        gaps = pairs(starts, lambda a, b: F.least(b - a, F.lit(width)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(width), lambda total, gap: total + gap))

    def marked(ordered: Column) -> Column:
        def both(same: Column) -> Column:
            hit = F.zip_with(F.concat(F.array(F.lit(False)), same), F.concat(same, F.array(F.lit(False))), lambda a, b: a | b)
            flagged = F.zip_with(ordered, hit, lambda x, h: F.struct(x["i"].alias("i"), h.alias("hit")))
            return let(F.array_sort(F.transform(F.filter(flagged, lambda x: x["hit"]), lambda x: x["i"])), covered)

        return let(pairs(ordered, lambda a, b: a["window"] == b["window"]), both)

    def exact(ws: Column) -> Column:
        return let(F.array_sort(windows(lambda w, i: F.struct(F.array_join(w, " ").alias("window"), i.alias("i")), ws)), marked)

    def screened(ws: Column) -> Column:
        return let(windows(lambda w, _: F.xxhash64(w), ws), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(ws)).otherwise(F.lit(0)))

    return F.when(F.size(words) > width, let(words, screened)).otherwise(F.lit(0))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, the five base measures, and the text and words that further rules read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = documents.select("doc_id", text.alias("text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return held.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        "text",
        "words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Rule:
    """``rejects``: whether a row of :func:`measures` fails."""

    name: str
    rejects: Callable[[], Column]


RULES = (
    Rule("odd_word_length", lambda: (F.col("word_chars") > F.col("n_words") * 30) | (F.col("word_chars") < F.col("n_words") * 2)),
    Rule("symbols", lambda: F.col("n_symbols") * 2 > F.col("n_words")),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 2 > F.size(F.split(F.col("text"), "\n"))),
    Rule("shouting", lambda: (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) * 10 > F.col("word_chars") * 6),
    Rule("few_words_over_and_over", lambda: F.size(F.array_distinct("words")) * 50 < F.col("n_words")),
)


def by_rejection_per_cost(costs: list[float], patterns: dict[tuple[bool, ...], int]) -> list[int]:
    """The rules' numbers, each time the one that rejects most per cost of the rows that those before it let pass.

    ``patterns``: how many rows of the sample have these verdicts. Ties go to the cheaper rule, then to the first.
    """
    left, order, rows = list(range(len(costs))), [], dict(patterns)
    while left:
        rejected = {i: sum(n for verdicts, n in rows.items() if verdicts[i]) for i in left}
        best = min(left, key=lambda i: (-rejected[i] / costs[i], costs[i], i))
        order.append(best)
        left.remove(best)
        rows = {verdicts: n for verdicts, n in rows.items() if not verdicts[best]}
    return order


def seconds(sample: DataFrame, value: Column, runs: int = 3) -> float:
    """The shortest of some runs over a written sample."""
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        sample.agg(F.count_if(value)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def ordered_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample, highest first.

    Rows are drawn where they lie and only their measures are written; a rule's cost is
    the time that it takes on them beyond that of an empty query, and its rejection
    counts rows that the base rules and the rules before it let pass. Both change with
    the machine's mood, so the order may differ between runs; verdicts don't.
    """
    rows = documents.count()
    if not rules or not rows:
        return list(rules)
    drawn = documents.select("doc_id", "text").sample(min(1.0, sample_rows / rows), seed=11).repartition(SAMPLE_PARTS)
    sample = materialise(measures(drawn).filter(~base_failed()), "sample")
    names = [f"r{i}" for i in range(len(rules))]
    verdicts = sample.select(*[F.coalesce(r.rejects(), F.lit(False)).alias(n) for r, n in zip(rules, names)]).groupBy(*names).count().collect()  # at most 2 ** len(rules) rows
    empty = seconds(sample, F.lit(False))
    costs = [max(seconds(sample, r.rejects()) - empty, empty / 20, 1e-6) for r in rules]
    release(sample)
    return [rules[i] for i in by_rejection_per_cost(costs, {tuple(v[n] for n in names): v["count"] for v in verdicts})]


def quality_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the first rule that rejected the row (null if kept)."""
    measured = measures(documents)
    cascade = F.when(base_failed(), F.lit("base"))
    for rule in ordered_rules(documents, rules, sample_rows):
        cascade = cascade.when(rule.rejects(), F.lit(rule.name))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), cascade.alias("rejected_by")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+7], ' ')) AS n FROM starts
), gaps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS gap FROM windows WHERE n > 1
), repeats AS (
  SELECT doc_id, CAST(sum(gap) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY doc_id
), m AS (
  SELECT doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id)
), j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > n_words * 30 OR word_chars < n_words * 2 OR n_symbols * 2 > n_words
    OR n_dup_lines * 2 > len(string_split(text, chr(10)))
    OR (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) * 10 > word_chars * 6
    OR len(list_distinct(words)) * 50 < n_words) AS kept
FROM j
"""
