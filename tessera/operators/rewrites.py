"""What else a query may look for: exact terms, variants and terminology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators.lexical import search_terms

# Weights of exact terms, and product names.
WEIGHTS = {"filename": 2.0, "error_code": 2.0, "symbol": 1.8, "exact_phrase": 1.6, "product": 1.4}
PRODUCTS = r"(?i)(openai|anthropic|sqlite|fts5|nodejs|node\.js|typescript|javascript)"


def exact_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, kind, weight, at (its place among them): a query that is one exact term as a whole, else the exact terms within."""
    x = fn.collapse(F.col("text"))
    bare = F.regexp_replace(x, "^[\"'`「]|[\"'`」]$", "")
    word = "[A-Za-z_][A-Za-z0-9_]*"
    inner = {
        "exact_phrase": F.regexp_extract_all(x, F.lit("[\"「]([^\"」]{2,})[\"」]"), 1),
        "error_code": F.regexp_extract_all(x, F.lit(fn.START + "(ERR_[A-Z0-9_]+|E[A-Z]{2,}[A-Z0-9_]*)" + fn.END), 1),
        "product": F.regexp_extract_all(x, F.lit(fn.START + PRODUCTS + fn.END), 1),
        "symbol": F.regexp_extract_all(x, F.lit(rf"{fn.START}({word}(?:\.{word})+(?:\(\))?)"), 1),
    }
    weight = F.create_map(*[F.lit(v) for pair in WEIGHTS.items() for v in pair])


    def item(t, k):
        return F.struct(t.alias("term"), k.alias("kind"))

    def of_kind(name):
        return F.transform(inner[name], lambda t: item(t, F.lit(name)))

    within = F.concat(*[of_kind(name) for name in inner])
    kind = fn.query_kind(F.col("text"))
    found = F.when(kind == "general", within).otherwise(F.array(item(bare, kind)))
    each = queries.select("query_id", F.posexplode(found).alias("at", "x")).select("query_id", "at", "x.term", "x.kind").filter("trim(term) <> ''")
    first = Window.partitionBy("query_id", F.lower("term")).orderBy("at")
    return each.withColumn("n", F.row_number().over(first)).filter("n = 1").select("query_id", "term", "kind", F.element_at(weight, F.col("kind")).alias("weight"), "at")


def variants(queries: DataFrame, most: int = 2) -> DataFrame:
    """query_id, variant (0: the query itself), text, weight: its first terms, and its longest, for queries that aren't exact."""
    terms = search_terms(queries).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "term"))), lambda t: t["term"]).alias("terms"))
    q = queries.select("query_id", fn.collapse(F.col("text")).alias("text")).filter("text <> ''").join(terms, "query_id", "left")
    keywords = F.when(F.size("terms") >= 2, F.array_join(F.slice("terms", 1, 8), " "))
    longest = F.get(F.transform(F.array_sort(F.transform("terms", lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))), lambda x: x["t"]), F.lit(0))
    extra = F.when(fn.query_kind(F.col("text")) == "general", F.array(keywords, longest)).otherwise(F.array().cast("array<string>"))
    each = F.slice(F.array_distinct(F.array_compact(F.concat(F.array("text"), extra))), 1, most + 1)
    weight = F.element_at(F.array(F.lit(1.2), F.lit(1.0), F.lit(0.8)), F.least(F.col("variant"), F.lit(2)) + 1)
    return q.select("query_id", F.posexplode(each).alias("variant", "text")).withColumn("weight", weight)


def terminology(queries: DataFrame, entries: DataFrame, most: int = 8) -> DataFrame:
    """query_id, synonyms, excludes of the entries whose terms a query holds.

    ``entries``: entry, terms, exclude; a catalogue of bounded size, which is broadcast.
    Synonyms in the query's own script are left out, as the query finds those itself.
    """
    lowered = F.lower(fn.collapse(F.col("text")))
    han, latin = lowered.rlike(r"\p{IsHan}"), lowered.rlike(r"\p{IsLatin}")
    short = lowered.rlike(r"^\p{IsHan}{2,6}$")

    def held(t):
        needle = F.lower(t)
        whole = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), F.regexp_replace(needle, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"($|[^\p{L}\p{N}_])"))
        return F.when(t.rlike(r"\p{IsHan}"), F.contains(F.col("q"), needle) & ~(F.col("short") & (F.length(needle) < F.length("q")))).otherwise(F.regexp_like(F.col("q"), whole))

    q = queries.select("query_id", lowered.alias("q"), han.alias("han"), latin.alias("latin"), short.alias("short"))
    met = q.join(F.broadcast(entries)).filter(F.exists("terms", held))
    other = met.select("query_id", "entry", "han", "latin", F.filter("terms", lambda t: ~held(t)).alias("synonyms"), F.filter(F.coalesce("exclude", F.array().cast("array<string>")), lambda t: ~held(t)).alias("excludes"))
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("entry", c))), lambda x: x[c])))
    merged = other.groupBy("query_id", "han", "latin").agg(in_order("synonyms").alias("all"), in_order("excludes").alias("excludes"))
    script = lambda t: t.rlike(r"\p{IsHan}")
    kept = F.filter(F.slice("all", 1, most), lambda t: F.when(F.col("han") & ~F.col("latin"), ~script(t)).when(F.col("latin") & ~F.col("han"), script(t)).otherwise(True))
    return merged.select("query_id", kept.alias("synonyms"), "excludes")


def merged_terms(queries: DataFrame, most: int = 40) -> DataFrame:
    """query_id, term, position: a query's search terms after those of its exact terms that aren't among them, the last exact term first."""
    terms = search_terms(queries, most).select("query_id", F.lower("term").alias("term"), F.col("position").cast("long").alias("at"))
    exact = exact_terms(queries).select("query_id", F.lower("term").alias("term"), "at")
    new = exact.join(terms, ["query_id", "term"], "left_anti").select("query_id", "term", (-F.col("at") - 1).cast("long").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return new.unionByName(terms).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).select("query_id", "term", "position")


def resolved(queries: DataFrame, learned: DataFrame, seeds: DataFrame, answers: DataFrame | None = None, most: int = 8) -> DataFrame:
    """query_id, source (terminology, llm or none), synonyms, excludes.

    Learned entries come before the built-in seeds. Where none matches, a model's
    ``answers`` (query_id, answer) may: what it names, without the query itself and
    without synonyms in the query's own script. Queries that are exact terms stay as they are.
    """
    open_ = queries.filter(fn.query_kind(F.col("text")) == "general")
    entries = learned.select(F.concat(F.lit("a"), F.lpad(F.col("entry").cast("string"), 12, "0")).alias("entry"), "terms", "exclude").unionByName(
        seeds.select(F.concat(F.lit("b"), F.lpad(F.col("entry").cast("string"), 12, "0")).alias("entry"), "terms", "exclude")
    )
    known = terminology(open_, entries, most).withColumn("source", F.lit("terminology"))
    if answers is not None:
        text = F.lower(fn.collapse(F.col("text")))
        han, latin, script = text.rlike(r"\p{IsHan}"), text.rlike(r"\p{IsLatin}"), lambda t: t.rlike(r"\p{IsHan}")
        asked = open_.join(known, "query_id", "left_anti").join(answers, "query_id").withColumn("_p", fn.rewrite_payload(F.col("answer"))).filter("_p is not null")
        other = lambda xs: F.filter(xs, lambda t: F.lower(t) != text)
        kept = F.filter(other(F.col("_p.synonyms")), lambda t: F.when(han & ~latin, ~script(t)).when(latin & ~han, script(t)).otherwise(True))
        known = known.unionByName(asked.select("query_id", kept.alias("synonyms"), other(F.col("_p.exclude")).alias("excludes"), F.lit("llm").alias("source")))
    none = F.array().cast("array<string>")
    return queries.select("query_id").join(known, "query_id", "left").select(
        "query_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("synonyms", none).alias("synonyms"), F.coalesce("excludes", none).alias("excludes")
    )
