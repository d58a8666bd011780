"""Queries over whole benchmark texts against brute force on a small fixture."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.plans import catalogue, serving  # noqa: F401

TOKEN = re.compile("[a-z0-9]+")


def tables():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(n)) + rng.choice(["", ".", ", w7."])) for i, n in enumerate([3, 7, 8, 9, 10, 12, 14, 16, 20, 25])]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(4, 60)))) for i in range(70)]
    for i, text in items[::2]:  # the item, its words in another order, and its first six words alone
        w = text.split()
        docs += [(100 + i, f"Before {text.upper()} after"), (200 + i, " ".join(w[::-1]) + " x"), (300 + i, " ".join(w[:6])), (400 + i, " ".join(w[: len(w) // 2 + 1]))]
    docs += [(500, None), (501, "")]
    return docs, items


DOCS, ITEMS = tables()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def toks(text):
    return TOKEN.findall((text or "").lower())


def least(n):
    return n if n <= 2 else (n * 3 + 3) // 4 if n <= 4 else (n * 3 + 4) // 5 if n <= 8 else (n + 1) // 2


def bm25():
    """(item, doc): score and hits, over all words of the item."""
    counts = {d: Counter(toks(t)) for d, t in DOCS}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    out = {}
    for q, text in ITEMS:
        for d, c in counts.items():
            met = [t for t in set(toks(text)) if c[t]]
            score = 0.0
            for t in met:
                df = sum(1 for x in counts.values() if x[t])
                idf = max(math.log((len(counts) - df + 0.5) / (df + 0.5)), 1e-6)
                score += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            if met:
                out[q, d] = (round(score, 6), len(met))
    return out


def best(scores, k):
    """(item, doc): score and rank of the k best docs of each item."""
    by_item = defaultdict(list)
    for (q, d), s in scores.items():
        by_item[q].append((-s, d))
    return {(q, d): (-s, r) for q, found in by_item.items() for r, (s, d) in enumerate(sorted(found)[:k], 1)}


SCORED = bm25()
N = {q: len(set(toks(t))) for q, t in ITEMS}
SCORE = {k: v[0] for k, v in SCORED.items()}
HITS = {k: v[1] for k, v in SCORED.items()}
LOW = {d: (t or "").lower() for d, t in DOCS}


def got(spark, small, name, *columns):
    rows = catalogue.QUERIES[name](spark, small).collect()
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in ("query_id", "chunk_id", *columns))) for r in rows)


def flat(found):
    return sorted((*k, *[round(x, 6) if isinstance(x, float) else x for x in v]) for k, v in found.items())


def test_bm25(spark, small):
    assert max(N.values()) > 8
    assert got(spark, small, "bm25_topk", "score", "rank") == flat(best(SCORE, 8))


@pytest.mark.parametrize("name,minimum", [("and_match", lambda n: n), ("min_should_match", least)])
def test_matches(spark, small, name, minimum):
    expected = {k: (h,) for k, h in HITS.items() if h >= minimum(N[k[0]])}
    assert got(spark, small, name, "hits") == flat(expected)


def test_any_term(spark, small):
    expected = best(SCORE, len(DOCS))
    assert max(r for _, r in expected.values()) > 40
    assert got(spark, small, "explicit_or", "hits", "score", "rank") == flat({k: (HITS[k], *v) for k, v in expected.items()})


def test_ladder(spark, small):
    line = {d: f" {' '.join(toks(t))} " for d, t in DOCS}
    phrase = {q: f" {' '.join(toks(t))} " for q, t in ITEMS}
    step = {(q, d): 1 if phrase[q] in line[d] else 2 if h == N[q] else 3 if N[q] >= 2 and h >= least(N[q]) else None for (q, d), h in HITS.items()}
    lowest = {q: min(s for (p, _), s in step.items() if p == q and s) for q in N if any(s for (p, _), s in step.items() if p == q)}
    found = best({k: SCORE[k] for k, s in step.items() if s and s == lowest[k[0]]}, 8)
    names = {1: "phrase", 2: "all", 3: "minimum_match"}
    assert len(set(lowest.values())) > 1
    assert got(spark, small, "ladder_first_nonempty", "score", "rank", "step") == flat({k: (*v, names[lowest[k[0]]]) for k, v in found.items()})


def test_substrings(spark, small):
    chars = {(q, d): sum(len(c) - len(c.replace(t, "")) for t in set(toks(x))) for q, x in ITEMS for d, c in LOW.items()}
    assert got(spark, small, "keyword_score_topk", "score", "rank") == flat(best({k: s for k, s in chars.items() if s}, 8))
    coverage = {(q, d): (sum(t in c for t in set(toks(x))),) for q, x in ITEMS for d, c in LOW.items()}
    assert got(spark, small, "coverage_filter", "coverage") == flat({k: v for k, v in coverage.items() if v[0] >= max(least(N[k[0]]), 1)})


def test_fusion(spark, small):
    lists = [(1.2, best(SCORE, 16)), (0.8, best(HITS, 16))]
    plain, heavy, first = defaultdict(float), defaultdict(float), {}
    for weight, found in lists:
        for k, (_, rank) in found.items():
            plain[k] += 1 / (60 + rank)
            heavy[k] += weight / (60 + rank)
            first[k] = max(first.get(k, (-99, 0.0)), (40 - rank, -weight))
    assert got(spark, small, "rrf_fusion", "score") == flat({k: (v,) for k, v in plain.items()})
    assert got(spark, small, "weighted_rrf", "score") == flat({k: (v,) for k, v in heavy.items()})
    assert got(spark, small, "best_by_chunk", "score", "variant") == flat({k: (s, -v) for k, (s, v) in first.items()})
    top, boosted = best(SCORE, 8), {}
    for (q, d), (s, _) in top.items():
        mine = [k for k in top if k[0] == q]
        boosted[q, d] = (s + 0.05 * max(max(SCORE[k] for k in mine), 1e-9) * HITS[q, d] / max(HITS[k] for k in mine),)
    assert got(spark, small, "lexical_boost", "boosted") == flat(boosted)


def test_context(spark, small):
    size, placed, used, near = {d: -(-len(t or "") // 2) + 2 for d, t in DOCS}, {}, {}, []
    for q in N:
        hits = sorted((r, d) for (p, d), (_, r) in best(SCORE, 12).items() if p == q)
        seen, first = Counter(), {}
        turns = []
        for r, d in hits:
            seen[d % 7] += 1
            turns.append((seen[d % 7], first.setdefault(d % 7, r), d))
        total = 0
        for place, (_, _, d) in enumerate(sorted(turns), 1):
            placed[q, d] = (place,)
            total += size[d]
            if total <= 2000 or place == 1:
                used[q, d] = (total, total > 2000)
        chosen = {d for r, d in hits if r <= 4}
        near += [(q, d) for _, d in hits if d not in chosen and any(d % 7 == c % 7 and abs(d // 7 - c // 7) == 1 for c in chosen)]
    assert got(spark, small, "diversify_round_robin", "place") == flat(placed)
    assert got(spark, small, "token_pack_prefix", "used", "truncated") == flat(used)
    assert got(spark, small, "neighbor_expand") == sorted(near)


def test_planned_ladder_sees_whole_texts(spark, tmp_path):
    """The seventh word decides."""
    spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 zebra"), (2, "a1 b2 c3 d4 e5 f6"), (3, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalogue.QUERIES["planned_ladder"](spark, str(tmp_path)).collect()
    assert [(r.chunk_id, r.step) for r in rows] == [(1, "all")]


# ---- text functions and rewrites ---------------------------------------------------------------

PIECES = ["config.yaml", "C++", "a-b-c", "v1.2.3", "404", "./src/app.ts", "node.js", "plain", "\r\n", "  \t", " \n", "\n\n\n\n", " "]
TECHNICAL = [
    r"\bc\+\+", r"\bc#", r"\.net\b", r"\bnode\.js\b", r"\bnext\.js\b", r"\bvue\.js\b", r"\breact\.js\b", r"\b[a-z_][\w]*(?:\.[a-z_][\w]*)+\b", r"\b[a-z][\w]*(?:-[\w]+)+\b",
    r"\bv?\d+(?:\.\d+){1,3}(?:-[a-z0-9.]+)?\b", r"\b[1-5]\d{2}\b", r"(?:\.?\.?/[\w./@+-]{2,})+",
]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    rng, d = random.Random(3), str(tmp_path_factory.mktemp("mixed"))
    docs = [(i, "".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40)))) for i in range(40)] + [(40, None), (41, "")]
    items = [(1, "how to get an access token with OpenAI"), (2, "see ERR_TIMED_OUT and app.main() in \"the manual\""), (3, "plain words")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {i + 100000: t for i, t in docs}


def test_technical_terms_of_documents(spark, mixed):
    d, docs = mixed
    found = {r.id: r.terms for r in catalogue.QUERIES["technical_terms"](spark, d).collect()}
    collapsed = {i: re.sub(r"\s+", " ", t or "").strip().lower() for i, t in docs.items()}
    assert {i: found[i] for i in docs} == {i: "|".join(sorted({m for p in TECHNICAL for m in re.findall(p, t, re.A)})) for i, t in collapsed.items()}
    assert len(found) == len(catalogue.TEXTS) + 3 + len(docs)


def test_soft_normalised_documents(spark, mixed):
    d, docs = mixed

    def plain(t):
        for a, b in (("\r\n", "\n"), ("[ \t]+\n", "\n"), ("[ \t]{2,}", " "), ("\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
            t = re.sub(a, b, t)
        return t

    found = {r.id: r.text for r in catalogue.QUERIES["soft_normalize"](spark, d).collect()}
    assert {i: found[i] for i in docs} == {i: None if t is None else plain(t) for i, t in docs.items()}


def test_exact_terms_of_all_texts(spark, mixed):
    found = {(r.query_id, r.term, r.kind, r.weight) for r in catalogue.QUERIES["exact_terms_whole"](spark, mixed[0]).collect()}
    whole = {(11, "quoted phrase", "exact_phrase", 1.6), (12, "ERR_CONNECTION_REFUSED", "error_code", 2.0), (13, "report.final.pdf", "filename", 2.0), (14, "foo.barBaz()", "symbol", 1.8)}
    within = {(15, "node.js", "product", 1.4), (1001, "OpenAI", "product", 1.4), (1002, "the manual", "exact_phrase", 1.6), (1002, "ERR_TIMED_OUT", "error_code", 2.0), (1002, "app.main()", "symbol", 1.8)}
    assert {x for x in found if x[0] >= 11} == whole | within
    assert {(i, k) for i, _, k, _ in found if i < 11} == {(1, "product"), (1, "symbol"), (8, "symbol")}


def test_terminology_of_the_benchmark(spark, mixed):
    found = {r.query_id: r.synonyms for r in catalogue.QUERIES["terminology_rewrite"](spark, mixed[0]).collect()}
    assert found[1001] == found[1] == "访问令牌|訪問令牌" and set(found) == {1, 2, 1001}


# ---- evaluation --------------------------------------------------------------------------------


def gains(n):
    return sum(1 / math.log2(i + 1) for i in range(1, n + 1))


def metrics(rows):
    return {r.case_id: tuple(round(r[c], 6) for c in ("hit_5", "hit_8", "mrr", "ndcg", "top1")) for r in rows}


def test_metrics_against_all_documents_that_hold_the_text(spark, small):
    ranks = {k: r for k, (_, r) in best(SCORE, 8).items()}
    expected = {}
    for q, text in ITEMS:
        relevant = {d for d, c in LOW.items() if text.lower() in c}
        at = sorted(r for (p, d), r in ranks.items() if p == q and d in relevant)
        if not relevant:
            expected[q] = (0.0,) * 5  # something is returned for every item
            continue
        one = lambda k: float(bool(at) and at[0] <= k)
        gain = sum(1 / math.log2(r + 1) for r in at) / gains(min(len(relevant), 10))
        expected[q] = (one(5), one(8), round(1 / at[0], 6) if at else 0.0, round(gain, 6), one(1))
    rows = catalogue.QUERIES["recall_mrr_ndcg"](spark, small).collect()
    assert metrics(rows) == expected and {e[4] for e in expected.values()} == {0.0, 1.0}
    groups = {r.category: (r.cases, round(r.ndcg, 6)) for r in catalogue.QUERIES["eval_by_category"](spark, small).collect()}
    for g in range(4):
        mine = [r.ndcg for r in rows if r.case_id % 4 == g]
        assert groups[f"g{g}"] == (len(mine), round(sum(mine) / len(mine), 6))


def test_a_missed_document_costs_score(spark, tmp_path):
    docs = [(i, f"Some Alpha beta {'x ' * i}") for i in range(12)] + [(50, "xgamma deltax"), (51, "none")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha Beta"), (2, "gamma delta"), (3, "absent")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = metrics(catalogue.QUERIES["recall_mrr_ndcg"](spark, str(tmp_path)).collect())
    assert found[1] == (1.0, 1.0, 1.0, round(gains(8) / gains(10), 6), 1.0)
    assert found[2] == (0.0,) * 5
    assert found[3] == (1.0,) * 5


# ---- weighted fields ---------------------------------------------------------------------------


def test_weighted_fields(spark, tmp_path):
    rng, d = random.Random(5), str(tmp_path)
    words = ["node.js", "代理", "反向代理", "server", "server_config", "v1.2.3", "ERR_TIMED_OUT", "of", "a.pdf", "知识"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(40, None), (41, "")]
    items = [(1, "反向代理"), (2, "server of node.js"), (3, "server 代理 知识 v1.2.3"), (4, "!!"), (5, "404")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    index = catalogue.QUERIES["field_postings"](spark, d).collect()
    assert {r.field for r in index} == {"exact", "zh", "en", "mixed"}
    of_query = catalogue.lexical.postings(spark.createDataFrame(items, "chunk_id long, content string")).collect()
    weights, seen = {"exact": 8, "zh": 3, "en": 3, "mixed": 2}, {1: {"zh", "mixed", "exact"}, 2: {"en", "mixed", "exact"}, 3: set("exact zh en mixed".split())}
    lengths = {i: sum(r.tf for r in index if r.chunk_id == i) for i, _ in docs}
    mean, scores = sum(lengths.values()) / len(docs), {}
    for q, _ in items:
        fields = seen.get(q, seen[3])
        tf = defaultdict(Counter)
        for r in index:
            if r.field in fields:
                tf[r.token][r.chunk_id] += r.tf * weights[r.field]
        for token in {r.token for r in of_query if r.chunk_id == q and r.field in fields}:
            df = len(tf[token])
            for c, n in tf[token].items():
                idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
                scores[q, c] = scores.get((q, c), 0.0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[c] / mean))
    assert {q for q, _ in scores} >= {1, 2, 3}
    assert got(spark, d, "weighted_bm25_topk", "score", "rank") == flat(best({k: round(v, 6) for k, v in scores.items()}, 8))


def test_blocks_behind_chunks(spark):
    from tessera.operators import ocr

    chunks = spark.createDataFrame([(1, 1, "alpha beta\ngamma delta\nalpha beta"), (2, 1, "nothing of it"), (3, 2, "x"), (4, 1, ""), (5, 3, "a long line of text that differs at its end")], "chunk_id long, page_id long, content string")
    blocks = [(1, 10, 0, "alpha beta"), (1, 11, 2, "alpha beta"), (1, 12, 1, "gamma delta"), (1, 13, 3, " "), (3, 30, 0, "a long line of text that differs somewhere")]
    got = {r.chunk_id: ([tuple(x) for x in r.refs], r.degraded) for r in ocr.mapped_blocks(chunks, spark.createDataFrame(blocks, "page_id long, block_id long, reading_order int, text string")).collect()}
    assert got == {1: ([(10, 0, 10), (12, 11, 22), (11, 23, 33)], False), 2: ([], True), 3: ([], False), 4: ([], False), 5: ([], True)}


def test_exact_terms_lead_the_terms(spark):
    from tessera.operators import rewrites

    q = spark.createDataFrame([(1, "see \"two words\" of sqlite in foo.bar")], "query_id long, text string")
    got = [r.term for r in rewrites.merged_terms(q).orderBy("position").collect()]
    assert got[0] == "two words" and got.count("sqlite") == 1 and got.count("foo.bar") == 1 and len(rewrites.merged_terms(q, 2).collect()) == 2


def test_stub_hashes_match_the_definition(spark):
    from pyspark.sql import functions as F

    from tessera.functions import embedding

    def fnv(term):
        h = 2166136261
        raw = term.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619) & 0xFFFFFFFF
        return h

    terms = ["", "a", "node.js", "本地", "🙂x", "é"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", embedding.fnv1a(F.col("t"))).collect()}
    assert got == {t: fnv(t) for t in terms}


def test_stub_ranking_matches_cosines(spark, small):
    def bins(text):
        v = [0.0] * 64
        for t in toks(text):
            h = 2166136261
            for c in t:
                h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
            v[h % 64] += 1
        n = math.sqrt(sum(x * x for x in v)) or 1
        return [x / n for x in v]

    docs = {d: bins(t) for d, t in DOCS}
    want = {}
    for q, text in ITEMS:
        v = bins(text)
        scores = {d: round(sum(a * b for a, b in zip(v, w)), 6) for d, w in docs.items()}
        want[q] = sorted(((-s, d) for d, s in scores.items() if s > 0.12))[:8]
    got = defaultdict(list)
    for r in catalogue.QUERIES["stub_ranking"](spark, small).collect():
        got[r.query_id].append((-r.score, r.chunk_id))
    for q in want:
        assert [round(s, 5) for s, _ in sorted(got[q])] == pytest.approx([round(s, 5) for s, _ in want[q]], abs=2e-5)


def test_the_engine_prefers_the_whole_text(spark):
    from tessera.operators import engine

    chunks = spark.createDataFrame([(1, 1, "the quick ranking of results"), (2, 2, "ranking results quickly and well"), (3, 3, "other words"), (4, 4, "how to rank results")], "chunk_id long, document_id long, content string")
    queries = spark.createDataFrame([(1, "how to rank results"), (2, "absent thing")], "query_id long, text string")
    entries = spark.createDataFrame([(i, i, [1.0 if k == i else 0.0 for k in range(5)]) for i in range(1, 5)], "chunk_id long, document_id long, vector array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.0, 1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 1.0, 0.0])], "query_id long, vector array<double>")
    got = defaultdict(list)
    for r in engine.retrieve(queries, chunks, entries, asked).collect():
        got[r.query_id].append((r["rank"], r.chunk_id))
    assert sorted(got[1])[0][1] == 4 and sorted(got[2]) == [(1, 3)]  # without a keyword hit, only the vector that is close enough
    assert engine.breadth() == {"candidates": 40, "single": 24, "vectors": 16, "variant": 16}


def test_accents_fold(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as fn

    row = spark.createDataFrame([("Šárka Dvořák, Nguyễn ŁÓDŹ café",)], "t string").select(fn.tokens(F.col("t"))).first()[0]
    assert row == ["sarka", "dvorak", "nguyen", "łodz", "cafe"]
    assert spark.createDataFrame([("国",)], "t string").select(fn.hans_hant_variants(F.col("t"))).first()[0] == ["国", "國"]
