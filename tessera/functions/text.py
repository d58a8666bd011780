"""Text functions as Column expressions; everything here stays in the JVM.

Word boundaries are written out for ASCII, as ``\\b`` of the regular expressions here
knows all Unicode letters and would cut other tokens than the ones intended.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Simplified characters and their traditional forms, in pairs.
SIMPLIFIED = "国们过来时么对东车门开关为说与学发经总体实际现应会语库检索档标题认证访问识资传数据请写机设备处运启动务网络连错误败环变权缓览页预话户码隐云节内结询选级闭装赖滚复删创导别扫图优仅载输块"
TRADITIONAL = "國們過來時麼對東車門開關爲說與學發經總體實際現應會語庫檢索檔標題認證訪問識資傳數據請寫機設備處運啟動務網絡連錯誤敗環變權緩覽頁預話戶碼隱雲節內結詢選級閉裝賴滾復刪創導別掃圖優僅載輸塊"
HANT_MARKERS = "國們過來時麼對東車門開關爲說與學發經總體實際現應會語資訊"
# The patterns of technical terms, in the order in which they are looked for.
TECHNICAL_PATTERNS = (
    START + r"c\+\+",
    START + r"c#",
    r"\.net" + END,
    START + r"node\.js" + END,
    START + r"next\.js" + END,
    START + r"vue\.js" + END,
    START + r"react\.js" + END,
    START + r"[a-z_][A-Za-z0-9_]*(?:\.[a-z_][A-Za-z0-9_]*)+" + END,
    START + r"[a-z][A-Za-z0-9_]*(?:-[A-Za-z0-9_]+)+" + END,
    START + r"v?[0-9]+(?:\.[0-9]+){1,3}(?:-[a-z0-9.]+)?" + END,
    START + r"[1-5][0-9]{2}" + END,
    r"(?:\.?\.?/[A-Za-z0-9_./@+-]{2,})+",
)
# Chinese bigrams that say little.
LOW_INFORMATION_BIGRAMS = (
    "什么 如何 怎么 怎样 一个 我们 你们 他们 这个 那个 可以 还有 以及 或者 如果 因为 所以 但是 然后 进行 通过 使用 需要 应该 是否 哪些 哪里 为何 为了 关于 对于 时候 问题 一下 一些 一种 不会 没有 不是 就是 只是 还是"
).split()
# Latin function words.
LATIN_STOPWORDS = (
    "what which who whom whose when where why how is are was were be been being am do does did will would shall should can could may might must "
    "have has had the an this that these those of in on at to for with by from about into over under and or but so yet it its they them their we our "
    "you your he she his her as if then than not"
).split()
FILE_EXTENSIONS = "pdf|md|markdown|txt|docx?|xlsx?|pptx?|csv|json|ya?ml|xml|html?|ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|swift|c|cpp|h|hpp|cs|rb|php|sql|sh|zsh|toml|ini|cfg|log"


def _accents() -> tuple[str, str]:
    """Lower-case letters that Unicode composes of a base letter and marks, with their base letters; then the marks, which have none and vanish."""
    letters = {}
    for code in (*range(0x00C0, 0x0600), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code).lower())
        if len(chr(code).lower()) == 1 and len(base) > 1 and not unicodedata.combining(base[0]) and all(map(unicodedata.combining, base[1:])):
            letters[chr(code).lower()] = base[0]
    return "".join(letters) + "".join(map(chr, range(0x0300, 0x0370))), "".join(letters.values())


ACCENTED, PLAIN = _accents()

Text = Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def collapse(x: Text) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s{2,}|[\t\n\x0B\f\r]", " "))  # most spaces stand alone and stay


def beyond_ascii(x: Text) -> Column:
    """Whether there are other characters than those of ASCII, which have one byte each."""
    return F.octet_length(x) > F.length(x)


def folded(x: Text) -> Column:
    """Lower case without accents, as index and queries are matched. Letters that Unicode doesn't decompose (ł, đ, ø) stay."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(F.lower(x), ACCENTED, PLAIN)).otherwise(F.lower(x))


def tokens(x: Text) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(x), F.lit(r"([\p{L}\p{N}]+)"), 1)


def first_tokens(x: Text, n: int) -> Column:
    """The first ``n`` of :func:`tokens`. Folding drops marks, so a token's stretch of the text may hold some."""
    stretch = rf"^((?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\x{{300}}-\x{{36F}}]*+){{0,{n}}}+)"
    return tokens(F.regexp_extract(x, stretch, 1))


def soft_normalised(x: Text) -> Column:
    """Markdown with line ends, blanks and empty lines evened out."""
    x = F.regexp_replace(F.regexp_replace(x, "\r\n", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[ \t]{2,}", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def search_text(x: Text) -> Column:
    """The lower-cased text in one line, followed by the bigrams of its Chinese runs and its technical terms."""
    low = F.lower(collapse(F.coalesce(x, F.lit(""))))
    runs = F.regexp_extract_all(low, F.lit(r"(\p{IsHan}{2,})"), 1)
    bigrams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_join(F.concat(F.array(low), bigrams, technical_terms(low)), " ")


def display_name(name: Text, original: Text, most: int = 180) -> Column:
    """A name to show: percent-encoding undone where it is sound, slashes as underscores, cut; the original where nothing is left."""
    decoded = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    plain = F.substring(F.trim(F.regexp_replace(decoded, r"[/\\]", "_")), 1, most)
    return F.coalesce(F.nullif(plain, F.lit("")), F.substring(original, 1, most))


def highlight_terms(seeds: Column, most: int = 40) -> Column:
    """The seeds, their script variants and the Chinese runs in them, each once whatever the case; long ones first, then by lower case and code points."""

    def forms(t: Column) -> Column:
        return F.concat(F.array(t), hans_hant_variants(t))

    def all_of(seed: Column) -> Column:
        runs = F.regexp_extract_all(seed, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), 1)
        return F.concat(forms(F.trim(seed)), F.flatten(F.transform(runs, forms)))

    every = F.filter(F.flatten(F.transform(F.filter(seeds, lambda s: s.isNotNull()), all_of)), lambda t: t != "")
    lowered = F.transform(every, F.lower)
    first = F.filter(every, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
    ordered = F.array_sort(F.transform(first, lambda t: F.struct((-F.length(t)).alias("l"), F.lower(t).alias("k"), t.alias("t"))))
    return F.slice(F.transform(ordered, lambda x: x["t"]), 1, most)


def rewrite_payload(answer: Text) -> Column:
    """domain, synonyms (at most 6) and exclude (at most 4) from a model's answer that holds a JSON object, perhaps in a code fence; null if it names none."""
    trimmed = F.trim(answer)
    fenced = F.nullif(F.trim(F.regexp_extract(trimmed, r"(?is)```(?:json)?\s*(.*?)```", 1)), F.lit(""))
    found = F.from_json(F.nullif(F.regexp_extract(F.coalesce(fenced, trimmed), r"(?s)(\{.*\})", 1), F.lit("")), "domain string, synonyms array<string>, exclude array<string>")

    def listed(name: str, most: int) -> Column:
        each = F.transform(F.coalesce(found[name], F.array().cast("array<string>")), lambda t: collapse(F.coalesce(t, F.lit(""))))
        return F.slice(F.array_distinct(F.filter(each, lambda t: F.length(t) >= 2)), 1, most)

    synonyms, exclude = listed("synonyms", 6), listed("exclude", 4)
    whole = F.struct(F.nullif(F.trim(found["domain"]), F.lit("")).alias("domain"), synonyms.alias("synonyms"), exclude.alias("exclude"))
    return F.when((F.size(synonyms) > 0) | (F.size(exclude) > 0), whole)


def technical_terms(x: Text) -> Column:
    """Identifiers, versions, codes and paths, in the order of the patterns, each once.

    A pattern is tried only where what it can't do without is in the text. None matches
    white space, so runs of it stay as they are.
    """
    lowered = F.lower(x)
    needed = ("c++", "c#", ".net", "node.js", "next.js", "vue.js", "react.js", r"[A-Za-z0-9_]\.[a-z_]", "-", r"[0-9]\.[0-9]", "[1-5][0-9]{2}", "/")
    none = F.array().cast("array<string>")

    def found(low: Column) -> Column:
        may = [low.rlike(n) if "[" in n else F.contains(low, F.lit(n)) for n in needed]
        return F.array_distinct(F.concat(*[F.when(m, F.regexp_extract_all(low, F.lit(f"({p})"), 1)).otherwise(none) for m, p in zip(may, TECHNICAL_PATTERNS)]))

    return let(lowered, found)


def hans_hant_variants(x: Text) -> Column:
    """The term, its traditional and its simplified form, each once. A term of several words stays whole."""
    x = F.trim(x)
    return F.array_distinct(F.array(x, F.translate(x, SIMPLIFIED, TRADITIONAL), F.translate(x, TRADITIONAL, SIMPLIFIED)))


def count_matching(x: Text, char_class: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, char_class, ""))


def language(x: Text) -> Column:
    """zh-Hans, zh-Hant, en, mixed or undetermined, from the shares of scripts."""
    x = collapse(F.coalesce(x, F.lit("")))
    han, latin = count_matching(x, r"\p{IsHan}"), count_matching(x, r"\p{IsLatin}")
    total = F.greatest(count_matching(x, r"\S"), F.lit(1))
    hant = count_matching(x, f"[{HANT_MARKERS}]")
    return (
        F.when(x == "", "undetermined")
        .when((han * 100 >= total * 55) & (latin * 100 < total * 20), F.when(hant >= 2, "zh-Hant").otherwise("zh-Hans"))
        .when((latin * 100 >= total * 55) & (han * 100 < total * 15), "en")
        .when((han > 0) & (latin > 0), "mixed")
        .when(han > 0, F.when(hant >= 1, "zh-Hant").otherwise("zh-Hans"))
        .when(latin > 0, "en")
        .otherwise("undetermined")
    )


def is_quoted(x: Text) -> Column:
    """A collapsed text between a pair of quotes."""
    ends = [("\"", "\""), ("'", "'"), ("「", "」")]
    paired = [F.startswith(x, F.lit(a)) & F.endswith(x, F.lit(b)) for a, b in ends]
    return (F.length(x) > 2) & (paired[0] | paired[1] | paired[2])


def query_kind(x: Text) -> Column:
    """exact_phrase, filename, error_code, symbol or general."""
    x = collapse(F.coalesce(x, F.lit("")))
    bare = F.regexp_replace(x, "^[\"'`「]|[\"'`」]$", "")
    spaced = bare.rlike(r"\s")
    code = r"^(?:ERR_[A-Z0-9_]+|E[A-Z]{2,}[A-Z0-9_]*|[A-Z]{2,}[-_]?[0-9]{2,}|[0-9]{3}\s+[A-Z][A-Za-z ]+)$"
    word = "[A-Za-z_][A-Za-z0-9_]*"
    symbol = rf"^(?:{word}(?:\.{word})+(?:\(\))?|{word}\(\)|[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)+)$"
    return (
        F.when(x == "", "general")
        .when(is_quoted(x), "exact_phrase")
        .when(bare.rlike(rf"(?i)\.({FILE_EXTENSIONS})$") & (~spaced | bare.rlike(r"[/\\]")), "filename")
        .when(bare.rlike(code) | x.rlike(r"(?i)^error\s*[:：]"), "error_code")
        .when(~spaced & (bare.rlike(symbol) | x.rlike("^`[^`]+`$")), "symbol")
        .otherwise("general")
    )


def token_estimate(x: Text) -> Column:
    """Half the length, rounded up."""
    return F.ceil(F.length(F.coalesce(x, F.lit(""))) / 2).cast("long")


def minimum_should_match(n: Column) -> Column:
    """How many of n words a text must hold. Exact arithmetic: no rounding decides."""
    return F.when(n <= 0, 0).when(n <= 2, n).when(n <= 4, F.floor((n * 3 + 3) / 4)).when(n <= 8, F.floor((n * 3 + 4) / 5)).otherwise(F.floor((n + 1) / 2)).cast("long")


def minimum_bigrams(n: Column) -> Column:
    """How many of n Chinese bigrams a text must hold."""
    return F.when(n <= 0, 0).when(n <= 3, n).when(n <= 6, F.floor((n * 3 + 3) / 4)).otherwise(F.floor((n * 3 + 4) / 5)).cast("long")


def redacted(x: Text, secret: str | None = None) -> Column:
    """Access tokens and bearer secrets masked."""
    if secret and len(secret) >= 8:
        x = F.replace(x, F.lit(secret), F.lit("[REDACTED]"))
    x = F.regexp_replace(x, r"(?i)x-access-token:[^@\s]+@", "x-access-token:[REDACTED]@")
    x = F.regexp_replace(x, r"(?i)Bearer\s+[A-Za-z0-9._\-]+", "Bearer [REDACTED]")
    return F.regexp_replace(x, r"gh[pousr]_[A-Za-z0-9_]{20,}", "[REDACTED_GITHUB_TOKEN]")


def is_boilerplate(line: Text) -> Column:
    """Page headers, addresses, page numbers and author lines."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (F.length(t) <= 2) | t.rlike(rf"(?i)^https?://|{START}www\.|QQ\s*[:：群]|网站作品|由\s*[A-Za-z0-9_]+\s*整理|^作者[：:]|^第\s*[0-9]+\s*页\s*$|^[0-9]{{1,4}}$")


def page_decision(text: Text, raster: Column, least: int = 24, worst: float = 0.3) -> Column:
    """native, blank or ocr for a parsed page."""
    text, raster = F.coalesce(text, F.lit("")), F.coalesce(raster, F.lit(False))
    meaningful = count_matching(F.regexp_replace(text, "�", ""), r"[\p{L}\p{N}\x{4e00}-\x{9fff}.,;:!?，。；：！？、]")
    scan = F.when(raster, "ocr").otherwise("blank")
    return (
        F.when(F.length(text) == 0, scan)
        .when(count_matching(text, "�") > F.length(text) * worst, "ocr")
        .when(meaningful < least, scan)
        .otherwise("native")
    )


def heading_title(line: Text) -> Column:
    """Title of an ATX heading line, else an empty text."""
    title = F.regexp_extract(F.regexp_replace(line, r"\s+$", ""), r"^#{1,6}\s+(.+?)\s*$", 1)
    return F.trim(F.regexp_replace(title, r"\s+#+\s*$", ""))


def inferred_heading(x: Text) -> Column:
    """Title of the first heading in the first eight lines, or null."""
    titles = F.transform(F.slice(F.split(x, "\n"), 1, 8), heading_title)
    return F.get(F.filter(titles, lambda t: t != ""), F.lit(0))


def looks_like_markdown(x: Text) -> Column:
    return x.rlike(r"(?m)^#{1,6}\s+\S") | x.rlike("(?m)^```")


def keyword_score(content: Text, terms: Column) -> Column:
    """Characters that non-overlapping occurrences of the terms cover, summed over the terms."""
    return let(F.lower(content), lambda low: covered_characters(low, terms))


def covered_characters(low: Text, terms: Column) -> Column:
    """:func:`keyword_score` of a lower-cased text; terms that it doesn't hold cost a search only."""
    held = F.filter(terms, lambda t: F.contains(low, t))
    return F.aggregate(held, F.lit(0), lambda total, t: total + F.length(low) - F.length(F.replace(low, t, F.lit("")))).cast("long")


def term_coverage(content: Text, terms: Column) -> Column:
    """How many different terms the text holds, whatever the case. Chinese runs whose bigrams are all terms don't count."""
    return let(F.lower(content), lambda low: held_terms(low, terms))


def held_terms(low: Text, terms: Column) -> Column:
    """:func:`term_coverage` of a lower-cased text."""
    return F.size(F.filter(counted_terms(terms), lambda t: F.contains(low, t))).cast("long")


def counted_terms(terms: Column) -> Column:
    """The terms that coverage counts, lower-cased and each once: not those Chinese runs whose bigrams are all terms."""
    wanted = F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(F.lower(t))), lambda t: t != ""))

    def counted(each: Column) -> Column:
        def covered(t: Column) -> Column:
            bigrams = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
            return F.when(t.rlike(r"^\p{IsHan}{3,}$"), F.forall(bigrams, lambda b: F.array_contains(each, b))).otherwise(F.lit(False))

        return F.filter(each, lambda t: ~covered(t))

    return let(wanted, counted)


def contains_term(content: Text, term: str) -> Column:
    """Chinese terms as substrings, others as whole words, whatever the case."""
    lowered = F.lower(content)
    if any("㐀" <= c <= "鿿" for c in term):
        return F.contains(lowered, F.lit(term.lower()))
    escaped = "".join("\\" + c if c in r".^$*+?()[]{}|\\/-" else c for c in term.lower())
    return lowered.rlike(rf"(?<![\p{{L}}\p{{N}}_]){escaped}(?![\p{{L}}\p{{N}}_])")


def excluded(content: Text, positives: Sequence[str], excludes: Sequence[str]) -> Column:
    """Whether a rewrite drops the text: an exclude is in it and no positive term is."""
    hit = lambda terms: F.coalesce(*[F.when(contains_term(content, t), True) for t in terms], F.lit(False))
    return hit(excludes) & ~hit(positives)


def is_private_host(host: Text) -> Column:
    """Addresses that a fetch must not reach; names count as public, forms that can't be read as private."""
    part = [F.regexp_extract(host, r"^([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", i).try_cast("int") for i in (1, 2)]
    a, b = part
    return (
        F.when(host.isin("::1", "0.0.0.0", "::", "localhost"), True)
        .when(host.rlike("^(fc|fd|fe80:|2001:db8:)") & host.contains(":"), True)
        .when(a.isNotNull(), a.isin(10, 127, 0) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224))
        .otherwise(F.lit(False))
    )


def is_safe_relative_path(path: Text) -> Column:
    """Not empty, absolute, on a drive, or leading upwards."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (F.length(F.trim(p)) > 0) & ~p.rlike("^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)")


def citation_markers(x: Text) -> Column:
    """[S1] style markers in the order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[(S[0-9]+)\]"), 1))


def truncated(x: Text, max_tokens: int, mark: str = "…[截断]") -> Column:
    """Cut to a token budget, at the last sentence end if that lies beyond half, and marked."""
    chars = max(1, 2 * max(1, max_tokens - -(-len(mark) // 2)))
    head = F.substring(x, 1, chars)
    soft = F.length(F.regexp_extract(head, r"(?s)^(.*(?:\n|。|\. |！|？))", 1)) - F.when(F.regexp_extract(head, r"(?s)^(.*(?:\n|。|\. |！|？))", 1).endswith(". "), 1).otherwise(0)
    cut = F.when(soft - 1 > chars * 0.5, F.substring(head, F.lit(1), soft)).otherwise(head)
    return F.when(token_estimate(x) <= max_tokens, x).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit(mark)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero; different lengths are an error."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    a, b = double(a), double(b)
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension")).cast("double")).when(norm == 0, 0.0).otherwise(dot / norm)
