"""Where a hit stands in its document, and how it is quoted in a prompt; all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as fn

# File names that count as Markdown, and as code; names of origins; frame around quoted texts.
MARKDOWN_NAME = r"\.(md|markdown|txt|rst)$"
CODE_NAME = r"\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|h|cs|rb|php|swift|kt|scala)$"
LIBRARY, CONVERSATION = "资料库", "本对话附件"
OPEN_FRAME, CLOSE_FRAME = "<<<LOCAL_KNOWLEDGE>>>", "<<<END_LOCAL_KNOWLEDGE>>>"


def locator(hit: dict[str, Column]) -> Column:
    """kind, path, commit, heading_path, page and the lines or offsets of a hit.

    ``hit``: name, revision_id, heading_path, content, page, start_line, end_line,
    start_offset, end_offset. Code with lines is told by them, Markdown by its headings
    (else the first heading in the content), all others by their page.
    """
    name = F.lower(hit["name"])
    lined = hit["start_line"].isNotNull() | hit["end_line"].isNotNull()
    kind = F.when(name.rlike(CODE_NAME) & lined, "code").when(name.rlike(MARKDOWN_NAME), "markdown").otherwise("page")
    inferred = fn.inferred_heading(hit["content"])
    headings = F.when(F.size(F.coalesce(hit["heading_path"], F.array().cast("array<string>"))) > 0, hit["heading_path"]).when(inferred.isNotNull(), F.array(inferred))
    first = F.when(kind == "code", F.coalesce(hit["start_line"], F.lit(1))).when(kind == "markdown", hit["start_line"]).otherwise(hit["start_offset"])
    last = F.when(kind == "code", F.coalesce(hit["end_line"], hit["start_line"], F.lit(1))).when(kind == "markdown", hit["end_line"]).otherwise(hit["end_offset"])
    return F.struct(
        kind.alias("kind"), F.when(kind == "code", hit["name"]).alias("path"), F.when(kind == "code", F.coalesce(hit["revision_id"], F.lit("legacy"))).alias("commit"),
        F.when(kind == "markdown", headings).alias("heading_path"), F.when(kind == "page", hit["page"]).alias("page"), first.alias("first"), last.alias("last"),
    )


def label(place: Column, title: Column) -> Column:
    """A locator as text."""
    span = F.concat(place["first"].cast("string"), F.lit("-"), place["last"].cast("string"))
    headings = F.coalesce(F.array_join(place["heading_path"], " / "), title)
    return (
        F.when(place["kind"] == "code", F.concat(place["path"], F.lit(":"), span))
        .when(place["kind"] == "markdown", F.concat(headings, F.coalesce(F.concat(F.lit(" L"), span), F.lit(""))))
        .otherwise(F.concat(F.lit("第 "), place["page"].cast("string"), F.lit(" 页"), F.coalesce(F.concat(F.lit("，字符 "), span), F.lit(""))))
    )


def block(marker: Column, source: Column, title: Column, place: Column, content: Column) -> Column:
    """A quoted chunk under its marker, origin, title and place."""
    origin = F.when(source == "conversation_file", CONVERSATION).otherwise(LIBRARY)
    return F.concat(F.lit("["), marker, F.lit("] ("), origin, F.lit(" · "), title, F.lit("，"), label(place, title), F.lit(")\n"), content)


def frame(blocks: Column, rules: str = "") -> Column:
    """Quoted chunks between marks that set them off as data; an empty text if there are none."""
    body = F.array_join(blocks, "\n\n")
    return F.when(F.size(blocks) == 0, "").otherwise(F.concat(F.lit(f"{rules}\n{OPEN_FRAME}\n".lstrip("\n")), body, F.lit(f"\n{CLOSE_FRAME}")))


# Fixed value: a bracket with one or several markers.
_GROUP = r"(?i)\[\s*(S[0-9]+(?:\s*[,，、;；]\s*S[0-9]+)*)\s*\]"
_BLANK = r"[\s\x{00a0}\x{3000}\x{feff}]"


def markers_of(x: Column, allowed: Column | None = None) -> Column:
    """S1-style ids in the order of their first appearance, also from brackets with several; those of the array ``allowed``, if it is given."""
    groups = F.regexp_extract_all(x, F.lit(_GROUP), 1)
    ids = F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"([0-9]+)"), 1))), lambda n: F.concat(F.lit("S"), n)))
    return ids if allowed is None else F.filter(ids, lambda i: F.array_contains(allowed, i))


def _line(line: Column, allowed: Column) -> Column:
    """The line with its allowed markers, each in brackets of its own, at its end and no marker elsewhere."""
    leading = F.regexp_extract(line, r"^([ \t]*)", 1)
    body = F.regexp_replace(F.regexp_replace(line, r"^[ \t]*", ""), _GROUP, "")
    body = F.regexp_replace(body, r"[ \t\x{00a0}\x{3000}]+([。．.！!？?；;，,])", "$1")
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t\x{00a0}\x{3000}]{2,}", " "), r"[ \t\x{00a0}\x{3000}]+$", "")
    return F.concat(leading, body, F.array_join(F.transform(markers_of(line, allowed), lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))


def canonical(x: Column, allowed: Column) -> Column:
    """An answer whose markers stand at the ends of their lines; a line of nothing but markers joins the last line above it that isn't blank.

    A fold over the lines of one text: what is above and including that line, and the blank lines behind it.
    """
    lines = F.transform(F.split(x, "\n"), lambda line: _line(line, allowed))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("tail"), F.lit(False).alias("anchored"), F.lit("").alias("gap"))

    def step(held: Column, line: Column) -> Column:
        trimmed = F.regexp_replace(line, f"^{_BLANK}+|{_BLANK}+$", "")
        joins = held["anchored"] & trimmed.rlike(r"^(?:\[S[0-9]+\])+$")
        state = lambda text, tail, anchored: F.struct(text.alias("text"), tail.alias("tail"), anchored.alias("anchored"), F.lit("\n").alias("gap"))
        return (
            F.when(joins, state(F.concat(F.regexp_replace(held["text"], r"[ \t]+$", ""), trimmed), held["tail"], F.lit(True)))
            .when(trimmed == "", state(held["text"], F.concat(held["tail"], held["gap"], line), held["anchored"]))
            .otherwise(state(F.concat(held["text"], held["tail"], held["gap"], line), F.lit(""), F.lit(True)))
        )

    whole = F.aggregate(lines, start, step, lambda held: F.concat(held["text"], held["tail"]))
    return F.regexp_replace(F.regexp_replace(whole, r"\n{3,}", "\n\n"), f"{_BLANK}+$", "")


def linked(x: Column, allowed: Column) -> Column:
    """Canonical text with each run of markers as one Markdown link to the allowed ones in it; a run without any stays."""
    runs = F.split(x, r"(?<!\[S[0-9]{1,9}\])(?=\[S[0-9]+\])|(?<=\[S[0-9]{1,9}\])(?!\[S[0-9]+\])")

    def one(part: Column) -> Column:
        ids = markers_of(part, allowed)
        return F.when(part.rlike(r"^(?:\[S[0-9]+\])+$") & (F.size(ids) > 0), F.concat(F.lit("[来源](citation:"), F.array_join(ids, ","), F.lit(")"))).otherwise(part)

    return F.array_join(F.transform(runs, one), "")
