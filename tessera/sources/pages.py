"""Web pages and text documents as sources of parsed text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as fn

_SKIPPED = frozenset({"script", "style", "iframe", "object", "embed", "noscript", "template", "head"})
_BREAKS = frozenset({"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "blockquote", "pre"})


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.hidden = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _SKIPPED
        self.in_title = self.in_title or tag == "title"
        if tag in _BREAKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in _SKIPPED))
        if tag == "title":
            self.in_title = False
        if tag in _BREAKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(data)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def _parsed(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for page in pages:
        rows = []
        for html in page:
            parser = _Text()
            parser.feed(html or "")
            parser.close()
            rows.append((" ".join("".join(parser.title).split()), " ".join("".join(parser.parts).split())))
        yield pd.DataFrame(rows, columns=["title", "body"])


def web_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, content: the page's visible text under its title and address."""
    parsed = pages.withColumn("_p", _parsed(F.col("html")))
    title = F.coalesce(F.nullif(F.col("_p.title"), F.lit("")), F.col("url"))
    return parsed.select("page_id", "url", title.alias("title"), F.concat(F.lit("# "), title, F.lit("\n\n来源: "), F.col("url"), F.lit("\n\n"), F.col("_p.body"), F.lit("\n")).alias("content"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def is_safe_url(url: Column) -> Column:
    """http or https, with a public host and without credentials. Names aren't resolved here."""
    bare = F.regexp_replace(host(url), r"^\[|\]$", "")
    return url.rlike(r"(?i)^https?://") & ~url.rlike(r"^[^/]*//[^/]*@") & (bare != "") & ~fn.is_private_host(bare)


def kind(name: Column, mime: Column, content: Column) -> Column:
    """pdf, markdown or text of a file's name, type and bytes; null if it is none of them."""
    head = F.substring(content, 1, 1024)
    magic = F.contains(F.decode(head, "ISO-8859-1"), F.lit("%PDF-"))
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    claimed = F.when(extension.isin("md", "markdown") | (mime == "text/markdown"), "markdown").when(extension.isin("txt", "text") | mime.startswith("text/"), "text")
    start = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    control = F.length(start) - F.length(F.regexp_replace(start, r"[\x00-\x08\x0e-\x1f]", ""))
    textual = ~F.contains(start, F.lit("\x00")) & (control * 20 <= F.length(start))
    return F.when(magic, "pdf").when((extension == "pdf") | (mime == "application/pdf"), None).when(textual, claimed)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, sha256 and text of the text files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,txt}").load(folder)
    found = raw.select("path", kind(F.col("path"), F.lit(""), F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"), "content")
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""), "\r\n", "\n")
    return found.filter("kind is not null").select("path", "kind", "sha256", F.trim(text).alias("text"))
