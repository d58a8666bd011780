"""Recognised pages: boxes, blocks in reading order, and the blocks behind a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerance of boxes, widest span of a union, and sizes of a block's and a page's text.
EPS, WIDEST = 1e-9, 0.85
MOST_BLOCK, MOST_PAGE = 8000, 100_000
BLOCK = "struct<text:string,bbox:struct<x:double,y:double,width:double,height:double>,confidence:double,readingOrder:double,language:string>"
LINE = f"protocolVersion int, requestId string, ok boolean, code string, pageNumber int, blocks array<{BLOCK}>, engine string, engineVersion string, warnings array<string>"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clamped(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The box cut to the unit square; null if a value isn't finite, or width or height is negative."""
    sound = _finite(x) & _finite(y) & _finite(width) & _finite(height) & (width >= -EPS) & (height >= -EPS)
    nx, ny = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
    size = lambda s, n: F.least(F.greatest(s, F.lit(0.0)), F.greatest(1 - n, F.lit(0.0)))
    return F.when(sound, F.struct(nx.alias("x"), ny.alias("y"), size(width, nx).alias("width"), size(height, ny).alias("height")))


def from_bottom_left(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box whose y counts from below, clamped."""
    return clamped(x, 1 - y - height, width, height)


def union_or_null(boxes: DataFrame, keys: list[str], widest: float = WIDEST) -> DataFrame:
    """The clamped box around the boxes of each key, or null where it spans more than ``widest`` either way."""
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    sides = boxes.groupBy(*keys).agg(F.least(F.min("x"), F.lit(1.0)).alias("_x"), F.least(F.min("y"), F.lit(1.0)).alias("_y"), F.greatest(F.max(right), F.lit(0.0)).alias("_r"), F.greatest(F.max(bottom), F.lit(0.0)).alias("_b"))
    width, height = F.greatest(F.col("_r") - F.col("_x"), F.lit(0.0)), F.greatest(F.col("_b") - F.col("_y"), F.lit(0.0))
    return sides.select(*keys, F.when((width <= widest) & (height <= widest), clamped(F.col("_x"), F.col("_y"), width, height)).alias("box"))


def parsed_lines(lines: DataFrame, version: int = 1) -> DataFrame:
    """request_id, page, text, n_blocks, warnings and error of each answer (request_id, page, line) of a recogniser.

    Blocks whose box can't be mended go with a warning; the others stand in reading
    order. An answer of another version, request or page, one that isn't well-formed,
    or one with too long a text, is an error as a whole.
    """
    protocol = "OCR_HELPER_PROTOCOL_ERROR"
    held = lines.withColumn("_o", F.from_json("line", LINE))
    o, blocks = F.col("_o"), F.col("_o.blocks")
    box = lambda b: clamped(b["bbox"]["x"], b["bbox"]["y"], b["bbox"]["width"], b["bbox"]["height"])
    kept = F.filter(blocks, lambda b: box(b).isNotNull())
    in_order = F.transform(F.array_sort(F.transform(kept, lambda b, i: F.struct(b["readingOrder"].alias("o"), i.alias("i"), b["text"].alias("t")))), lambda x: x["t"])
    text = F.array_join(in_order, "\n")
    bad = F.exists(blocks, lambda b: b["text"].isNull() | (F.length(b["text"]) > MOST_BLOCK) | ~_finite(b["readingOrder"]))
    error = (
        F.when(o.isNull() | o["requestId"].isNull() | ~F.coalesce(o["protocolVersion"] == version, F.lit(False)) | (o["requestId"] != F.col("request_id")), protocol)
        .when(~o["ok"], F.coalesce(F.nullif(o["code"], F.lit("")), F.lit(protocol)))
        .when(o["ok"].isNull() | ~F.coalesce(o["pageNumber"] == F.col("page"), F.lit(False)) | blocks.isNull() | bad, protocol)
        .when(F.length(text) > MOST_PAGE, protocol)
    )
    skipped = F.array_repeat(F.lit("skipped_invalid_bbox"), F.greatest(F.size(blocks) - F.size(kept), F.lit(0)))
    fine = error.isNull()
    return held.select(
        "request_id", "page", F.when(fine, text).alias("text"), F.when(fine, F.size(kept)).alias("n_blocks"),
        F.when(fine, F.concat(F.coalesce(o["warnings"], F.array().cast("array<string>")), skipped)).alias("warnings"), error.alias("error"),
    )


def mapped_blocks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """chunk_id, refs (block_id, first, end) and degraded, for chunks (chunk_id, page_id, content) and blocks (page_id, block_id, reading_order, text).

    Blocks that have to do with a chunk must stand in it as a whole, each looked for
    after the one before it, then from the beginning; if one doesn't, or none has to do
    with the chunk, the chunk's place is its page. A page's blocks are few.
    """
    of_page = blocks.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("reading_order", F.lit(0)).alias("o"), "block_id", F.coalesce("text", F.lit("")).alias("text")))).alias("_blocks"))
    content = F.coalesce(F.col("content"), F.lit(""))

    def related(b: Column) -> Column:
        snippet = F.trim(b["text"])
        prefix = F.substring(snippet, 1, 16)
        return (snippet != "") & (F.contains(content, snippet) | ((F.length(prefix) >= 4) & F.contains(content, prefix)) | ((content != "") & F.contains(snippet, F.substring(content, 1, 48))))

    ref = "array<struct<block_id:bigint,first:int,end:int>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast(ref).alias("refs"), F.lit(False).alias("lost"))

    def place(held: Column, b: Column) -> Column:
        after = F.position(b["text"], content, held["at"])
        found = F.when(after > 0, after).otherwise(F.position(b["text"], content))
        more = F.array(F.struct(b["block_id"].cast("long").alias("block_id"), (found - 1).alias("first"), (found - 1 + F.length(b["text"])).alias("end")))
        return F.struct((found + F.length(b["text"])).alias("at"), F.concat(held["refs"], more).alias("refs"), (held["lost"] | (found == 0)).alias("lost"))

    met = chunks.join(of_page, "page_id", "left").withColumn("_related", F.filter("_blocks", related))
    none = F.array().cast(ref)
    folded = met.withColumn("_fold", F.aggregate("_related", start, place))
    empty = (content == "") | F.col("_blocks").isNull()
    degraded = ~empty & ((F.size("_related") == 0) | F.col("_fold.lost"))
    return folded.select("chunk_id", F.when(empty | degraded, none).otherwise(F.col("_fold.refs")).alias("refs"), degraded.alias("degraded"))


def page_summary(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages by decision (ocr, native, blank), and whether any needs recognition."""
    n = lambda d: F.count_if(F.col("decision") == d)
    return pages.groupBy(*keys).agg((n("ocr") > 0).alias("needs_ocr"), n("ocr").alias("ocr_pages"), n("native").alias("native_pages"), n("blank").alias("blank_pages"))


def pages_to_do(pages: DataFrame, done: DataFrame, most_ocr: int = 100) -> DataFrame:
    """Pages (document_id, page_id, decision) that a resumed run still has to take; of those to recognise, a document's first ``most_ocr``."""
    left = pages.join(done.select("page_id"), "page_id", "left_anti")
    smaller = left.filter("decision = 'ocr'").select("document_id", "page_id")
    first = smaller.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("page_id"))).filter(F.col("_n") <= most_ocr)
    return left.filter("decision <> 'ocr'").unionByName(left.join(first.select("page_id"), "page_id", "left_semi"))
