"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words. Anchors are shorter runs of words that
are hashed only where the word's position, modulo a period, lies in a difference
cover: for any two positions some offset below the period takes both into the
cover, so two equal windows share an anchor at the same offset in each. Only
anchors that repeat are looked at again: each is extended to all windows around
it, and the words of windows whose hashes (96 bits) repeat are removed.

Work and shuffles are linear in the text: hashes travel in packed blocks
(:mod:`tessera.llm.blocks`), and only documents with a repeated anchor have their
text shuffled a second time.

Defined cases: a null or empty text has no words and the kept text is empty; rows
that repeat are copies of each other, so both lose the words of any full window;
documents shorter than a window lose nothing; a null doc_id is passed on; further
columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.batches import WordHasher, run_hashes, text_steps
from tessera.plans.storage import materialise

WINDOW = 35
#: Bytes of a word and the space behind it, on the low side: the number of ranges follows from it, no result does.
LEAST_BYTES = 5
#: A period and its difference cover (fixed values: a perfect difference set modulo 21).
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

_FIRST, _SECOND = WordHasher(0x9E3779B97F4A7C15), WordHasher(0xD6E8FEB86659FD93)


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Words:
    """The hashed words of several texts one after another, and of each text the number and the place of its first."""

    def __init__(self, texts: list[bytes | None]):
        self.hashes, self.counts = _FIRST.of(texts)
        self.firsts = np.cumsum(self.counts) - self.counts

    def starts(self, length: int) -> np.ndarray:
        """Whether a run of ``length`` words starts at a place and ends in the same text."""
        place = np.arange(len(self.hashes))
        ends = np.repeat(self.firsts + self.counts, self.counts)
        return place + length <= ends

    def within(self) -> np.ndarray:
        """Each word's place in its text."""
        return np.arange(len(self.hashes)) - np.repeat(self.firsts, self.counts)


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs that start at each place; anything where no run starts."""
    out = np.zeros(len(words), np.uint64)
    found = run_hashes(words, length)
    out[: len(found)] = found
    return out


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    length = window - period + 1
    chosen = np.isin(np.arange(period), cover)

    def entries(batch: pa.RecordBatch, texts: list[bytes | None], held: blocks.Gathered) -> None:
        w = _Words(texts)
        if not len(w.hashes):
            return
        long = np.repeat(w.counts >= window, w.counts)
        at = np.flatnonzero(w.starts(length) & long & chosen[w.within() % period])
        hashes = _runs(w.hashes, length)[at].view(blocks.NARROW)
        held.add(hashes, at, w.firsts, batch.column(0).to_numpy(zero_copy_only=False), len(w.hashes))

    return entries


def _positions(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", "<u4").astype(np.int64)


def _spans(n: int, starts: np.ndarray, before: int, after: int) -> np.ndarray:
    """Places from ``start - before`` to ``start + after`` of any start, of ``n`` places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts - before, 0, n), 1)
    np.add.at(edge, np.clip(starts + after + 1, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _windows(window: int, period: int):
    def entries(batch: pa.RecordBatch, texts: list[bytes | None], held: blocks.Gathered) -> None:
        w = _Words(texts)
        anchors = [_positions(x) + first for x, first in zip(batch.column(2).to_pylist(), w.firsts.tolist())]
        # An anchor starts within the first ``period`` words of a window.
        at = np.flatnonzero(w.starts(window) & _spans(len(w.hashes), np.concatenate(anchors), period - 1, 0))
        hashes = np.empty(len(at), blocks.WIDE)
        hashes["a"] = _runs(w.hashes, window)[at]
        hashes["b"] = _runs(_SECOND.of(texts)[0], window)[at].astype(np.uint32)
        held.add(hashes, at, w.firsts, batch.column(0).to_numpy(zero_copy_only=False), len(w.hashes))

    return entries


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a repeated anchor get their result; the others keep text and anchors."""
    for batch, texts in text_steps(batches):
        pending = [x is not None for x in batch.column(3).to_pylist()]
        words = [(x or b"").split() for x in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(pending),
                pa.array([len(x) for x in words], pa.int64()),
                pa.array([None if p else _sha(x) for p, x in zip(pending, words)], pa.string()),
                pa.array([x if p else None for p, x in zip(pending, texts)], pa.binary()).view(pa.string()),  # as they are, UTF-8 or not
                batch.column(3),
            ],
            ["id", "doc_id", "pending", "n_words", "kept_sha256", "text", "anchors"],
        )


def _kept(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_steps(batches):
            removed, shas, spans = [], [], []
            for text, parts in zip(texts, batch.column(2).to_pylist()):
                words = text.split()
                gone = _spans(len(words), _positions(parts), 0, window - 1)
                removed.append(int(gone.sum()))
                shas.append(_sha([w for w, g in zip(words, gone.tolist()) if not g]))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append(edges.reshape(-1, 2).tolist())
            n_words = batch.column(3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_words, pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans"],
            )

    return run


def _ranges(rows: DataFrame, share: float) -> int:
    """Ranges of bounded size for the entries of ``share`` of all words; a text of shorter words makes them larger in proportion."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / LEAST_BYTES * share / blocks.RANGE_ENTRIES))


def substring_dedup(documents: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """For every row: doc_id, n_words, n_removed, kept_sha256, and the spans of removed words (first, end)."""
    if window < period or not covers(period, cover):
        raise ValueError("the cover must be a difference cover of a period no longer than the window")
    text = F.col("text").cast("string")
    rows = documents.select(F.xxhash64("doc_id", text).alias("id"), F.col("doc_id").cast("long"), text.alias("text"))
    anchors = blocks.repeated(rows.select("id", "text"), _ranges(rows, len(cover) / period), blocks.NARROW, _anchors(window, period, cover)).withColumnRenamed("positions", "anchors")
    settled = materialise(
        rows.join(anchors, "id", "left").select("id", "doc_id", "text", "anchors").mapInArrow(
            _settled, "id long, doc_id long, pending boolean, n_words long, kept_sha256 string, text string, anchors binary"
        ),
        "settled",
    )
    pending = settled.filter("pending")
    starts = blocks.repeated(pending.select("id", "text", "anchors"), _ranges(pending, 1.0), blocks.WIDE, _windows(window, period))
    cut = pending.select("id", "doc_id", "text", "n_words").join(starts, "id", "left").select("doc_id", "text", "positions", "n_words")
    done = settled.filter(~F.col("pending")).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast("array<array<bigint>>").alias("removed_spans"))
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<array<bigint>>"
    return done.unionByName(cut.mapInArrow(_kept(window), result))


#: Windows counted in SQL; the kept text is hashed as the operator does.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(words[i:i+34], ' ')) AS n FROM starts
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM windows WHERE n > 1
), removed AS (
  SELECT doc_id, list(place) AS places, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n_removed IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(places, p)), lambda p: words[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id)
"""
