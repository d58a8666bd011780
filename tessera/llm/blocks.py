"""Hashes that occur more than once, found through packed blocks.

A task gathers (hash, position) entries of many documents and hands them on as
blocks, one for each hash range, of sorted hashes with their positions. A hash that
a task holds several times is handed on once: the task knows already that it
repeats. So a range gets at most one entry of a hash from each flush of a task, and
a passage in a third of all rows doesn't fill one partition. Answers go back to
the flush that asked, which knows its documents, one row from each range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.batches import text_steps

#: Entries that a task gathers before it hands them on, and entries of one range, about.
FLUSH_ENTRIES, RANGE_ENTRIES = 3_000_000, 2_000_000
SCHEMA = "hash_range int, flush long, hashes binary, positions binary, firsts binary, ids binary"
ANSWERS = "flush long, positions binary, firsts binary, ids binary"
_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["hash_range", "flush", "hashes", "positions", "firsts", "ids"]
NARROW = np.dtype([("a", "<u8")])
WIDE = np.dtype([("a", "<u8"), ("b", "<u4")])


def _order(hashes: np.ndarray) -> np.ndarray:
    return np.argsort(hashes["a"], kind="stable") if hashes.dtype == NARROW else np.lexsort((hashes["b"], hashes["a"]))


def _same_as_next(ordered: np.ndarray) -> np.ndarray:
    same = ordered["a"][1:] == ordered["a"][:-1]
    return same if ordered.dtype == NARROW else same & (ordered["b"][1:] == ordered["b"][:-1])


class Gathered:
    """Entries of a task: hashes, positions in a running count over all documents, and where each document starts."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.entries = self.length = 0

    def add(self, hashes: np.ndarray, positions: np.ndarray, firsts: np.ndarray, ids: np.ndarray, length: int) -> None:
        """Entries of further documents; positions and firsts count from these documents' beginning."""
        self.hashes.append(hashes)
        self.positions.append((positions + self.length).astype(np.uint32))
        self.firsts.append((firsts + self.length).astype(np.uint32))
        self.ids.append(ids)
        self.entries += len(hashes)
        self.length += length

    def full(self) -> bool:
        return self.entries >= FLUSH_ENTRIES or self.length >= 1 << 31

    def blocks(self, flush: int, ranges: int) -> Iterator[pa.RecordBatch]:
        """Blocks for the ranges, and one (range below 0) with the flush's documents and what it knows to repeat."""
        if not self.entries:
            return
        hashes, positions = np.concatenate(self.hashes), np.concatenate(self.positions)
        order = _order(hashes)
        hashes, positions = hashes[order], positions[order]
        same = _same_as_next(hashes)
        again = np.append(False, same)  # an earlier entry has this hash
        several = again | np.append(same, False)
        one, asking, known = hashes[~again], positions[~again], several[~again]
        where = ((one["a"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(where, np.arange(ranges + 1)).tolist()
        rows = [(-1 - flush % ranges, flush, None, positions[several].tobytes(), np.concatenate(self.firsts).tobytes(), np.concatenate(self.ids).tobytes())]
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:  # what is known to repeat goes last and without a position: nobody has to answer
                told = known[a:b]
                rows.append((r, flush, one[a:b][~told].tobytes() + one[a:b][told].tobytes(), asking[a:b][~told].tobytes(), None, None))
        for start in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[start : start + 64]), _TYPES)], _NAMES)


def gathering(ranges: int, entries: Callable[[pa.RecordBatch, list[bytes | None], Gathered], None]):
    """For mapInArrow: blocks of what ``entries`` adds for each step of texts. The rows of a partition must come in the same order each time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, held = TaskContext.get().partitionId() << 24, Gathered()
        for batch, texts in text_steps(batches):
            entries(batch, texts, held)
            if held.full():
                yield from held.blocks(flush, ranges)
                flush, held = flush + 1, Gathered()
        yield from held.blocks(flush, ranges)

    return run


def repeats(dtype: np.dtype):
    """For mapInArrow over blocks dealt by hash_range: the positions that repeat, for each flush."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            passed = []
            for r, flush, hashes, positions, firsts, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if r < 0:
                    passed.append((flush, positions, firsts, ids))
                else:
                    held.setdefault(r, []).append((flush, np.frombuffer(hashes, dtype), np.frombuffer(positions, "<u4")))
            yield from _answer_rows(passed)
        for r in list(held):
            parts = held.pop(r)
            everything = np.concatenate([hashes for _, hashes, _ in parts])
            order = _order(everything)
            same = _same_as_next(everything[order])
            hit = np.zeros(len(everything), bool)
            hit[order] = np.append(same, False) | np.append(False, same)
            at, rows = 0, []
            for flush, hashes, positions in parts:
                if (mine := positions[hit[at : at + len(positions)]]).size:
                    rows.append((flush, mine.tobytes(), None, None))
                at += len(hashes)
            yield from _answer_rows(rows)

    return run


def _answer_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    for start in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[start : start + 64]), types)], ["flush", "positions", "firsts", "ids"])


def by_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over answers dealt by flush: id and positions within the document, of each document with any."""
    found: dict[int, list[bytes]] = {}
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for flush, positions, firsts, ids in zip(*[c.to_pylist() for c in batch.columns]):
            found.setdefault(flush, []).append(positions)
            if ids is not None:
                tables[flush] = np.frombuffer(firsts, "<u4"), np.frombuffer(ids, "<i8")
    for flush, parts in found.items():
        firsts, ids = tables[flush]
        positions = np.sort(np.frombuffer(b"".join(parts), "<u4"))
        if not len(positions):
            continue
        doc = np.searchsorted(firsts, positions, "right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        relative = (positions - firsts[doc]).astype("<u4")
        starts, ends = np.append(0, cuts), np.append(cuts, len(doc))
        for at in range(0, len(starts), 5000):
            a, b = starts[at : at + 5000], ends[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc[a]]), pa.array([relative[x:y].tobytes() for x, y in zip(a, b)], pa.binary())], ["id", "positions"])


def repeated(rows: DataFrame, ranges: int, dtype: np.dtype, entries: Callable[[pa.RecordBatch, list[bytes | None], Gathered], None]) -> DataFrame:
    """id, and the positions of its entries that occur elsewhere or twice, for each id with any; ``rows``: id, text and what ``entries`` reads besides."""
    asked = rows.mapInArrow(gathering(ranges, entries), SCHEMA).repartition(ranges, "hash_range")
    answers = asked.mapInArrow(repeats(dtype), ANSWERS).repartition(ranges, "flush")
    return answers.mapInArrow(by_document, "id long, positions binary").dropDuplicates(["id"])
