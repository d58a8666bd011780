"""Arrow batches of texts as UTF-8 bytes, cut to a bounded size, and hashed words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step in a Python worker holds at once (a single longer text is a step of its own).
STEP_BYTES = 4 << 20


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Hand free memory back to the system: workers outlive their tasks, and all share the memory of one executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_steps(batches: Iterable[pa.RecordBatch], column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about ``step_bytes`` of text each, and their texts as bytes."""
    for batch in batches:
        give_back()
        column_of = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        lengths = pc.fill_null(pc.binary_length(column_of), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            size += n
            if size >= step_bytes or i + 1 == len(lengths):
                # Only the step's texts become Python objects: a batch may hold many steps.
                yield batch.slice(start, i + 1 - start), column_of.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0
        del batch, column_of
    give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words, order-sensitive; empty if there are fewer words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Horner's rule by doubling: a run of 2k words is made from two runs of k.
    base = np.uint64(0x9E3779B97F4A7C15)
    out, done, power, span, size = None, 0, base, words, 1
    left = length
    while left:
        if left & 1:
            part = span[done : done + n]
            with np.errstate(over="ignore"):
                out = part.copy() if out is None else out * power + part
            done += size
        left >>= 1
        if left:
            with np.errstate(over="ignore"):
                span = mixed(span[:-size] * power + span[size:]) if len(span) > size else span[:0]
                power = power * power + np.uint64(2)
            size *= 2
    return mixed(out)


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
CHUNK_BYTES = 1 << 20


class WordHasher:
    """64-bit hashes of the words of texts, for whole arrays of bytes at once.

    A word's hash is a polynomial of its bytes, modulo 2**64, from the difference of two
    running sums over the text, then mixed with its length.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            for x in steps:
                x[0] = 1
            self.powers, self.inverses = np.cumprod(steps[0]), np.cumprod(steps[1])

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words one after another, and how many each text has."""
        _, hashes, _, _, counts = self.located(texts)
        return hashes, counts

    def located(self, texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as one; of all words the hashes, and where each starts and ends there; and how many each text has."""
        raw = b" ".join([x or b"" for x in texts]) + b" "
        lengths = np.array([len(x or b"") + 1 for x in texts], np.int64)
        parts, at = [], 0
        while at < len(raw):
            end = len(raw)
            if end - at > CHUNK_BYTES:
                end = raw.rfind(b" ", at, at + CHUNK_BYTES) + 1 or raw.find(b" ", at + CHUNK_BYTES) + 1
            hashes, starts, ends = self._chunk(np.frombuffer(raw, np.uint8, end - at, at))
            parts.append((hashes, starts + at, ends + at))
            at = end
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
        return raw, hashes, starts, ends, np.diff(np.searchsorted(starts, np.append(0, np.cumsum(lengths))))

    def _chunk(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._grow(len(raw) + 1)
        edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True))
        starts = edges[::2]
        ends = edges[1::2] if len(edges) % 2 == 0 else np.append(edges[1::2], len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mixed(value + (ends - starts).astype(np.uint64)), starts, ends
