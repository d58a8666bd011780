"""Best-fit packing of tokenised documents into sequences of bounded size.

A document's ids end with id 1; a document longer than a sequence is cut into
full pieces and a rest. Pieces are dealt by hash into groups of about
``GROUP_PIECES``; each group is packed by vector best-fit: a bin has residual
capacities for tokens, documents and attention cost (the sum of squared
lengths), and a piece goes to the open bin that can take it under every
constraint and scores best, by the weighted norm of what would be left or by the
weighted dot-product of demand and residual. A group leaves a bin or two partly
filled, out of thousands.

Defined cases: a null or empty text is the one id 1; repeated rows are packed as
rows of their own; a null doc_id is passed on; bytes that aren't UTF-8 count as U+FFFD; further columns are ignored; an
empty table gives an empty result; a text of any length is tokenised whole.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import WordHasher, text_steps
from tessera.plans.storage import materialise

SEQUENCE_TOKENS = 4096
GROUP_PIECES = 20_000
#: Bytes of text that a task tokenises at once: the arrays for a step's words and ids take some twenty times as much.
STEP_BYTES = 1 << 20
EOS = 1


class HashPlaces:
    """Places of 64-bit hashes, looked up for whole arrays at once: open addressing, at most half full."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.places, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0

    def _next(self, hashes: np.ndarray, slots: np.ndarray | None = None) -> np.ndarray:
        mask = len(self.keys) - 1
        return (hashes & np.uint64(mask)).astype(np.int64) if slots is None else (slots + 1) & mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        hashes = np.maximum(hashes, 1)  # a key of 0 is a free slot
        slots = self._next(hashes)
        keys = self.keys[slots]
        out = np.where(keys == hashes, self.places[slots], np.int32(-1))
        todo = np.flatnonzero((keys != hashes) & (keys != 0))
        slots = slots[todo]
        while len(todo):
            slots = self._next(hashes, slots)
            keys, wanted = self.keys[slots], hashes[todo]
            met = keys == wanted
            out[todo[met]] = self.places[slots[met]]
            on = ~met & (keys != 0)
            todo, slots = todo[on], slots[on]
        return out

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Further hashes, none twice and none known."""
        if 2 * (self.size + len(hashes)) > len(self.keys):
            used = self.keys != 0
            old, slots = (self.keys[used], self.places[used]), len(self.keys)
            while 2 * (self.size + len(hashes)) > slots:
                slots *= 2
            self.__init__(slots)
            self.add(*old)
        hashes = np.maximum(hashes, 1)
        self.size += len(hashes)
        slots = self._next(hashes)
        while len(hashes):
            free = np.flatnonzero(self.keys[slots] == 0)
            _, first = np.unique(slots[free], return_index=True)  # one hash for each free slot; the others try the next
            taken = free[first]
            self.keys[slots[taken]], self.places[slots[taken]] = hashes[taken], places[taken]
            left = np.ones(len(hashes), bool)
            left[taken] = False
            hashes, places, slots = hashes[left], places[left], self._next(hashes, slots[left])


#: How byte-level vocabularies write a byte: itself where it prints, else one of the characters from 256 on.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARACTERS = {b: chr(b) for b in (*_PRINTS, 32)} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS))) if b != 32}


class WordTokens:
    """Token ids of white-space separated words, each tokenised once.

    The vocabulary's pattern never crosses white space, so a text's ids are those of
    its words one after another; and a word that ends with ASCII punctuation after an
    ASCII letter or digit is its two parts. Known words are found by 64-bit hashes; at
    ``limit`` words all is forgotten.
    """

    _tail, _before_tail = b".,!%&#$*|?;:", frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # for words that need neither normalising nor splitting
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.limit, self.hasher = limit, WordHasher(0x9FB21C651E98DF25)
        self._forget()

    def _forget(self) -> None:
        self.places = HashPlaces()
        self.known = self.used = 0
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self._keep(np.zeros(0, np.uint64), np.array([EOS], np.uint32), np.ones(1, np.int32))  # place 0 ends a text

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add new words, their ids one after another."""
        k, n = self.known, len(lengths)
        while k + n > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.starts[k : k + n], self.lengths[k : k + n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.flat[self.used : self.used + len(ids)] = ids
        if len(hashes):
            self.places.add(hashes, np.arange(k, k + n, dtype=np.int32))
        self.known, self.used = k + n, self.used + len(ids)

    def _joined(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and where each word's end."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths, dtype=np.int64)
        return self.flat[np.repeat(self.starts[places] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends

    @staticmethod
    def _is_plain(word: bytes) -> bool:
        """Lower-case letters only, so that the word is one token of the pattern."""
        if word.isascii():
            return word.isalpha() and word.islower()
        text = word.decode("utf-8", "replace")
        return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def _tokenise(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Learn words that are new and all different."""
        is_plain = np.fromiter(map(self._is_plain, words), bool, len(words))
        plain, other = np.flatnonzero(is_plain).tolist(), np.flatnonzero(~is_plain).tolist()
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            written = b" ".join([words[i] for i in part]).decode("latin-1").translate(_BYTE_CHARACTERS).split(" ")
            ids = np.array(self.merges.encode_batch_fast([written], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                other += part
            else:
                self._keep(hashes[part], ids, np.diff(ends, prepend=0))
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            found = [x.ids for x in self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)]
            self._keep(hashes[part], np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Tokenise words that aren't known and all different."""
        whole, both, heads, tails = [], [], [], []
        for i, word in enumerate(words):
            head = word.rstrip(self._tail)
            if len(head) < len(word) and head and head[-1] in self._before_tail and b"<|" not in word:
                both.append(i)
                heads.append(head)
                tails.append(word[len(head) :])
            else:
                whole.append(i)
        self._tokenise([words[i] for i in whole], hashes[whole])
        if both:
            raw, of_parts, starts, ends, _ = self.hasher.located([b" ".join(heads), b" ".join(tails)])
            new, first = np.unique(of_parts, return_index=True)
            missing = self.places.find(new) < 0
            self._tokenise([raw[a:b] for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())], new[missing])
            pairs = self.places.find(of_parts).reshape(2, -1).T
            ids, _ = self._joined(pairs.ravel())
            self._keep(hashes[both], ids, self.lengths[pairs].sum(1))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by EOS, and how many each text has."""
        # Special tokens are found before lower-casing, which must not make new ones.
        raw, hashes, starts, ends, counts = self.hasher.located([x if not x or b"<|" in x else x.lower() for x in texts])
        places = self.places.find(hashes)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.known + 2 * len(new) > self.limit and self.known > 1:
                self._forget()
                new, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            at = missing[first]
            self.learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], new)
            places[missing] = self.places.find(hashes[missing])
        stops = np.cumsum(counts)
        ids, ends = self._joined(np.insert(places, stops, 0))
        return ids, np.diff(ends[stops + np.arange(len(texts))], prepend=0)


_TOKENS: dict[str, WordTokens] = {}


def _pieces(path: str, tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _TOKENS.get(path) or _TOKENS.setdefault(path, WordTokens(path))  # one for each Python worker
        for batch, texts in text_steps(batches, step_bytes=STEP_BYTES):
            ids, counts = encoder.encode(texts)
            doc, piece, start, length, crc = [], [], [], [], []
            at, raw = 0, memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            for row, n in enumerate(counts.tolist()):
                for k, first in enumerate(range(0, n, tokens)):
                    size = min(tokens, n - first)
                    doc.append(row)
                    piece.append(k)
                    start.append(first)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * (at + first) : 4 * (at + first + size)]))
                at += n
            docs = batch.column(0).take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


@dataclass(frozen=True)
class Capacities:
    """What a sequence can take. The defaults for documents and attention cost are met by any pieces of 4096 tokens in all."""

    tokens: int = SEQUENCE_TOKENS
    documents: int = SEQUENCE_TOKENS
    attention: int = SEQUENCE_TOKENS * SEQUENCE_TOKENS

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


def vector_best_fit(lengths: np.ndarray, capacities: Capacities, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the pieces must come longest first. Ties go to the bin opened first."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    full, w = capacities.vector(), np.array(weights)
    if len(lengths) and (lengths.max() > full[0] or full[1] < 1 or float(lengths.max()) ** 2 > full[2]):
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((64, 3))  # residuals of open bins, in the order of their opening
    number = np.empty(64, np.int64)
    opened = made = 0
    shortest = lengths.min() if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        best = -1
        if opened:
            live = left[:opened]
            fits = np.flatnonzero((live[:, 0] >= n) & (live[:, 1] >= 1) & (live[:, 2] >= need[2]))
            if len(fits):
                if rule == "norm":
                    rest = (live[fits] - need) / full
                    best = int(fits[np.argmin((rest * rest) @ w)])
                else:
                    best = int(fits[np.argmax((live[fits] / full) @ (w * need / full))])
        if best < 0:
            if opened == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            left[opened], number[opened] = full, made
            best, opened, made = opened, opened + 1, made + 1
        bins[i], offsets[i] = number[best], full[0] - left[best, 0]
        left[best] -= need
        if left[best, 0] < shortest or left[best, 1] < 1:  # nothing fits any more
            left[best : opened - 1], number[best : opened - 1] = left[best + 1 : opened].copy(), number[best + 1 : opened].copy()
            opened -= 1
    return bins, offsets


def _packed(capacities: Capacities, weights: tuple[float, float, float], rule: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole groups."""
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([("group", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        groups = table.column("group").to_numpy()
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)]):
            part = table.slice(first, last - first)
            bins, offsets = vector_best_fit(part.column("length").to_numpy(), capacities, weights, rule)
            ids = (int(groups[first]) << 32) + bins
            out = part.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
            yield from out.combine_chunks().to_batches()

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str | None = None, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. ``tokenizer``: a file that every executor can open."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer or default_tokenizer(), tokens), PIECE)


def pack(
    documents: DataFrame, tokenizer: str | None = None, capacities: Capacities = Capacities(), weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """The pieces with the sequence that each goes to and its offset there."""
    cut = materialise(pieces(documents, tokenizer, capacities.tokens), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.repartition(groups, "group").mapInArrow(_packed(capacities, weights, rule), PIECE + ", sequence_id long, offset long")
