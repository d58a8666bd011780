"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

A first pass over all documents counts how often each id occurs; ids are then ranked, the
most frequent first. A second pass deals documents by ranges of doc_id, and each task
writes the ranks of its documents' ids into one file, in order. A file is a sequence of
blocks: a header with the numbers of documents and ids and the sizes of what follows; the
doc_ids, which of them are null, and the number of ids of each; control bytes, two bits for
each id, that tell in how many bytes (1 to 4) its rank is written; and those bytes. A block
is decoded by looking control bytes up in a table of lengths, gathering the ranks at the
running sums of these, and looking ids up by rank.

Beside the files lie two tables, written by Spark: ``ranks`` (rank, id, occurrences; a row for
each id of the vocabulary) and ``blocks`` (which file holds which block where). A task names
its file anew each time that it runs, and only what a successful run reports is in
``blocks``: an executor that is lost leaves a file that nothing refers to.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; rows that
share a doc_id follow each other by the hash of their texts, then by their texts; bytes that
aren't UTF-8 count as U+FFFD; a special token's string in a text is that token, as
in the library; further columns are ignored; an empty table gives no block and an empty
result; a text of any length is one document in one block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.batches import WordHasher, mixed, text_steps
from tessera.llm.packing import _BYTE_CHARACTERS, HashPlaces
from tessera.plans.storage import new_folder

END = 0
#: Ids of one file, about.
FILE_IDS = 32_000_000
MAGIC, HEADER = b"TSRTOK1\n", struct.Struct("<QQQQ")
BLOCKS = "file_number int, block int, path string, offset long, size long, documents long, ids long"
#: White space beyond ASCII, as UTF-8, and how special tokens begin: a text that holds any of these bytes is tokenised as a whole.
APART = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"<|")
#: A word's end that is a part of its own after an ASCII letter or digit.
TAIL = b".,!%&#$*|?;:"

# ---- ids of texts ----------------------------------------------------------------------------


class ByteTokens:
    """Ids of texts by a byte-level vocabulary whose pattern puts one space before a word to the word.

    So a text's ids are those of its parts: words, each with the space before it if there
    is one, and what else stands between words. A word is tokenised by the library once
    and found again by a 64-bit hash; beyond ``limit`` words or ``most_ids`` of their ids,
    all is forgotten.
    """

    def __init__(self, path: str, end: int = END, limit: int = 2_500_000, most_ids: int = 40_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # for words that need no splitting
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.begins_with_space = np.zeros(self.size, bool)
        self.begins_with_space[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True  # how byte-level vocabularies write a space
        self.newline = self._encoded(["\n"])[0]
        self.end, self.limit, self.most_ids, self.hasher = end, limit, most_ids, WordHasher(0x9FB21C651E98DF25)
        self._forget()

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.places, self.between = HashPlaces(), {}  # words by hash; what else stands between or behind them by its bytes
        self.known = self.used = 0
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self._keep(np.array([self.end], np.uint32), np.ones(1, np.int64))  # place 0 ends a text

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Add parts, their ids one after another; their places."""
        k, n = self.known, len(lengths)
        while k + n > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.starts[k : k + n], self.lengths[k : k + n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.known, self.used = k + n, self.used + len(ids)
        return np.arange(k, k + n, dtype=np.int32)

    def _learn(self, words: list[bytes], hashes: np.ndarray, spaced: bool) -> None:
        """Tokenise new words; punctuation behind a word is a part of its own."""
        alone, heads, tails = [], [], []
        for i, word in enumerate(words):
            head = word.rstrip(TAIL)
            if len(head) < len(word) and head and chr(head[-1]).isalnum() and head[-1] < 128:
                heads.append(i)
                tails.append((head, self._piece(word[len(head) :])))
            else:
                alone.append(i)
        self._tokenise([words[i] for i in alone], hashes[alone], spaced)
        if not heads:
            return
        raw, found, starts, ends, _ = self.hasher.located([b" ".join([h for h, _ in tails])])
        found = self._as_spaced(found, np.full(len(found), spaced))
        new, first = np.unique(found, return_index=True)
        missing = self.places.find(new) < 0
        self._tokenise([raw[a:b] for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())], new[missing], spaced)
        pairs = np.column_stack([self.places.find(found), [t for _, t in tails]]).ravel()
        ids, _ = self._joined(pairs)
        self.places.add(hashes[heads], self._keep(ids, self.lengths[pairs].reshape(-1, 2).sum(1)))

    def _tokenise(self, words: list[bytes], hashes: np.ndarray, spaced: bool) -> None:
        """Many in one call where their ends can be told from the ids."""
        letters = np.array([w.isalpha() if w.isascii() else w.decode("utf-8", "replace").isalpha() for w in words], bool) if spaced else np.zeros(len(words), bool)
        for plain in (True, False):
            mine = np.flatnonzero(letters == plain).tolist()
            for at in range(0, len(mine), 1000):
                part = mine[at : at + 1000]
                if plain:
                    written = ("Ġ" + b" ".join([words[i] for i in part]).decode("latin-1").translate(_BYTE_CHARACTERS).replace(" ", " Ġ")).split(" ")
                    ids = np.array(self.merges.encode_batch_fast([written], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
                    firsts = np.flatnonzero(self.begins_with_space[ids])
                else:
                    text = [words[i].decode("utf-8", "replace") for i in part]
                    ids = self._encoded([" " + " ".join(text) if spaced else "\n".join(text)])[0]
                    if spaced:
                        firsts = np.flatnonzero(self.begins_with_space[ids])
                    else:
                        breaks = np.flatnonzero(ids == self.newline) if len(self.newline) == 1 else np.zeros(0, np.int64)
                        ids = np.delete(ids, breaks)
                        firsts = np.append(0, breaks - np.arange(len(breaks)))
                lengths = np.diff(np.append(firsts, len(ids)))
                if len(firsts) != len(part) or firsts[0] or not lengths.all():
                    found = self._encoded([(" " if spaced else "") + words[i].decode("utf-8", "replace") for i in part])
                    ids, lengths = np.concatenate(found), np.array([len(x) for x in found])
                self.places.add(hashes[part], self._keep(ids, lengths))

    @staticmethod
    def _as_spaced(hashes: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        return np.where(spaced, mixed(hashes + np.uint64(0x51ED270B)), hashes)

    def _joined(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts one after another, and where each part's end."""
        lengths = self.lengths[places]
        until = np.cumsum(lengths, dtype=np.int64)
        return self.flat[np.repeat(self.starts[places] - (until - lengths), lengths) + np.arange(until[-1] if len(until) else 0)], until

    def _piece(self, raw: bytes) -> int:
        """The place of white space or punctuation that stands alone."""
        place = self.between.get(raw)
        if place is None:
            (ids,) = self._encoded([raw.decode()])
            place = self.between[raw] = int(self._keep(ids, np.array([len(ids)]))[0])
        return place

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by the end id, and how many each text has."""
        whole = self._apart(texts)
        apart = set(whole)
        places, ending = self._places([None if t in apart else x for t, x in enumerate(texts)])
        ids, until = self._joined(places)
        counts = np.diff(until[ending], prepend=0)
        if not whole:
            return ids, counts
        starts = (np.cumsum(counts) - counts)[whole]
        found = [x for t in whole for x in self._encoded([texts[t].decode("utf-8", "replace")])]
        sizes = np.array([len(x) for x in found])
        counts[whole] += sizes
        return np.insert(ids, np.repeat(starts, sizes), np.concatenate(found)), counts

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        """How often each id is in :meth:`encode` of the texts: each part's ids are looked at once, however often it occurs."""
        whole = self._apart(texts)
        apart = set(whole)
        places, _ = self._places([None if t in apart else x for t, x in enumerate(texts)])
        occurrences = np.bincount(places, minlength=self.known)
        used = np.flatnonzero(occurrences)
        ids, _ = self._joined(used)
        total = np.bincount(ids, np.repeat(occurrences[used], self.lengths[used]), self.size).astype(np.int64)
        for t in whole:
            total += np.bincount(self._encoded([texts[t].decode("utf-8", "replace")])[0], minlength=self.size)
        return total

    @staticmethod
    def _apart(texts: list[bytes | None]) -> list[int]:
        """The texts that are tokenised as a whole. Most steps lack the rarest byte of most of APART."""
        everything = b" ".join([x or b"" for x in texts])
        sought = [x for x in APART if (x[:1] if x[0] > 127 else x[-1:]) in everything and x in everything]
        return [t for t, x in enumerate(texts) if x and any(y in x for y in sought)] if sought else []

    def _places(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all parts one after another, and where in them each text ends."""
        raw, hashes, starts, ends, counts = self.hasher.located(texts)
        octets = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(x or b"") for x in texts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        stops = np.cumsum(counts)
        first = np.flatnonzero(counts)  # texts with a word
        before = np.append(0, ends[:-1])[: len(starts)]
        before[stops[first] - counts[first]] = begins[first]
        spaced = (starts > before) & (octets[starts - 1] == 32)
        hashes = self._as_spaced(hashes, spaced)
        if self.known + len(hashes) > self.limit or self.used > self.most_ids:
            new = np.count_nonzero(self.places.find(np.unique(hashes)) < 0)
            if self.known > 1 and (self.known + new > self.limit or self.used > self.most_ids):
                self._forget()
        places = self.places.find(hashes)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            for flag in (False, True):
                mine = np.flatnonzero(spaced[at] == flag)
                self._learn([raw[a:b] for a, b in zip(starts[at[mine]].tolist(), ends[at[mine]].tolist())], new[mine], flag)
            places[missing] = self.places.find(hashes[missing])
        # White space before a word, but for a space that belongs to it: all but its last character, and that one.
        rest = starts - before - spaced
        odd = np.flatnonzero(rest > 0)
        pieces = [[], [], [], []]  # before which word, of which text, in which order, place
        text_of = np.repeat(np.arange(len(texts)), counts)[odd]
        for i, t, a, n, s in zip(odd.tolist(), text_of.tolist(), before[odd].tolist(), rest[odd].tolist(), spaced[odd].tolist()):
            for x in (raw[a : a + n],) if s or n == 1 else (raw[a : a + n - 1], raw[a + n - 1 : a + n]):
                for column, value in zip(pieces, (i, t, 0, self._piece(x))):
                    column.append(value)
        last = begins.copy()
        last[first] = ends[stops[first] - 1]
        for t in np.flatnonzero(begins + sizes > last).tolist():
            for column, value in zip(pieces, (int(stops[t]), t, 1, self._piece(raw[last[t] : begins[t] + sizes[t]]))):
                column.append(value)
        where, text, order, place = [np.concatenate([np.array(c, np.int64), x]) for c, x in zip(pieces, (stops, np.arange(len(texts)), np.full(len(texts), 2), np.zeros(len(texts), np.int64)))]
        by = np.lexsort((order, text, where))  # stable: two pieces before one word keep their order
        everything = np.insert(places.astype(np.int64), where[by], place[by])
        ending = np.flatnonzero(order[by] == 2)
        return everything, where[by][ending] + ending


_TOKENS: dict[str, ByteTokens] = {}


def _tokens(path: str) -> ByteTokens:
    return _TOKENS.get(path) or _TOKENS.setdefault(path, ByteTokens(path))  # one for each Python worker


# ---- the coding ------------------------------------------------------------------------------

_FOUR = np.arange(4)
#: Lengths of the four numbers that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> (2 * _FOUR)) & 3).astype(np.uint8) + np.uint8(1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    codes = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    data = numbers.view(np.uint8).reshape(-1, 4)[_FOUR <= codes[:, None]]
    codes = np.append(codes, np.zeros(-len(codes) % 4, np.uint8)).reshape(-1, 4)
    return (codes << (2 * _FOUR)).sum(1).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    if len(lengths) != n or (ends[-1] if n else 0) != len(data):
        raise ValueError("control bytes and data don't belong together")
    octets = np.frombuffer(data + bytes(3), np.uint8)
    words = np.lib.stride_tricks.as_strided(octets[:4].view("<u4"), (max(len(octets) - 3, 0),), (1,)) if n else np.zeros(0, "<u4")
    return words[ends - lengths] & _MASKS[lengths]


def block(doc_ids: pa.Array, counts: np.ndarray, numbers: np.ndarray) -> bytes:
    control, data = pack(numbers)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    return HEADER.pack(len(ids), len(numbers), len(control), len(data)) + ids.tobytes() + nulls.tobytes() + counts.astype("<i8").tobytes() + control + data


def read_block(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, the number of ids of each, and the numbers."""
    documents, n, control, data = HEADER.unpack_from(raw)
    at = HEADER.size
    ids = np.frombuffer(raw, "<i8", documents, at)
    nulls = np.frombuffer(raw, np.uint8, documents, at + 8 * documents).astype(bool)
    counts = np.frombuffer(raw, "<i8", documents, at + 9 * documents)
    at += 17 * documents
    return pa.array(ids, mask=nulls), counts, unpack(raw[at : at + control], raw[at + control : at + control + data], n)


# ---- writing ---------------------------------------------------------------------------------


def _counted(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = _tokens(path), None
        for _, texts in text_steps(batches):
            found = tokens.count(texts)
            total = found if total is None else total + found
        if total is not None:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "occurrences"])

    return run


def id_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """id and occurrences over all documents, their end ids included."""
    counted = documents.select(F.col("text").cast("string")).mapInArrow(_counted(tokenizer), "id int, occurrences long")
    return counted.groupBy("id").agg(F.sum("occurrences").alias("occurrences"))


def _written(path: str, folder: str, sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank_of = _tokens(path), sent.value
        number = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name, out, offset, rows = f"{root}/ids-{number:08d}-{uuid.uuid4().hex}.tok", None, 0, []
        for batch, texts in text_steps(batches):
            if out is None:
                out = store.open_output_stream(name)
                out.write(MAGIC)
                offset = len(MAGIC)
            ids, counts = tokens.encode(texts)
            raw = block(batch.column(0), counts, rank_of[ids])
            out.write(raw)
            rows.append((number, len(rows), name.rpartition("/")[2], offset, len(raw), len(counts), len(ids)))
            offset += len(raw)
        if out is not None:
            out.close()
            types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file_number", "block", "path", "offset", "size", "documents", "ids"])

    return run


def write(documents: DataFrame, folder: str, tokenizer: str, file_ids: int = FILE_IDS) -> None:
    """Write all documents into ``folder`` (a URI that every executor can open by pyarrow), in ascending order of doc_id."""
    spark = documents.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    found = {r["id"]: r["occurrences"] for r in id_counts(documents, tokenizer).collect()}  # at most a row for each id of the vocabulary
    occurrences = np.zeros(_tokens(tokenizer).size, np.int64)
    occurrences[list(found)] = list(found.values())
    id_of = np.argsort(-occurrences, kind="stable")
    rank_of = np.empty(len(id_of), np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    ranks = pa.table({"rank": np.arange(len(id_of)), "id": id_of, "occurrences": occurrences[id_of]})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{folder}/ranks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(occurrences.sum()) // file_ids))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    dealt.mapInArrow(_written(tokenizer, folder, spark.sparkContext.broadcast(rank_of)), BLOCKS).write.parquet(f"{folder}/blocks")


# ---- reading ---------------------------------------------------------------------------------


def _decoded(folder: str, sent, as_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, offset, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{root}/{path}") as file:
                    doc_ids, counts, numbers = read_block(file.read_at(size, offset))
                ids = np.ascontiguousarray(sent.value[numbers], "<u4")
                ends = np.cumsum(counts)
                columns = [doc_ids, pa.array(start + ends - counts), pa.array(counts)]
                if as_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                else:
                    raw = memoryview(ids.tobytes())
                    columns.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids" if as_ids else "ids_crc32"])

    return run


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """path, offset, size of every block, and the number of ids before it: within its file, and in the files before that (one row for each file)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    files = blocks.groupBy("file_number").agg(F.sum("ids").alias("all"))
    before = files.select("file_number", (F.sum("all").over(Window.orderBy("file_number")) - F.col("all")).alias("before"))
    within = F.sum("ids").over(Window.partitionBy("file_number").orderBy("block")) - F.col("ids")
    return blocks.withColumn("within", within).join(before, "file_number").select("path", "offset", "size", (F.col("before") + F.col("within")).alias("start"))


def _read(spark: SparkSession, folder: str, as_ids: bool, schema: str) -> DataFrame:
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").toArrow()  # a row for each id of the vocabulary
    sent = spark.sparkContext.broadcast(ranks.column("id").to_numpy().astype(np.uint32))
    dealt = _located(spark, folder).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset")
    return dealt.mapInArrow(_decoded(folder, sent, as_ids), schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in ``folder``."""
    return _read(spark, folder, True, "doc_id long, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`read`, with the CRC of the ids (as little-endian 32-bit integers) in their place."""
    return _read(spark, folder, False, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents into a folder of this application and read the files back."""
    folder = new_folder(documents.sparkSession, "tokens")
    write(documents, folder, tokenizer or default_tokenizer())
    return digests(documents.sparkSession, folder)
