"""Exact dedup over a cuckoo-filter index of live digests.

Texts are lower-cased (A-Z only) and hashed with SHA-256. Each task keeps a
:class:`CuckooIndex` of the digests that it has met; what it holds at its end, one
record for each different digest, is dealt out by digest, and an index in each
partition merges the records of all tasks. So a text that fills a third of all
rows sends one record from each task.

Defined cases: a null text counts as empty; a null doc_id sorts below every
other; rows that repeat a doc_id with the same text all count in ``group_size``
and are kept or dropped together; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.skew import join_unique
from tessera.plans.storage import materialise

SLOTS = 4
MAX_KICKS = 64
#: Records that an index in a task holds before it hands them on; and records for each partition of the merge.
TASK_RECORDS = 200_000
MERGE_RECORDS = 200_000


class CuckooIndex:
    """A cuckoo filter whose slots carry the record behind each fingerprint.

    ``find`` looks at the two buckets of a digest: a slot whose 16-bit fingerprint
    differs is a sure miss, a hit is verified against the digest stored in that
    bucket. Records can be inserted and deleted; an insertion that finds no room
    within ``MAX_KICKS`` moves doubles the buckets and re-inserts the stored keys.
    """

    def __init__(self, buckets: int = 1024):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of 2")
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.records: list[tuple | None] = [None] * (buckets * SLOTS)
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.records[slot][0] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> tuple | None:
        """The record (digest, doc_id, count) of a live digest, or None."""
        slot = self._slot(digest)
        return None if slot < 0 else self.records[slot]

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.prints[slot], self.records[slot] = 0, None
        self.size -= 1
        return True

    def insert(self, record: tuple) -> None:
        """Insert a record whose digest isn't live."""
        while (record := self._placed(record)) is not None:
            self._grow()
        self.size += 1

    def _placed(self, record: tuple) -> tuple | None:
        """None if the record, and all that it moved, found a place; else the record left over."""
        mark, first, second = self._places(record[0])
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.records[slot] = mark, record
                    return None
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            record, self.records[slot] = self.records[slot], record
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.records[slot] = mark, record
                    return None
        return record

    def _grow(self) -> None:
        stored, buckets = [x for x in self.records if x is not None], (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._placed(x) is None for x in stored):
                self.size = len(stored)
                return
            buckets *= 2

    def merge(self, digest: bytes, doc_id: int | None, count: int) -> None:
        """Add ``count`` rows of a text; the live record moves to the largest doc_id."""
        slot = self._slot(digest)
        if slot < 0:
            self.insert((digest, doc_id, count))
            return
        _, live, n = self.records[slot]
        if doc_id is not None and (live is None or doc_id > live):
            self.delete(digest)
            self.insert((digest, doc_id, n + count))
        else:
            self.records[slot] = (digest, live, n + count)

    def live(self) -> list[tuple]:
        return [x for x in self.records if x is not None]


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        found = [hashlib.sha256((x or b"").lower()).digest() for x in texts]  # bytes.lower() is A-Z only
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])


def _indexed(records: Iterable[tuple[bytes, int | None, int]], limit: int) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for record in records:
        index.merge(*record)
        if len(index) >= limit:
            yield _batch(index.live())
            index = CuckooIndex()
    if len(index):
        yield _batch(index.live())


def _batch(live: list[tuple]) -> pa.RecordBatch:
    digest, doc, n = zip(*live)
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64())], ["digest", "keep_id", "group_size"])


def _task_index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((digest, doc, 1) for b in batches for doc, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    yield from _indexed(rows, TASK_RECORDS)


def _merged_index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All records of a digest are in one partition, so nothing is handed on before the end."""
    index = CuckooIndex()
    for b in batches:
        for record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            index.merge(*record)
    live = index.live()
    for start in range(0, len(live), 10_000):
        yield _batch(live[start : start + 10_000])


RECORD = "digest binary, keep_id long, group_size long"


def text_digests(documents: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text, written as an intermediate table."""
    return materialise(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests, "doc_id long, digest binary"), "digests")


def digest_groups(digests: DataFrame) -> DataFrame:
    """One row for each different digest: digest, keep_id (largest doc_id), group_size."""
    spark = digests.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // MERGE_RECORDS))
    return digests.mapInArrow(_task_index, RECORD).repartition(parts, "digest").mapInArrow(_merged_index, RECORD)


def exact_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``documents``."""
    digests = text_digests(documents)
    return join_unique(digests, materialise(digest_groups(digests), "groups"), "digest", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, one of each text, columns unchanged.

    Ids tell rows apart where an id has one text; only ids of which a row stays beside
    another row are looked up by the digest of each row.
    """
    digests = text_digests(documents)
    groups = materialise(digest_groups(digests), "groups")
    joined = join_unique(digests, groups, "digest", "group_size").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    dropped = joined.filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    doc_id = documents["doc_id"].cast("long")
    kept = documents.join(dropped, doc_id.eqNullSafe(F.col("_dropped")), "left_anti")
    shared = joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept")).filter("n > 1 and n_kept > 0").select(F.col("doc_id").alias("_shared"))
    if shared.isEmpty():
        return kept
    same = doc_id.eqNullSafe(F.col("_shared"))
    stay = joined.filter("kept").select(F.col("doc_id").alias("_stays"), F.lower(F.hex("digest")).alias("_text")).distinct()
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    rows = documents.join(shared, same, "left_semi").withColumn("_digest", F.sha2(lowered, 256))
    met = rows.join(stay, (F.col("_digest") == F.col("_text")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_stays")), "left_semi")
    return kept.join(shared, same, "left_anti").unionByName(met.dropDuplicates(["doc_id", "_digest"]).drop("_digest"))
