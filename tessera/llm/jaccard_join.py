"""N-gram Jaccard join over signature trees.

Two documents link when the Jaccard similarity of their word-shingle sets reaches
a threshold; the result is the connected components of all links.

1. Equal sets are one: the document with the smallest id stands for them.
2. Candidates. Sets of nearly equal size that link differ in at most h shingles.
   The hash space is cut into more than h segments, so one segment, at least,
   holds the same shingles in both sets. Documents that share the content of a
   segment are candidates, and so are those connected through others. Frequent
   shingles are left out of the segments, which can't make two sets differ in more
   segments; so a passage that many texts share makes no candidates. Sets that
   have too little besides frequent shingles are cut with them a second time.
3. Signature trees. The documents of a candidate class, in blocks of bounded
   size, form a tree whose nodes hold OR-combined token bitmaps and size ranges.
   A dual traversal drops every pair of nodes whose largest possible overlap is
   too small; what is left at the leaves is compared exactly.
4. A class that fills several blocks is first joined within them, then the
   representatives of the clusters found are joined. Of a class that still holds
   several clusters, those stay together that have as many segments in common as
   linked sets must have; one is enough for a candidate, but two linked sets share
   most of theirs. Of what is left, only blocks meet in which different clusters have
   a segment's content in common. Members of one cluster are never expanded into pairs.

Shingles are 64-bit hashes. Defined cases: texts without words have an empty set
and link with nothing; texts with fewer words than a shingle have the whole
sequence as their one; rows that share a doc_id count as one document; a row
without doc_id takes no part, and its component is null; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import WordHasher, mixed, run_hashes, text_steps
from tessera.llm.components import components
from tessera.llm.skew import join_unique
from tessera.plans.storage import materialise, release

SHINGLE, PERCENT = 5, 80
#: Bounds of a block of a class: shingles and documents.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 400_000, 2000
FAN_OUT = 8
#: A shingle is frequent from so many different sets in a step of a task, and so many in all; at most so many count as frequent.
OFTEN_IN_STEP, OFTEN, MOST_FREQUENT = 2, 12, 1 << 19
#: Shingles that a step of a task counts, keys that it holds before it hands them on, and keys that one range of the hash space holds, about. The last two bound a worker's memory, which a key takes some ten times over while it is sorted.
STEP_ENTRIES, FLUSH_ENTRIES, RANGE_ENTRIES = 3_000_000, 500_000, 1_000_000
#: Bytes of text that a step of a task makes sets of; the arrays of their words take some ten times as much.
STEP_BYTES = 1 << 20
#: Clusters of a class that are counted in pairs where they share a segment's content; where more do, they aren't.
MET_CLUSTERS = 256
#: Ranges that one task sorts, one after another, and documents that it holds as connected before it hands them on.
TASK_RANGES, HELD_NODES = 16, 500_000
BAND_RATIO = 1.5

_HASHES = WordHasher(0xE7037ED1A0B428DB)


def shingle_sets(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = _HASHES.of([x.lower() if x else x for x in texts])
    runs = run_hashes(hashes, shingle)
    start = 0
    for n in counts.tolist():
        if n >= shingle:
            found = np.sort(runs[start : start + n - shingle + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        else:
            yield mixed(run_hashes(hashes[start : start + n], n) + np.uint64(n)) if n else runs[:0]
        start += n


class Segments:
    """How a set is cut. Sizes fall into bands; a pair of linked sets lies in one band or in two neighbours.

    A set takes part on the level of its own band, and on the next if a set there is
    small enough to link with it. On each level all
    sets are cut into the same number of segments of equal hash range: more than the
    shingles in which two linked sets of that level can differ, and as many again as
    segments are likely to be empty.

    ``frequent`` shingles are left out at first. If all segments that two linked sets
    have in common are empty, each set has more empty ones than the pigeonhole spares;
    such sets are cut again with all their shingles, and if that leaves them too many
    empty segments as well, their places count as contents. So no link is lost,
    whatever is called frequent.
    """

    def __init__(self, percent: int, frequent: np.ndarray | None = None):
        if not 50 <= percent <= 100:
            raise ValueError("percent must lie between 50 and 100")
        self.percent = percent
        self.frequent = np.zeros(0, np.uint64) if frequent is None else frequent
        self.bounds = [1]
        self.levels: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
        if BAND_RATIO * percent < 100:
            self.ratio = 100 / percent + 0.1
        else:
            self.ratio = BAND_RATIO

    def band(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.ratio)))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def level(self, j: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Segments, the most differences, the first hash of each segment, and a salt for each segment."""
        if j not in self.levels:
            while len(self.bounds) < j + 2:
                self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.ratio)))
            most = 2 * (self.bounds[j + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            least, k = max(1, -(-self.bounds[j] * self.percent // 100)), most + 1
            for _ in range(30 if most else 0):
                empty = k * math.exp(-least / k)
                k = min(3 * (most + 1), most + 1 + math.ceil(empty + 3 * math.sqrt(empty)))
            firsts = np.array([(i << 64) // k for i in range(k)], np.uint64)
            salts = mixed(np.arange(k, dtype=np.uint64) + np.uint64((j + 1) << 32))
            self.levels[j] = k, most, firsts, salts
        return self.levels[j]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of the contents of the set's segments."""
        return np.concatenate([keys for _, keys, _ in self.by_level(shingles)]) if len(shingles) else shingles

    def by_level(self, shingles: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
        """Of a set that isn't empty each level with its keys and with how many of them a linked set of that level has, unless that needs fewer itself.

        Linked sets differ in no more segments than in shingles; so of the full segments
        that are enough for a set, all but the most differences are those of the other.
        """
        rare = shingles
        if len(self.frequent):
            at = np.searchsorted(self.frequent, shingles)
            rare = shingles[self.frequent[np.minimum(at, len(self.frequent) - 1)] != shingles]
        band = self.band(len(shingles))
        return [(j, *self._cut(j, rare, shingles)) for j in ((band, band + 1) if len(shingles) * 100 >= self.bounds[band + 1] * self.percent else (band,))]

    def _cut(self, j: int, rare: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        k, most, firsts, salts = self.level(j)

        def contents(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s)])
            cuts = np.append(np.searchsorted(s, firsts), len(s))
            return sums[cuts[1:]] - sums[cuts[:-1]], cuts[1:] > cuts[:-1]

        content, full = contents(rare)
        first = mixed(content[full] ^ salts[full])
        if len(first) > most:
            return first, len(first) - most
        content, full = contents(shingles)
        again = ~salts
        if int(full.sum()) > most:
            content, again = content[full], again[full]
        return np.concatenate([first, mixed(content ^ again)]), len(content) - most


def _top(above: dict[int, int], x: int) -> int:
    root = x
    while (up := above.get(root, root)) != root:
        root = up
    while (up := above.get(x, x)) != root:
        above[x], x = root, up
    return root


def _connect(above: dict[int, int], a: Iterable[int], b: Iterable[int]) -> None:
    """Add edges to a forest, in which ``above`` leads from each node that smaller ones are connected with to such a one."""
    for x, y in zip(a, b):
        p, q = _top(above, x), _top(above, y)
        if p != q:
            above[max(p, q)] = min(p, q)


def stars(a: Iterable[int], b: Iterable[int]) -> tuple[list[int], list[int]]:
    """An edge from each node that (a, b) connect with smaller ones to the smallest of them."""
    above: dict[int, int] = {}
    _connect(above, a, b)
    return list(above), [_top(above, x) for x in above]


def _bucket_edges(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With entries in the order of keys: the first id of each key's entries with each further one; and the places of first entries."""
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    lead = np.repeat(ids[firsts], np.diff(np.append(firsts, len(keys))))
    pairs = np.stack([lead[~new], ids[~new]], axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0], pairs[:, 1], firsts


CANDIDATES = "hash_range int, keys binary, places binary, ids binary, u long, v long, homes binary"


def _candidate_blocks(ranges: int, shingle: int, percent: int, frequent):
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(found), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[start : start + 5000]), types)], ["hash_range", "keys", "places", "ids", "u", "v", "homes"])

    def flush(keys: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        """A key goes out once, with the first document that has it; the task links the others to that one itself."""
        every = np.concatenate(keys)
        place = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        every, place, known = every[order], place[order], np.array(ids, np.int64)
        homes = np.array([k.min() for k in keys], np.uint64)
        a, b, firsts = _bucket_edges(every, known[place])
        yield from rows([(-1 - x % ranges, None, None, None, x, y, None) for x, y in zip(*stars(a.tolist(), b.tolist()))])
        every, place = every[firsts], place[firsts]
        where = ((every >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(where, np.arange(ranges + 1))
        out = []
        for r in range(ranges):
            if cuts[r] < cuts[r + 1]:
                some, index = np.unique(place[cuts[r] : cuts[r + 1]], return_inverse=True)
                out.append((r, every[cuts[r] : cuts[r + 1]].tobytes(), index.astype("<u2" if len(some) <= 1 << 16 else "<u4").tobytes(), known[some].tobytes(), None, None, homes[some].tobytes()))
        for start in range(0, len(out), 64):
            yield from rows(out[start : start + 64])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, keys, ids, entries = Segments(percent, frequent.value), [], [], 0
        for batch, texts in text_steps(batches, step_bytes=STEP_BYTES):
            for doc, shingles in zip(batch.column(0).to_pylist(), shingle_sets(texts, shingle)):
                if doc is not None and len(shingles):
                    keys.append(segments.keys(shingles))
                    ids.append(doc)
                    entries += len(keys[-1])
            if entries >= FLUSH_ENTRIES:
                yield from flush(keys, ids)
                keys, ids, entries = [], [], 0
        if keys:
            yield from flush(keys, ids)

    return run


def _unconnected(keys: np.ndarray, ids: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of keys, without those that another key connects already: see :func:`_range_edges`."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    order = order[np.append(same, False) | np.append(False, same)]  # most keys occur once
    order = order[np.lexsort((ids[order], homes[order], keys[order]))]
    keys, ids, homes = keys[order], ids[order], homes[order]
    again = (keys[1:] == keys[:-1]) & (homes[1:] == homes[:-1]) & (homes[1:] != keys[1:])
    kept = np.append(True, ~again)[: len(keys)]
    return keys[kept], ids[kept]


def _range_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in the order of ranges: one range after another is sorted, and what they connect is handed on once for all of them.

    A document's home is its smallest key. Documents with the same home are connected
    by that key, so of those that meet at a larger key one takes part. Else copies
    would be an edge of every task, as they share most of their keys. By induction
    from the smallest key on, all documents that hold a key stay connected. Rows
    without homes link all entries.
    """
    above: dict[int, int] = {}
    left: list[int] = []
    right: list[int] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    current = None

    def close() -> None:
        if held:
            every = [np.concatenate(column) for column in zip(*held)]
            held.clear()
            a, b, _ = _bucket_edges(*_unconnected(*every))
            _connect(above, a.tolist(), b.tolist())

    def found() -> Iterator[pa.RecordBatch]:
        a, b = list(above), [_top(above, x) for x in above]
        for start in range(0, len(a), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[start : start + 10_000], pa.int64()), pa.array(b[start : start + 10_000], pa.int64())], ["u", "v"])
        above.clear()

    for batch in batches:
        ranges, keys, places, ids, u, v, *homes = batch.columns
        for i, r in enumerate(ranges.to_pylist()):
            if r < 0:
                left.append(u[i].as_py())
                right.append(v[i].as_py())
                continue
            if r != current:
                close()
                current = r
                if len(above) > HELD_NODES:
                    yield from found()
            known = np.frombuffer(ids[i].as_buffer(), "<i8")
            key, place = np.frombuffer(keys[i].as_buffer(), "<u8").copy(), np.frombuffer(places[i].as_buffer(), "<u2" if len(known) <= 1 << 16 else "<u4")
            held.append((key, known[place], np.frombuffer(homes[0][i].as_buffer(), "<u8")[place] if homes else key))
        _connect(above, left, right)
        left.clear(), right.clear()
    close()
    yield from found()


class SignatureTree:
    """Nodes from the leaves up; each level halves nothing but joins ``FAN_OUT`` neighbours.

    A bitmap has a bit for every shingle that occurs twice or more in the block; no
    other can be shared. So the overlap of two documents is the number of common
    bits, and that of the OR-combined bitmaps of two nodes bounds the overlap of any
    two documents below them.
    """

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        tokens, counts = np.unique(every, return_counts=True)
        shared = tokens[counts > 1]
        width = max(1, -(-len(shared) // 64))
        bits = np.zeros((len(sets), width), np.uint64)
        for i, s in enumerate(sets):
            at = np.searchsorted(shared, s)
            at = at[(at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == s)] if len(shared) else at[:0]
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        sizes = np.array([len(s) for s in sets], np.int64)
        self.levels = [(bits, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            below, least, most = self.levels[-1]
            starts = np.arange(0, len(below), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(below, starts, axis=0), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether documents below the nodes x and y may link; at level 0, whether they do."""
        bits, least, most = self.levels[level]
        fits = (most[x] * 100 >= least[y] * percent) & (most[y] * 100 >= least[x] * percent)
        at = np.flatnonzero(fits)
        step = max(1, (8 << 20) // (8 * bits.shape[1]))
        for start in range(0, len(at), step):
            some = at[start : start + step]
            overlap = np.bitwise_count(bits[x[some]] & bits[y[some]]).sum(1, dtype=np.int64)
            fits[some] = overlap * (100 + percent) >= percent * (least[x[some]] + least[y[some]])
        return fits

    def links(self, percent: int, cluster: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that join different clusters, none of which the links before it had joined."""
        above = np.unique(cluster, return_inverse=True)[1]  # a cluster's own number; each row points to a row above it or itself
        first = {}
        above = np.array([first.setdefault(c, i) for i, c in enumerate(above.tolist())])

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, x, y = todo.pop()
            if level == 0:
                while (up := above[above]).tolist() != above.tolist():
                    above[:] = up
                apart = above[x] != above[y]
                x, y = x[apart], y[apart]
            keep = self.possible(level, x, y, percent)
            x, y = x[keep], y[keep]
            if level == 0:
                for i, j in zip(x.tolist(), y.tolist()):
                    p, q = top(i), top(j)
                    if p != q:
                        above[max(p, q)] = min(p, q)
                        yield i, j
                continue
            n = len(self.levels[level - 1][0])
            child = np.arange(FAN_OUT)
            a = (x[:, None, None] * FAN_OUT + child[None, :, None] + np.zeros((1, 1, FAN_OUT), np.int64)).ravel()
            b = (y[:, None, None] * FAN_OUT + child[None, None, :] + np.zeros((1, FAN_OUT, 1), np.int64)).ravel()
            ok = (a < n) & (b < n) & ((a < b) | ((a == b) & (level > 1)))
            a, b = a[ok], b[ok]
            for start in range(0, len(a), 1 << 14):
                todo.append((level - 1, a[start : start + (1 << 14)], b[start : start + (1 << 14)]))


def _tree_links(shingle: int, percent: int):
    """For applyInArrow over a block: stars of the clusters that its links join."""

    def run(table: pa.Table) -> pa.Table:
        docs, texts = table.column("doc").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist()
        cluster = np.array(table.column("cluster").to_pylist(), np.int64)
        sets = list(shingle_sets(texts, shingle))
        order = sorted(range(len(docs)), key=lambda i: (int(sets[i][0]) if len(sets[i]) else 0, len(sets[i]), docs[i]))  # near copies tend to share their smallest shingle
        found = list(SignatureTree([sets[i] for i in order]).links(percent, cluster[order])) if len(docs) > 1 else []
        owner = cluster[order].tolist()
        u, v = stars([owner[i] for i, _ in found], [owner[j] for _, j in found])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _set_rows(shingle: int):
    """A row (kind 0) for each document, and one (kind 1) for each shingle that several different sets of a step of the task hold."""
    names = ["kind", "doc_id", "n_shingles", "set_a", "set_b"]

    def often(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        found, counts = found[counts >= OFTEN_IN_STEP], counts[counts >= OFTEN_IN_STEP]
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), none, pa.array(counts.astype(np.int64)), pa.array(found.view(np.int64)), none], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch, texts in text_steps(batches, step_bytes=STEP_BYTES):
            sizes, a, b = [], [], []
            for s in shingle_sets(texts, shingle):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(len(s))
                a.append(int.from_bytes(digest[:8], "little", signed=True))
                b.append(int.from_bytes(digest[8:], "little", signed=True))
                if a[-1] not in held and len(s):
                    held[a[-1]] = s
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)
            if size >= STEP_ENTRIES:
                yield often(held)
                held, size = {}, 0
        if held:
            yield often(held)

    return run


def _blocks(shingles: str, documents: str):
    """How many blocks so many shingles and documents fill."""
    return F.greatest(F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.ceil(F.col(documents) / BLOCK_DOCUMENTS)).cast("long")


def _sizes(members: DataFrame, *keys: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.sum("n").alias("_n"), F.count("*").alias("_docs"))


def _blocked(members: DataFrame, least: int) -> DataFrame:
    """Written members (class, cluster, doc, n) of classes with ``least`` members or more, with block, and the blocks of the class."""
    sizes = materialise(_sizes(members, "class"), "sizes")
    sized = join_unique(members, sizes, "class", "_docs").filter(F.col("_docs") >= least)
    sized = sized.select("class", "cluster", "doc", "n", _blocks("_n", "_docs").alias("blocks"))
    return sized.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))


def _links_within(rows: DataFrame, keys: list[str], shingle: int, percent: int) -> DataFrame:
    return rows.groupBy(*keys).applyInArrow(_tree_links(shingle, percent), "u long, v long")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, and component_id: the smallest doc_id that links lead to, itself included."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(rows.mapInArrow(_set_rows(shingle), "kind int, doc_id long, n_shingles long, set_a long, set_b long"), "sets")
    sets = found.filter("kind = 0").drop("kind")
    often = found.filter("kind = 1").groupBy("set_a").agg(F.sum("n_shingles").alias("n")).filter(F.col("n") >= OFTEN)
    often = often.orderBy(F.col("n").desc(), "set_a").limit(MOST_FREQUENT).select("set_a").toArrow().column(0).to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    filled = sets.filter("n_shingles > 0 and doc_id is not null")
    entries = filled.agg(F.sum("n_shingles")).first()[0] or 0  # a set has fewer keys than twice its shingles
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // RANGE_ENTRIES))
    leaders = materialise(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("leader"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")), "leaders")

    # A document's keys lie in many ranges, and every task with some of them may name it; so there are no more tasks than cores or memory need.
    tasks = max(spark.sparkContext.defaultParallelism, -(-ranges // TASK_RANGES))
    keyed = rows.mapInArrow(_candidate_blocks(ranges, shingle, percent, frequent), CANDIDATES)
    linked = keyed.repartition(tasks, "hash_range").sortWithinPartitions("hash_range").mapInArrow(_range_edges, "u long, v long")
    classes = components(linked.distinct())
    members = classes.join(leaders, F.col("node") == F.col("leader")).groupBy("leader").agg(F.min("component").alias("class"), F.max("n").alias("n"))
    members = materialise(members.select("class", F.col("leader").alias("cluster"), F.col("leader").alias("doc"), "n"), "members")
    blocked = _blocked(members, 2)
    texts = materialise(blocked.join(rows.select(F.col("doc_id").alias("doc"), "text"), "doc"), "blocks")
    links = materialise(_links_within(texts, ["class", "block"], shingle, percent), "links")

    used, large = [leaders, members, texts, links], texts.filter("blocks > 1")
    if not large.isEmpty():
        more, temporary = _across(large, links, shingle, percent, frequent)
        links, used = links.unionByName(more), used + temporary
    result, more = _finished(sets, filled, leaders, links)
    for table in used + more:
        release(table)
    return result


def _finished(sets: DataFrame, filled: DataFrame, leaders: DataFrame, links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Components of the leaders, passed on to the copies of their sets, for every row; and tables that nothing needs any more.

    Copies take no part in the search for components, however many there are.
    """
    keyed = filled.select("doc_id", "n_shingles", F.struct("set_a", "set_b").alias("set"))
    led = materialise(join_unique(keyed, leaders.select(F.struct("set_a", "set_b").alias("set"), "leader", "copies"), "set", "copies").select("doc_id", "n_shingles", "leader"), "led")
    # Rows that share a doc_id count as one document, so their sets belong together.
    shared = materialise(led.groupBy("doc_id").agg(F.min("leader").alias("v"), F.max("leader").alias("_w"), F.count("*").alias("_rows")).filter("v < _w"), "shared")
    if not shared.isEmpty():
        links = links.unionByName(join_unique(led, shared, "doc_id", "_rows").select(F.col("leader").alias("u"), "v"))
    joined = components(links)
    sizes = leaders.groupBy("leader").agg(F.sum("copies").alias("copies"))
    named = materialise(sizes.join(joined, F.col("leader") == F.col("node"), "left").select("leader", "copies", F.coalesce("component", "leader").alias("component_id")), "named")
    found = join_unique(led, named, "leader", "copies").select("doc_id", "n_shingles", "component_id")
    rest = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    elsewhere = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("component_id").alias("_component"))
    others = rest.join(elsewhere, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))
    return found.unionByName(others), [shared]


def _moved(rows: DataFrame, column: str, links: DataFrame) -> DataFrame:
    """rows (class, doc, n) with the cluster that the stars ``links`` put the value of ``column`` into."""
    old = rows.select("class", "doc", "n", F.col(column).alias("_old"))
    return old.join(links, F.col("_old") == F.col("u"), "left").select("class", F.coalesce("v", "_old").alias("cluster"), "doc", "n")


def _segment_keys(shingle: int, percent: int, frequent):
    """For mapInArrow over (block, cluster, class, text): the keys of each cluster's segments with its block, each once for a step; another class has other keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(percent, frequent.value)
        for batch, texts in text_steps(batches, step_bytes=STEP_BYTES):
            found: dict[tuple, list[np.ndarray]] = {}
            salts = mixed(batch.column(2).to_numpy().astype(np.uint64))
            for block, cluster, salt, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), salts, shingle_sets(texts, shingle)):
                found.setdefault((block, cluster), []).append(mixed(segments.keys(shingles) ^ salt))
            for (block, cluster), keys in found.items():
                different = np.unique(np.concatenate(keys)).view(np.int64)
                for start in range(0, len(different), 10_000):
                    part = different[start : start + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([block] * len(part), pa.string()), pa.array(np.full(len(part), cluster, np.int64))], ["key", "block", "cluster"])

    return run


def _needed_keys(shingle: int, percent: int, frequent):
    """For mapInArrow over (doc, cluster, text): the keys of each document's segments, their level, and how many of these a link needs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(percent, frequent.value)
        for batch, texts in text_steps(batches, step_bytes=STEP_BYTES):
            out = []
            for doc, cluster, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(texts, shingle)):
                out += [(keys.view(np.int64), doc, cluster, level, need) for level, keys, need in segments.by_level(shingles)] if len(shingles) else []
            sizes = [len(x[0]) for x in out]
            keys = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64)
            doc, cluster, level, need = (np.repeat(np.array([x[i] for x in out], np.int64), sizes) for i in range(1, 5))
            for start in range(0, len(keys), 10_000):
                columns = [keys, doc, cluster, level.astype(np.int32), need.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 10_000]) for c in columns], ["key", "doc", "cluster", "level", "need"])

    return run


def _narrowed(rest: DataFrame, texts: DataFrame, shingle: int, percent: int, frequent, most: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """rest (class, cluster, doc, n) of the clusters that may link with another, with classes of such clusters; and the tables made for it.

    Linked sets have ``need`` keys of a level in common, by the smaller need of the two.
    So have their clusters, whose keys are counted in pairs. A key that more than
    ``most`` clusters hold isn't: each document that has it needs one less of the
    others, and if it needs none, all that hold the key stay together.
    """
    most = MET_CLUSTERS if most is None else most
    rows = rest.select("doc", "cluster").join(texts, "doc").select("doc", "cluster", "text")
    keys = materialise(rows.mapInArrow(_needed_keys(shingle, percent, frequent), "key long, doc long, cluster long, level int, need int"), "keys")
    held = keys.groupBy("key", "cluster").agg(F.count("*").alias("_rows")).groupBy("key").agg(F.count("*").alias("clusters"), F.sum("_rows").alias("_rows"))
    held = materialise(held.filter("clusters > 1"), "held")
    met = materialise(join_unique(keys, held, "key", "_rows").drop("_rows"), "met")
    spared = met.filter(F.col("clusters") > most).groupBy("doc", "level").agg(F.count("*").alias("_spared"))
    needs = met.join(spared, ["doc", "level"], "left").withColumn("need", F.col("need") - F.coalesce("_spared", F.lit(0)))
    ends = materialise(needs.groupBy("key", "level", "cluster").agg(F.min("need").alias("need"), F.max("clusters").alias("clusters")), "ends")
    few = ends.filter(F.col("clusters") <= most).select("key", "level", F.col("cluster").alias("u"), F.col("need").alias("_u"))
    others = few.select("key", F.col("u").alias("v"), F.col("_u").alias("_v"))
    pairs = few.join(others, "key").filter("u < v").groupBy("u", "v", "level").agg(F.count("*").alias("_met"), F.min(F.least("_u", "_v")).alias("_need"))
    many = ends.filter(F.col("clusters") > most)
    first = materialise(many.groupBy("key").agg(F.min("cluster").alias("v"), F.min("need").alias("_need"), F.count("*").alias("_rows")).filter("_need <= 0"), "first")
    stay = join_unique(many.select("key", F.col("cluster").alias("u")), first, "key", "_rows").select("u", "v")
    near = components(pairs.filter("_met >= _need").select("u", "v").unionByName(stay.distinct()))
    found = rest.drop("class").join(near.select(F.col("node").alias("cluster"), F.col("component").alias("class")), "cluster").select("class", "cluster", "doc", "n")
    return materialise(found, "narrowed"), [keys, held, met, ends, first]


def _meeting_blocks(dealt: DataFrame, texts: DataFrame, shingle: int, percent: int, frequent) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks in which different clusters of a class have the content of a segment in common, and the table of contents behind them.

    Of all contents that the same blocks share, one makes the pairs; the blocks of a
    content are told by their number and by two sums of hashes, never listed.
    """
    rows = dealt.select("doc", "block", "cluster", "class").join(texts, "doc").select("block", "cluster", "class", "text")
    keys = materialise(rows.mapInArrow(_segment_keys(shingle, percent, frequent), "key long, block string, cluster long").groupBy("key", "block").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")), "keys")
    held = keys.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("block")).alias("x"), F.bit_xor(F.xxhash64("block", F.lit(1))).alias("y")).filter("a < b")
    chosen = held.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    ends = keys.join(chosen, "key", "left_semi").select("key", "block")
    return ends.join(ends.withColumnRenamed("block", "block2"), "key").filter("block <= block2").select("block", "block2").distinct(), keys


def _across(large: DataFrame, links: DataFrame, shingle: int, percent: int, frequent) -> tuple[DataFrame, list[DataFrame]]:
    """Links between the blocks of classes that fill several, and the tables made for them. Texts join only what is to be compared.

    Blocks don't overlap, so the links within them are stars already, and so are those
    between the clusters' representatives.
    """
    texts = large.select("doc", "text")
    clustered = materialise(_moved(large, "doc", links), "clusters")
    heads = _blocked(clustered.filter("doc = cluster"), 2).join(texts, "doc")
    more = materialise(_links_within(heads, ["class", "block"], shingle, percent), "links")
    again = materialise(_moved(clustered, "cluster", more), "clusters")
    unsettled = materialise(again.groupBy("class").agg(F.min("cluster").alias("_a"), F.max("cluster").alias("_b"), F.count("*").alias("_docs")), "classes")
    rest = materialise(join_unique(again, unsettled, "class", "_docs").filter("_a < _b").select("class", "cluster", "doc", "n"), "unsettled")
    used = [clustered, more, again, unsettled, rest]
    if rest.isEmpty():
        return more, used
    rest, made = _narrowed(rest, texts, shingle, percent, frequent)
    used += [*made, rest]
    if rest.isEmpty():
        return more, used
    # A large cluster's members go to blocks of its own; the small clusters of a class share blocks by hash.
    sizes = materialise(_sizes(rest, "class", "cluster"), "sizes")
    big = (F.col("_n") * 2 > BLOCK_SHINGLES) | (F.col("_docs") * 2 > BLOCK_DOCUMENTS)
    sizes = sizes.withColumn("own", F.when(big, _blocks("_n", "_docs")))
    small = sizes.filter("own is null").groupBy("class").agg((F.sum("_n") * 2).alias("_n"), (F.sum("_docs") * 2).alias("_docs"), F.count("*").alias("_rows"))
    shared = materialise(small.select("class", _blocks("_n", "_docs").alias("shared"), "_rows"), "shared")
    columns = ["cluster", "own", "_docs", "_place"]
    alone = sizes.filter("own is not null").withColumn("_place", F.concat_ws(":", "cluster", F.lit("own"))).select(*columns)
    together = join_unique(sizes.filter("own is null"), shared, "class", "_rows").withColumn("_place", F.concat_ws(":", "class", F.lit("shared"), F.pmod(F.xxhash64("cluster"), F.col("shared"))))
    placed = materialise(alone.unionByName(together.select(*columns)), "placed")
    block = F.when(F.col("own").isNotNull(), F.concat_ws(":", "_place", F.pmod(F.xxhash64("doc"), F.col("own")))).otherwise(F.col("_place"))
    lone = F.when(F.col("own").isNotNull(), F.col("cluster"))
    dealt = materialise(join_unique(rest.select("class", "cluster", "doc"), placed, "cluster", "_docs").select("class", "cluster", "doc", block.alias("block"), lone.alias("lone")), "blocks")
    pairs, keys = _meeting_blocks(dealt, texts, shingle, percent, frequent)
    owners = dealt.filter("lone is not null").select("block", "lone").distinct()
    pairs = pairs.join(owners, "block", "left").join(owners.select(F.col("block").alias("block2"), F.col("lone").alias("lone2")), "block2", "left")
    pairs = pairs.filter("not (lone is not null and lone2 is not null and lone = lone2)")
    sides = pairs.select("block", "block2", F.explode(F.array_distinct(F.array("block", "block2"))).alias("side"))
    copies = sides.join(dealt.withColumnRenamed("block", "side").drop("lone", "class"), "side").join(texts, "doc")
    found = materialise(_links_within(copies, ["block", "block2"], shingle, percent), "links")
    return more.unionByName(found), [*used, sizes, shared, placed, dealt, keys, found]
