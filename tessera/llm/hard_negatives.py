"""Hard negatives by dual-tree search over integer vectors.

Candidates are dealt by range of a coarse cell of their direction (and by hash within a
cell, so no cell fills a task), and each task writes its rows as blocks with a ball tree
each: nodes with a centre, a radius, the largest norm and the range of labels. Anchors
are taken in batches of bounded size; each batch gets a tree of its own, is sent to all
tasks, and meets every block:

* the inner products of two nodes lie in an interval made from centres, radii and norms.
  A pair whose interval ends below what every anchor of the node still needs, begins
  above what any of them may take, or whose labels can't fit, is pruned with all its
  anchors and candidates at once;
* pairs of leaves are scored exactly in whole numbers, and scores enter the anchors'
  lists of the best so far, which raise what they need.

The first search finds each anchor's positives: the best rows of its label. Each positive
gives a window of scores, and the second search finds the best rows of other labels in
every window. Tasks send at most their own best for each window; a ranked window, which
Spark limits before the shuffle, merges them.

Defined cases: rows without a vec_id or a label, without a vector, or with a null or
non-finite component take no part; vectors of unlike length are compared as if the
shorter one went on with zeros; repeated rows count each, so another row with the vec_id
of the anchor can be its positive, and an anchor that occurs twice is answered twice; a
component beyond 2**26 after scaling raises an error; an anchor without positives or
whose windows are empty gives no row; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.integer_vectors import arithmetic, packed, padded, scaled, unpacked, usable_rows
from tessera.plans.storage import materialise, materialise_each

POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score, in hundredths of the positive's score.
LEAST, MOST = 30, 90
#: Rows of a block of candidates, of a leaf of it, and of a leaf of the anchors; anchors that are sent to the tasks at once.
BLOCK_ROWS, LEAF_ROWS, ANCHOR_LEAF, ANCHOR_BATCH = 4096, 256, 64, 16_384
NONE, NO_ID = -(1 << 62), (1 << 63) - 1
BLOCKS = "first_row long, ids binary, labels binary, kind string, vectors binary, nodes binary, centres binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8"), ("norm", "<f8"), ("low", "<i8"), ("high", "<i8")])


@dataclass
class Tree:
    """A ball tree over rows that lie in the order of its leaves; a node's ``left`` is -1 at a leaf."""

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    nodes: np.ndarray
    centres: np.ndarray


def build_tree(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int) -> Tree:
    """Split at the median of the widest component until ``leaf`` rows are left."""
    order, nodes, centres = np.arange(len(ids)), [], []
    todo = [(0, len(ids), -1, False)]
    as_float = vectors.astype(np.float64)
    while todo:
        start, end, parent, is_right = todo.pop()
        part = order[start:end]
        points = as_float[part]
        centre = points.mean(0)
        radius = np.sqrt(((points - centre) ** 2).sum(1).max()) * (1 + 1e-9)
        norm = np.sqrt((points * points).sum(1).max()) * (1 + 1e-9)
        number = len(nodes)
        nodes.append([start, end, -1, -1, radius, norm, labels[part].min(), labels[part].max()])
        centres.append(centre)
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = number
        if end - start > leaf and radius > 0:
            axis = int(points.var(0).argmax())
            half = (end - start) // 2
            order[start:end] = part[np.argpartition(points[:, axis], half)]
            todo += [(start + half, end, number, True), (start, start + half, number, False)]
        elif end - start > leaf:  # copies of one vector: by label, as nothing else tells them apart
            half = (end - start) // 2
            order[start:end] = part[np.argsort(labels[part], kind="stable")]
            todo += [(start + half, end, number, True), (start, start + half, number, False)]
    return Tree(vectors[order], labels[order], ids[order], rows[order], np.array([tuple(x) for x in nodes], NODE), np.array(centres))


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between the rows of any node of ``a`` and of any node of ``b``, rounded outwards."""
    width = min(a.centres.shape[1], b.centres.shape[1])  # components beyond it meet zeros
    ca, cb = a.centres[:, :width], b.centres[:, :width]
    ra, rb = a.nodes["radius"][:, None], b.nodes["radius"][None, :]
    na, nb = np.sqrt((ca * ca).sum(1))[:, None], np.sqrt((cb * cb).sum(1))[None, :]
    middle, reach = ca @ cb.T, ra * nb + rb * na + ra * rb
    most = a.nodes["norm"][:, None] * b.nodes["norm"][None, :]
    slack = 1 + 1e-9 * (na * nb + reach + most)
    return np.maximum(middle - reach, -most) - slack, np.minimum(middle + reach, most) + slack


class Best:
    """The ``k`` best scores of each list and their ids; ties go to the smaller id."""

    def __init__(self, lists: int, k: int):
        self.scores, self.ids = np.full((lists, k), NONE, np.int64), np.full((lists, k), NO_ID, np.int64)

    def would_enter(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        last = self.scores[lists, -1]
        return (scores > last) | ((scores == last) & (ids < self.ids[lists, -1]))

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Merge in what enters; the lists that changed."""
        entering = self.would_enter(lists, scores, ids)
        lists, scores, ids = lists[entering], scores[entering], ids[entering]
        if not len(lists):
            return lists
        k, changed = self.scores.shape[1], np.unique(lists)
        of = np.concatenate([np.repeat(changed, k), lists])
        scores = np.concatenate([self.scores[changed].ravel(), scores])
        ids = np.concatenate([self.ids[changed].ravel(), ids])
        order = np.lexsort((ids, -scores, of))
        of, scores, ids = of[order], scores[order], ids[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        kept = rank < k
        self.scores[changed], self.ids[changed] = scores[kept].reshape(-1, k), ids[kept].reshape(-1, k)
        return changed


class Search:
    """Best candidates of each anchor in each of its windows [low, high], over all blocks of a task."""

    def __init__(self, anchors: Tree, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.anchors, self.low, self.high, self.same = anchors, low, high, same_label
        self.windows = low.shape[1]
        self.best = Best(low.size, k)
        nodes = anchors.nodes
        self.parents = np.full(len(nodes), -1)
        for side in ("left", "right"):
            has = np.flatnonzero(nodes[side] >= 0)
            self.parents[nodes[side][has]] = has
        self.needs = np.array([float(low[n["start"] : n["end"]].min()) for n in nodes])
        self.takes = np.array([float(high[n["start"] : n["end"]].max()) for n in nodes])
        self.met = self.pruned = 0

    def _raise_needs(self, leaf: int) -> None:
        node, nodes = leaf, self.anchors.nodes
        start, end = nodes["start"][leaf], nodes["end"][leaf]
        needed = np.maximum(self.low[start:end], self.best.scores[start * self.windows : end * self.windows, -1].reshape(-1, self.windows))
        needed = np.where(needed > self.high[start:end], NO_ID, needed)  # a window that can't change any more
        value = float(needed.min())
        while node >= 0 and value > self.needs[node]:
            self.needs[node] = value
            node = self.parents[node]
            if node >= 0:
                value = min(self.needs[nodes["left"][node]], self.needs[nodes["right"][node]])

    def run(self, block: Tree) -> None:
        a, b = self.anchors.nodes, block.nodes
        least, most = intervals(self.anchors, block)
        todo = [(0, 0)]
        width = min(self.anchors.vectors.shape[1], block.vectors.shape[1])
        kind = arithmetic(self.anchors.vectors, block.vectors)
        av, bv = self.anchors.vectors[:, :width].astype(kind), block.vectors[:, :width].astype(kind)
        while todo:
            i, j = todo.pop()
            self.met += 1
            if most[i, j] < self.needs[i] or least[i, j] > self.takes[i] or self._labels_never_fit(a[i], b[j]):
                self.pruned += 1
                continue
            if a["left"][i] < 0 and b["left"][j] < 0:
                self._score(i, a["start"][i], a["end"][i], b["start"][j], b["end"][j], av, bv, block)
                continue
            if b["left"][j] < 0 or (a["left"][i] >= 0 and a["radius"][i] > b["radius"][j]):
                pairs = [(a["left"][i], j), (a["right"][i], j)]
            else:
                pairs = [(i, b["left"][j]), (i, b["right"][j])]
            todo += sorted(pairs, key=lambda p: most[p])  # the more promising one is next

    def _labels_never_fit(self, x: np.void, y: np.void) -> bool:
        if self.same:
            return x["high"] < y["low"] or y["high"] < x["low"]
        return x["low"] == x["high"] == y["low"] == y["high"]

    def _score(self, leaf: int, a0: int, a1: int, b0: int, b1: int, av: np.ndarray, bv: np.ndarray, block: Tree) -> None:
        scores = (av[a0:a1] @ bv[b0:b1].T).astype(np.int64)
        fits = self.anchors.labels[a0:a1, None] == block.labels[None, b0:b1]
        fits = fits & (self.anchors.rows[a0:a1, None] != block.rows[None, b0:b1]) if self.same else ~fits
        found = []
        for w in range(self.windows):
            lists = np.arange(a0, a1) * self.windows + w
            needed = np.maximum(self.low[a0:a1, w], self.best.scores[lists, -1])
            r, c = np.nonzero(fits & (scores >= needed[:, None]) & (scores <= self.high[a0:a1, w, None]))
            found.append((lists[r], scores[r, c], block.ids[b0 + c]))
        if len(self.best.add(*[np.concatenate(x) for x in zip(*found)])):
            self._raise_needs(leaf)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor (its place in the tree), window, score and id of all that was kept."""
        lists, k = np.nonzero(self.best.scores > NONE)
        return lists // self.windows, lists % self.windows, self.best.scores[lists, k], self.best.ids[lists, k]


# ---- candidates ------------------------------------------------------------------------------


def _cleaned(scale: int):
    """For mapInArrow over vec_id, label, embedding: usable rows with whole numbers, and a cell of their direction."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, flat = usable_rows(batch.column(2))
            vectors = padded(lengths, scaled(flat, scale))
            signs = np.random.default_rng(11).choice([-1.0, 1.0], (8, max(vectors.shape[1], 1)))  # the first draws are alike for each width
            cells = ((vectors.astype(np.float64) @ signs[:, : vectors.shape[1]].T > 0) @ (1 << np.arange(8))).astype(np.int32)
            taken = pa.array(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(scaled(flat, scale)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), lists, pa.array(cells)], ["vec_id", "label", "vector", "cell"])

    return run


def _arrays(batch: pa.RecordBatch, start: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = batch.slice(start, rows)
    lists = part.column(2)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return part.column(0).to_numpy(), part.column(1).to_numpy(), padded(lengths, lists.flatten().to_numpy())


def _trees(block_rows: int, leaf: int):
    """For mapInArrow over dealt rows: blocks, each with its tree; rows are numbered by task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                ids, labels, vectors = _arrays(batch, start, block_rows)
                tree = build_tree(vectors, labels, ids, np.arange(len(ids)), leaf)
                kind, raw = packed(tree.vectors)
                row = [number, tree.ids.astype("<i8").tobytes(), tree.labels.astype("<i8").tobytes(), kind, raw, tree.nodes.tobytes(), tree.centres.astype("<f8").tobytes()]
                types = [pa.int64(), pa.binary(), pa.binary(), pa.string(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["first_row", "ids", "labels", "kind", "vectors", "nodes", "centres"])
                number += len(ids)

    return run


def candidate_blocks(embeddings: DataFrame, label: Column, scale: int = 256, block_rows: int = BLOCK_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """Blocks of usable rows with their trees, written."""
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = named.filter("vec_id is not null and label is not null and embedding is not null").mapInArrow(_cleaned(scale), "vec_id long, label long, vector array<long>, cell int")
    dealt = clean.repartitionByRange("cell", F.xxhash64("vec_id", "vector"), F.monotonically_increasing_id()).drop("cell")
    return materialise(dealt.mapInArrow(_trees(block_rows, leaf), BLOCKS), "candidates")


def _read_trees(batches: Iterable[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for i in range(batch.num_rows):
            first, ids, labels, kind, vectors, nodes, centres = [c[i].as_py() for c in batch.columns]
            ids, nodes = np.frombuffer(ids, "<i8"), np.frombuffer(nodes, NODE)
            yield Tree(unpacked(kind, vectors, len(ids)), np.frombuffer(labels, "<i8"), ids, first + np.arange(len(ids)), nodes, np.frombuffer(centres, "<f8").reshape(len(nodes), -1))


def _anchors(divisor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _read_trees(batches):
            at = np.flatnonzero(tree.ids % divisor == 0)
            vectors = pa.array([v.tolist() for v in tree.vectors[at]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids[at]), pa.array(tree.labels[at]), vectors, pa.array(tree.rows[at])], ["vec_id", "label", "vector", "row"])

    return run


# ---- the searches ----------------------------------------------------------------------------


def _found(sent, k: int, same_label: bool):
    """For mapInArrow over blocks: anchor (place), window, score and id of a task's best."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = sent.value
        search = Search(anchors, low, high, k, same_label)
        for tree in _read_trees(batches):
            search.run(tree)
        columns = search.results()
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["anchor", "window", "score", "id"])

    return run


def _ranked(blocks: DataFrame, anchors: Tree, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast((anchors, low, high))
    found = blocks.mapInArrow(_found(sent, k, same_label), "anchor long, window long, score long, id long")
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def windows(scores: np.ndarray, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest score of a negative for each positive's score: least * score <= 100 * negative <= most * score; an empty window where there is no score."""
    low, high = -((-least * scores) // 100), (most * scores) // 100
    absent = scores == NONE
    return np.where(absent, NO_ID // 2, low), np.where(absent, NONE, high)


def _of_batch(blocks: DataFrame, table: pa.Table) -> DataFrame:
    """The negatives of a batch of anchors."""
    spark = blocks.sparkSession
    lists = table.column("vector").combine_chunks()
    vectors = padded(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy())
    tree = build_tree(vectors, *[table.column(c).to_numpy() for c in ("label", "vec_id", "row")], ANCHOR_LEAF)
    n = len(tree.ids)
    every = np.full((n, 1), NONE, np.int64), np.full((n, 1), NO_ID, np.int64)
    positives = _ranked(blocks, tree, *every, POSITIVES, True).select("anchor", "rank", "score", "id").toArrow()  # at most POSITIVES for each anchor of the batch
    at = positives.column("anchor").to_numpy(), positives.column("rank").to_numpy() - 1
    scores, ids = np.full((n, POSITIVES), NONE, np.int64), np.full((n, POSITIVES), NO_ID, np.int64)
    scores[at], ids[at] = positives.column("score").to_numpy(), positives.column("id").to_numpy()
    low, high = windows(scores)
    found = _ranked(blocks, tree, low, high, NEGATIVES, False)
    place, window = np.nonzero(scores > NONE)
    pairs = pa.table({"anchor": place, "window": window, "anchor_id": tree.ids[place], "positive_id": ids[place, window], "positive_score": scores[place, window]})
    named = found.join(F.broadcast(spark.createDataFrame(pairs)), ["anchor", "window"])
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(embeddings: DataFrame, label: Column | None = None, divisor: int = 100, scale: int = 256, batch: int = ANCHOR_BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor (vec_id divisible by ``divisor``) and positive.

    At most ``batch`` anchors, by a hash of their rows, are on the driver at once.
    """
    spark = embeddings.sparkSession
    blocks = candidate_blocks(embeddings, F.col("label") if label is None else label, scale)
    anchors = materialise(blocks.mapInArrow(_anchors(divisor), "vec_id long, label long, vector array<long>, row long"), "anchors")
    parts = -(-anchors.count() // batch)
    dealt = (anchors.filter(F.pmod(F.xxhash64("row"), F.lit(max(parts, 1))) == p).toArrow() for p in range(parts))
    return materialise_each((_of_batch(blocks, table) for table in dealt if table.num_rows), "negatives", spark, RESULT)



def relabelled() -> Column:
    """Where vec_id is divisible by 7, the label is the next one of ten."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


ORACLE_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.rid = b.rid AS itself, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place
  FROM scored WHERE same AND NOT itself QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, place ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
