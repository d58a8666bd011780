"""Clusters around centroids in exact integers, with Elkan's bounds.

Vectors travel in blocks. A block keeps, besides its vectors, each vector's cluster, an
upper bound of the distance to its centroid and a lower bound of the distance to every
centroid; each round reads the blocks of the round before and writes its own. A
distance is computed only where these bounds and the distances between centroids leave
the outcome open:

* if an upper bound is below half the distance from its centroid to every other, no
  other centroid can be as near;
* if it is below the lower bound for a centroid, or below half the distance between
  the two centroids, that one can't be as near.

Bounds are rounded away from the truth and compared strictly, so a tie is never pruned
and goes to the smaller number. What is computed are squared distances in whole
numbers. Centroids move to the componentwise floor of the mean, from sums of 38 digits.

The driver holds the centroids and the sums behind them, ``clusters`` times the number of
components, at any size of the table; blocks hold ``BLOCK`` vectors.

Defined cases: vectors with another number of components, with a null or non-finite
component, or null are left out; repeated rows count each; a null vec_id is passed on
and comes last in the order of first centroids, rows that share a vec_id follow each
other there by their components; with fewer vectors than clusters, every vector starts
one; a component beyond 2**26 after scaling raises an error, as a distance would leave
64 bits; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.integer_vectors import EXACT, padded, scaled, unpacked, usable_rows
from tessera.llm.integer_vectors import packed as packed_vectors
from tessera.plans.storage import materialise, release

COMPONENTS, CLUSTERS, ROUNDS, SEED = 64, 40, 5, "2"
#: Vectors of one block.
BLOCK = 8192
#: Doubles are multiplied by these where a bound must not err to the wrong side.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48
BLOCKS = "ids array<long>, kind string, vectors binary"
STATE = BLOCKS + ", clusters binary, upper binary, lower binary, sums binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _blocks(components: int, scale: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows, lengths, flat = usable_rows(part.column(1), components)
                if len(rows):
                    kind, raw = packed_vectors(padded(lengths, scaled(flat, scale), components))
                    ids = part.column(0).take(pa.array(rows)).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([kind]), pa.array([raw], pa.binary())], ["ids", "kind", "vectors"])

    return run


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield {name: row.column(k)[0].as_py() for k, name in enumerate(batch.schema.names)}


def _first(clusters: int, seed: str):
    """For mapInArrow: of each block the vectors that may be among the first centroids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches):
            hashes = ["~" if x is None else hashlib.sha256(f"{seed}:{x}".encode()).hexdigest() for x in block["ids"]]
            vectors = unpacked(block["kind"], block["vectors"], len(hashes))
            best = sorted(((h, vectors[i].tolist()) for i, h in enumerate(hashes)))[:clusters]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best]), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["hash", "vector"])

    return run


class Distances:
    """Exact squared distances between rows of ``vectors`` and ``centroids``, by the expanded square in doubles where that is exact."""

    def __init__(self, vectors: np.ndarray, centroids: np.ndarray):
        most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
        kind = np.float64 if 4 * most * most * vectors.shape[1] < EXACT else np.int64
        self.vectors, self.centroids = vectors.astype(kind), centroids.astype(kind)
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.of_centroids = np.einsum("ij,ij->i", self.centroids, self.centroids)

    def to(self, rows: np.ndarray, c: int) -> np.ndarray:
        """From these rows to one centroid."""
        return (self.squares[rows] - 2 * (self.vectors[rows] @ self.centroids[c]) + self.of_centroids[c]).astype(np.int64)

    def to_each(self, rows: np.ndarray, clusters: np.ndarray) -> np.ndarray:
        """From each of these rows to a centroid of its own."""
        products = np.einsum("ij,ij->i", self.vectors[rows], self.centroids[clusters])
        return (self.squares[rows] - 2 * products + self.of_centroids[clusters]).astype(np.int64)


def half_distances(centroids: np.ndarray) -> np.ndarray:
    """Half the distance between any two centroids, rounded down."""
    d = Distances(centroids, centroids)
    every = np.arange(len(centroids))
    return np.stack([np.sqrt(d.to(every, c).astype(np.float64)) for c in every]) * 0.5 * DOWN


def assign(vectors: np.ndarray, centroids: np.ndarray, clusters: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring clusters and bounds up to these centroids, in place; returns the number of distances that were computed."""
    d, half = Distances(vectors, centroids), half_distances(centroids)
    nearest_other = np.where(np.eye(len(centroids), dtype=bool), np.inf, half).min(1)
    rows = np.flatnonzero(~(upper < nearest_other[clusters]))
    computed = len(rows)
    best = np.zeros(len(vectors), np.int64)
    best[rows] = d.to_each(rows, clusters[rows])
    root = np.sqrt(best[rows].astype(np.float64))
    upper[rows], lower[rows, clusters[rows]] = root * UP, root * DOWN
    rows = rows[~(upper[rows] < nearest_other[clusters[rows]])]
    for c in range(len(centroids)):
        own, bound = clusters[rows], upper[rows]
        open_rows = rows[(own != c) & ~(bound < lower[rows, c]) & ~(bound < half[own, c])]
        if not len(open_rows):
            continue
        computed += len(open_rows)
        found = d.to(open_rows, c)
        root = np.sqrt(found.astype(np.float64))
        lower[open_rows, c] = root * DOWN
        nearer = (found < best[open_rows]) | ((found == best[open_rows]) & (c < clusters[open_rows]))
        moved = open_rows[nearer]
        clusters[moved], best[moved], upper[moved] = c, found[nearer], root[nearer] * UP
    return computed


def _narrow(bounds: np.ndarray, towards: float) -> bytes:
    """As 32-bit floats, rounded towards +inf or -inf."""
    return np.nextafter(bounds.astype(np.float32), np.float32(towards)).tobytes()


def _round(centroids: np.ndarray, moves: np.ndarray | None):
    """For mapInArrow over blocks (``moves`` None: without bounds yet) or states: the states after one round, with each cluster's sums and count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches):
            n, k = len(block["ids"]), len(centroids)
            vectors = unpacked(block["kind"], block["vectors"], n)
            if moves is None:
                clusters, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
            else:
                clusters = np.frombuffer(block["clusters"], np.int32).copy()
                upper = (np.frombuffer(block["upper"], np.float32).astype(np.float64) + moves[clusters]) * UP
                lower = np.maximum((np.frombuffer(block["lower"], np.float32).astype(np.float64).reshape(n, k) - moves) * DOWN, 0)
            assign(vectors, centroids, clusters, upper, lower)
            sums = np.zeros((k, vectors.shape[1] + 1), np.int64)
            np.add.at(sums, clusters, np.column_stack([vectors, np.ones(n, np.int64)]))
            columns = [[block["ids"]], [block["kind"]], [block["vectors"]], [clusters.tobytes()], [_narrow(upper, np.inf)], [_narrow(lower, -np.inf)], [sums.tobytes()]]
            types = [pa.list_(pa.int64()), pa.string(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["ids", "kind", "vectors", "clusters", "upper", "lower", "sums"])

    return run


def _added(clusters: int):
    """For mapInArrow: the sums of all blocks of a task, a row for each number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                part = np.frombuffer(raw, np.int64)
                total = part.copy() if total is None else total + part
        if total is not None:
            width = len(total) // clusters
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), pa.array(total[at])], ["cluster", "at", "value"])

    return run


def moved(centroids: np.ndarray, state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after this round (an empty one stays), and how far each went, rounded up."""
    k, width = centroids.shape
    parts = state.select("sums").mapInArrow(_added(k), "cluster int, at int, value long")
    sums = {(r["cluster"], r["at"]): int(r["value"]) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    after = centroids.copy()
    for c in range(k):
        if count := sums.get((c, width)):
            after[c] = [sums.get((c, i), 0) // count for i in range(width)]
    d = Distances(centroids, after)
    went = np.sqrt(d.to_each(np.arange(k), np.arange(k)).astype(np.float64)) * UP
    return after, went


def _distances(centroids: np.ndarray):
    """For mapInArrow over states: vec_id, cluster and distance of every vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches):
            clusters = np.frombuffer(block["clusters"], np.int32)
            d = Distances(unpacked(block["kind"], block["vectors"], len(clusters)), centroids)
            yield pa.RecordBatch.from_arrays([pa.array(block["ids"], pa.int64()), pa.array(clusters), pa.array(d.to_each(np.arange(len(clusters)), clusters))], ["vec_id", "cluster", "distance"])

    return run


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = 256, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector, the sums of distances of its cluster and of all, and the hash of its centroid."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    state = materialise(vectors.mapInArrow(_blocks(components, scale), BLOCKS), "blocks")
    first = state.select("ids", "kind", "vectors").mapInArrow(_first(k, seed), "hash string, vector array<long>").orderBy("hash", "vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids, moves = np.array([r["vector"] for r in first], np.int64), None
    for number in range(rounds + 1):
        after = materialise(state.mapInArrow(_round(centroids, moves), STATE), "state")
        release(state)
        state = after
        if number < rounds:
            centroids, moves = moved(centroids, state)
    each = materialise(state.select("kind", "vectors", "clusters", "ids").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), "clusters")
    release(state)
    hashes = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    inertia = {r["cluster"]: r["inertia"] for r in each.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    total = spark.createDataFrame([(c, x, sum(inertia.values())) for c, x in inertia.items()], "cluster int, cluster_inertia long, inertia long")
    return each.join(F.broadcast(total.join(hashes, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS m FROM (SELECT *, sha256('2:' || vec_id) AS h FROM v) QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT rid, any_value(v) AS v, any_value(vec_id) AS vec_id, min(d * 1000 + c) % 1000 AS c, min(d * 1000 + c) // 1000 AS d FROM (
    SELECT rid, vec_id, v, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY rid)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(i) GROUP BY c, i) GROUP BY c) n ON n.c = c{i}.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} USING (c)"""
