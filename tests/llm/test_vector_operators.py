import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import centroid_clusters, hard_negatives
from tessera.llm.centroid_clusters import assign, half_distances

SCHEMA = "vec_id long, embedding array<double>, label int, distance string, anchor string, rank int"


def table(spark, rows):
    """vec_id, embedding, label; further columns with clashing names."""
    return spark.createDataFrame([(i, v, label, "x", "y", 7) for i, v, label in rows], SCHEMA)


def whole(vector):
    return [math.floor(256 * x) for x in vector]


def is_usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


# ---- clusters --------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, components):
    kept = [(i, whole(v)) for i, v, _ in rows if is_usable(v) and len(v) == components]
    ordered = sorted(kept, key=lambda x: ("~" if x[0] is None else hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in ordered[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(centroid_clusters, "BLOCK", 37)
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) + rng.choice([0, 0, 0.01]) for _ in range(4)], 0) for i in range(300)]  # few places: many ties
    rows += [rows[7]] * 60 + [(None, [0.1] * 4, 1), (None, [0.2] * 4, None), (400, [0.3] * 4, 1), (400, [0.4] * 4, 1)]
    rows += [(401, None, 1), (402, [1.0, None, 1.0, 1.0], 1), (403, [float("nan")] * 4, 1), (404, [float("inf")] * 4, 1), (405, [1.0] * 5, 1), (406, [], 1)]
    got = centroid_clusters.clusters(table(spark, rows).repartition(5), k=9, rounds=4, components=4).collect()
    assert in_order(got) == in_order(brute_clusters(rows, 9, 4, 4))


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(3, [0.5, 0.5], 0), (4, [0.5, 0.5], 0)]
    assert in_order(centroid_clusters.clusters(table(spark, rows), k=5, components=2).collect()) == in_order(brute_clusters(rows, 5, 5, 2))
    assert centroid_clusters.clusters(table(spark, []), components=2).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroid_clusters.clusters(table(spark, [(1, [1e30, 0.0], 0)]), components=2).collect()


def test_bounds_skip_distances_and_hold():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 8))
    vectors = (centres[rng.integers(0, 12, 2000)] + rng.integers(-60, 60, (2000, 8))).astype(np.int64)
    centroids = centres + rng.integers(-5, 5, centres.shape)
    clusters, upper, lower = np.zeros(2000, np.int32), np.full(2000, np.inf), np.zeros((2000, 12))
    assign(vectors, centroids, clusters, upper, lower)
    true = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (clusters == true.argmin(1)).all()
    assert (upper >= np.sqrt(true.min(1))).all() and (lower <= np.sqrt(true)).all()
    again = assign(vectors, centroids, clusters, upper, lower)
    assert again < 2000 * 12 / 4 and (clusters == true.argmin(1)).all()  # most pairs are never computed
    assert (np.diag(half_distances(centroids)) == 0).all()


def test_distances_beyond_doubles_are_exact():
    vectors = np.array([[1 << 26, 1 << 26], [-(1 << 26), (1 << 26) - 1]], np.int64)
    d = centroid_clusters.Distances(vectors, vectors[::-1].copy())
    assert d.to(np.arange(2), 0).tolist() == [(1 << 27) ** 2 + 1, 0]


# ---- hard negatives --------------------------------------------------------------------------


def brute_negatives(rows):
    v = [(i, (label + 1) % 10 if i % 7 == 0 else label, whole(x)) for i, x, label in rows if i is not None and label is not None and is_usable(x)]
    out = []
    for a, (i, label, x) in enumerate(v):
        if i % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), j, other == label) for b, (j, other, y) in enumerate(v) if b != a)
        for p, positive, _ in [s for s in scores if s[2]][:5]:
            fit = [(s, j) for s, j, same in scores if not same and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, positive, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_negatives_match_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 2)
    monkeypatch.setattr(hard_negatives.candidate_blocks, "__defaults__", (256, 64, 8))
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(6)]
    rows = [(i * 10, [x + rng.uniform(-spread, spread) for x in centres[i % 6]], rng.choice([i % 6, 3])) for i in range(400)]
    rows += [rows[20]] * 90 + [(200, centres[0], 0)]  # copies of an anchor, and another row with its id
    rows += [(7, centres[1], 3), (-100, centres[2], -4), (None, centres[0], 1), (900_000, None, 1), (900_100, [None] * 6, 1), (900_200, [float("nan")] * 6, 1), (900_300, centres[0], None)]
    rows += [(900_400, centres[0][:3], 2), (900_500, [], 2), (1, centres[0] + [0.5], 2)]  # unlike lengths
    got = hard_negatives.mine(table(spark, rows).repartition(5), hard_negatives.relabelled(), batch=7).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_negatives_without_anchors_or_rows(spark):
    assert hard_negatives.mine(table(spark, [])).collect() == []
    assert hard_negatives.mine(table(spark, [(1, [1.0], 2), (100, [1.0], 3)])).collect() == []


def random_tree(rng, rows, leaf, spread):
    centres = rng.integers(-300, 300, (5, 16))
    label = rng.integers(0, 5, rows)
    vectors = (centres[label] + rng.integers(-spread, spread + 1, (rows, 16))).astype(np.int64)
    return hard_negatives.build_tree(vectors, label.astype(np.int64), np.arange(rows), np.arange(rows), leaf)


def test_intervals_hold_and_prune_groups():
    rng = np.random.default_rng(1)
    a, b = random_tree(rng, 120, 8, 10), random_tree(rng, 1500, 16, 10)
    low, high = hard_negatives.intervals(a, b)
    products = a.vectors @ b.vectors.T
    for i, x in enumerate(a.nodes):
        for j, y in enumerate(b.nodes):
            part = products[x["start"] : x["end"], y["start"] : y["end"]]
            assert low[i, j] <= part.min() and part.max() <= high[i, j]
    search = hard_negatives.Search(a, np.full((120, 1), hard_negatives.NONE), np.full((120, 1), hard_negatives.NO_ID), 5, True)
    b.rows = b.rows + 10_000
    search.run(b)
    masked = np.where(a.labels[:, None] == b.labels[None, :], products, hard_negatives.NONE)
    expected = [sorted(zip(-row, b.ids))[:5] for row in masked]
    assert [list(zip(-s, i)) for s, i in zip(search.best.scores, search.best.ids)] == expected
    leaves = (a.nodes["left"] < 0).sum() * (b.nodes["left"] < 0).sum()
    assert search.pruned and search.met < leaves  # pairs of groups were pruned above the leaves


def test_copies_of_one_vector_make_a_tree():
    tree = hard_negatives.build_tree(np.ones((1000, 3), np.int64), np.arange(1000) % 7, np.arange(1000), np.arange(1000), 16)
    leaves = tree.nodes[tree.nodes["left"] < 0]
    assert leaves["end"].max() == 1000 and (leaves["end"] - leaves["start"]).sum() == 1000
    assert (leaves["low"] == leaves["high"]).mean() > 0.5
