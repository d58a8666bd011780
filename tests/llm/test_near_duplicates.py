import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard_join, substring_dedup
from tessera.llm.batches import WordHasher, run_hashes
from tessera.llm.components import components


def shingles(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 80))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        docs.append((i * 3 + 1, " ".join(w)))
    return docs + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c d"), (1005, docs[3][1]), (1006, docs[3][1])]


@pytest.mark.parametrize("n,percent,block", [(4, 85, 7), (5, 80, 2000)])
def test_components_match_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(jaccard_join, "FLUSH_ENTRIES", 500)
    docs = corpus(5)
    df = spark.createDataFrame([(i, t, 7) for i, t in docs] + [(None, "without id", 7)], "doc_id long, text string, leader int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, n, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_components(docs, n, percent)


def test_no_documents_and_no_links(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(empty).count() == 0
    lone = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(lone).collect()) == [(1, 1, 1), (2, 0, 2)]


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_linked_sets_share_a_segment(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = a.copy()
        while True:
            keep = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64)))
            both = len(np.intersect1d(a, keep))
            if 100 * both < percent * (len(a) + len(keep) - both):
                break
            b = keep
        segments = jaccard_join.Segments(percent)
        assert set(segments.keys(a).tolist()) & set(segments.keys(b).tolist())


def test_tree_finds_every_link():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(90)]
    found = list(jaccard_join.SignatureTree(sets).links(80, np.arange(90)))
    above = list(range(90))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in found:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and top(i) != top(j)
        above[max(top(i), top(j))] = min(top(i), top(j))
    for i in range(90):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert top(i) == top(j)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(50, 50)] + [(39, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 7 for i in range(7, 40)}, **{i: 7 for i in range(100, 141)}}


def test_word_hashes_follow_bytes_split():
    texts = [b"one two  three\n", None, b"", b"\x0b\x0cfour\tone", "é ü x".encode(), b"y" * 3_000_000 + b" z"]
    hashes, counts = WordHasher(99991).of(texts)
    assert counts.tolist() == [len((t or b"").split()) for t in texts]
    words = [w for t in texts for w in (t or b"").split()]
    assert len(set(words)) == len(set(hashes.tolist())) and hashes[0] == hashes[4]
    assert run_hashes(hashes, 3).shape == (len(hashes) - 2,) and run_hashes(hashes[:2], 3).shape == (0,)


def removed(docs, window):
    words = {k: (t or "").encode().split() for k, (_, t) in enumerate(docs)}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = []
    for k, (i, _) in enumerate(docs):
        w = words[k]
        gone = {p for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,period,cover", [(35, 21, (3, 6, 7, 12, 14)), (9, 7, (0, 1, 3)), (7, 7, (0, 1, 3))])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, window, period, cover):
    from tessera.llm import blocks

    monkeypatch.setattr(blocks, "FLUSH_ENTRIES", 40)
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [f"r{rng.randrange(3000)}" for _ in range(rng.randrange(0, 30))] + rng.choice(passages)
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "a " * 100), (103, docs[5][1]), (104, " ".join(passages[0])), (None, docs[6][1]), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, anchors string").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df, window, period, cover).collect()), key=str)
    assert got == removed(docs, window)


def test_covers_are_checked(spark):
    assert substring_dedup.covers(21, (3, 6, 7, 12, 14)) and not substring_dedup.covers(21, (0, 1))
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(df, 35, 21, (0, 1))
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (2, a), (5, b), (9, b), (5, ""), (7, c), (5, c), (8, None), (None, a), (None, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(5, 26, 2), (2, 26, 2), (5, 26, 2), (9, 26, 2), (5, 0, 2), (7, 26, 2), (5, 26, 2), (8, 0, 8), (None, 26, None), (None, 0, None)])


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[:-9]])), (3, " ".join(words[:20_000]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_a_passage_in_two_sets_of_a_step_is_counted():
    """Whether it is frequent shows the sum over all steps, of which a large table has many."""
    shared = "one passage that both texts hold in common"
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": [f"{shared} and this", f"{shared} but that"]})
    rows = pa.Table.from_batches(list(jaccard_join._set_rows(5)([batch]))).to_pylist()
    assert [r["n_shingles"] for r in rows if r["kind"] == 1] == [2] * 4


def test_a_task_names_a_document_once_for_all_its_ranges():
    """Copies that meet in every range are one edge of a task, however many ranges it has."""
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = ["hash_range", "keys", "places", "ids", "u", "v"]
    place, ids = np.zeros(1, "<u2").tobytes(), lambda i: np.array([i], "<i8").tobytes()
    rows = [(-1, None, None, None, 30, 20)] + [(r, np.array([r], "<u8").tobytes(), place, ids(i), None, None) for r in range(40) for i in (10, 20)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 7]), types)], names) for i in range(0, len(rows), 7)]
    found = [(u, v) for b in jaccard_join._range_edges(iter(batches)) for u, v in zip(*b.to_pydict().values())]
    assert sorted(found) == [(20, 10), (30, 10)]


def test_ranges_of_one_task_meet_in_order(spark, monkeypatch):
    """Many small ranges, few tasks: no link is lost, and rows of edges don't grow with the ranges."""
    monkeypatch.setattr(jaccard_join, "RANGE_ENTRIES", 50)
    monkeypatch.setattr(jaccard_join, "HELD_NODES", 2)
    texts = [" ".join(f"g{i // 3}w{k}" for k in range(60)) + f" own{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {i: i // 3 * 3 for i in range(60)}


def _edge_rows(docs, ranges):
    """What ranges, each a task of its own, hand on of the documents, which come in four flushes; and the documents' keys."""
    frequent = SimpleNamespace(value=np.zeros(0, np.uint64))
    table = pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs]})
    quarters = [table.slice(i * len(docs) // 4, (i + 1) * len(docs) // 4 - i * len(docs) // 4).to_batches() for i in range(4)]
    blocks = [b for q in quarters for b in jaccard_join._candidate_blocks(ranges, 4, 85, frequent)(q)]
    rows = pa.Table.from_batches(blocks).combine_chunks().to_batches()[0]
    found = []
    of = rows.column(0).to_numpy()
    for r in np.unique(of):
        for b in jaccard_join._range_edges(iter([rows.take(pa.array(np.flatnonzero(of == r)))])):
            found += zip(*b.to_pydict().values())
    segments = jaccard_join.Segments(85)
    sets = jaccard_join.shingle_sets([t.encode() for _, t in docs], 4)
    return found, {i: segments.keys(s) for (i, _), s in zip(docs, sets)}


def _classes(edges, nodes):
    u, v = jaccard_join.stars(*zip(*edges))
    up = dict(zip(u, v))
    return {i: up.get(i, i) for i in nodes}


def test_homes_connect_the_same_documents_with_fewer_edges():
    """Near copies are no edge of every range that they meet in, and what shares a key stays connected."""
    rng = random.Random(11)
    counts = []
    for groups in (20, 100):  # five times the documents, five times the ranges
        docs = []
        for g in range(groups):
            words = [f"g{g}w{k}" for k in range(rng.randrange(30, 400))]
            for _ in range(4):
                copy = list(words)
                for _ in range(rng.randrange(0, 3)):
                    copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**9)}"
                docs.append((len(docs), " ".join(copy)))
        rng.shuffle(docs)
        found, keys = _edge_rows(docs, groups // 2)
        holders = {}
        for i, own in keys.items():
            for k in own.tolist():
                holders.setdefault(k, []).append(i)
        shared = [(x[0], y) for x in holders.values() for y in x[1:]]
        assert _classes(found, keys) == _classes(shared, keys)
        counts.append(len(found) / len(docs))
    assert counts[1] < 6  # for each document; 14.6 where all entries are linked


def test_a_key_above_the_home_connects_other_homes_only():
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = ["hash_range", "keys", "places", "ids", "u", "v", "homes"]
    place, word = np.zeros(1, "<u2").tobytes(), lambda i, t="<i8": np.array([i], t).tobytes()

    def edges(key, homes):
        rows = [(key, word(key, "<u8"), place, word(i), None, None, word(h, "<u8")) for i, h in homes.items()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        return sorted((u, v) for b in jaccard_join._range_edges(iter([batch])) for u, v in zip(*b.to_pydict().values()))

    assert edges(3, {10: 3, 20: 3, 30: 1}) == [(20, 10), (30, 10)]
    assert edges(7, {10: 3, 20: 3}) == []
    assert edges(7, {10: 3, 20: 3, 30: 1, 40: 7, 50: 7}) == [(30, 10), (40, 10), (50, 10)]


def _chained(rng, groups=15, size=6):
    """Texts of groups of near copies; each group has a passage in common with the next one, too short for a link."""
    words = [[f"g{g}w{i}" for i in range(40)] for g in range(groups)]
    docs = []
    for g in range(groups):
        passage = [f"p{g}x{i}" for i in range(9)], [f"p{g + 1}x{i}" for i in range(9)]
        for k in range(size):
            w = passage[0] + words[g] + passage[1]
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(10, 48)] = f"y{rng.randrange(10**6)}"
            docs.append((g * 100 + k, " ".join(w)))
    return docs


@pytest.mark.parametrize("most", [256, 1])
def test_clusters_that_meet_by_a_passage_only_are_not_compared(spark, monkeypatch, most):
    """Of a class in several blocks only clusters with enough segments in common go on, however few clusters are counted in pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCUMENTS", 7)
    monkeypatch.setattr(jaccard_join, "OFTEN", 10**6)  # no passage is left out of the segments
    monkeypatch.setattr(jaccard_join, "MET_CLUSTERS", most)
    went, meeting = [], jaccard_join._meeting_blocks

    def counted(dealt, *rest):
        went.extend(r.cluster for r in dealt.select("cluster", "doc").collect())
        return meeting(dealt, *rest)

    monkeypatch.setattr(jaccard_join, "_meeting_blocks", counted)
    docs = _chained(random.Random(6))
    found = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    expected = brute_components(docs, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected
    if most == 256:
        assert len(set(went)) < len({c for _, c in expected.values()})


def test_linked_sets_have_the_keys_that_they_need():
    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    for percent in (60, 80, 85):
        segments = jaccard_join.Segments(percent, common)
        for _ in range(400):
            own = rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64) * np.uint64(2)
            a = np.unique(np.concatenate([own[: int(rng.integers(0, len(own) + 1))], rng.choice(common, int(rng.integers(1, 40)))]))
            b = a
            while True:
                other = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64)))
                both = len(np.intersect1d(a, other))
                if 100 * both < percent * (len(a) + len(other) - both):
                    break
                b = other
            levels = {j: (keys, need) for j, keys, need in segments.by_level(b)}
            met = [(len(np.intersect1d(keys, levels[j][0])), min(need, levels[j][1])) for j, keys, need in segments.by_level(a) if j in levels]
            assert any(n >= need >= 1 for n, need in met)
