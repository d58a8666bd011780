import hashlib
import random
from collections import defaultdict

import pytest

from tessera.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows):
    """Rows (doc_id, text, source) with further columns, one of them with a clashing name."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], SCHEMA)


def test_index_inserts_deletes_and_grows():
    index, rng, live = exact_dedup.CuckooIndex(2), random.Random(1), {}
    for step in range(4000):
        digest = hashlib.sha256(str(rng.randrange(900)).encode()).digest()
        if digest in live and rng.random() < 0.4:
            assert index.delete(digest)
            del live[digest]
        else:
            index.merge(digest, step, 1)
            live[digest] = (step, live.get(digest, (0, 0))[1] + 1)
    assert {d: (i, n) for d, i, n in index.live()} == live
    assert len(index) == len(live) and index.mask > 1
    assert all(index.find(d)[1] == i for d, (i, _) in live.items())
    assert index.find(hashlib.sha256(b"absent").digest()) is None and not index.delete(hashlib.sha256(b"absent").digest())


def test_index_survives_one_fingerprint_for_all():
    index = exact_dedup.CuckooIndex(2)
    digests = [bytes([i]) + bytes(7) + b"\x05\x00" + bytes([i]) * 22 for i in range(1, 40)]
    for i, d in enumerate(digests):
        index.merge(d, i, 1)
    assert sorted(x[1] for x in index.live()) == list(range(39))


def test_exact_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TASK_RECORDS", 5)
    rng = random.Random(2)
    texts = ["Hello World", "hello world", "HELLO\nworld", "é É", "É é", "", None, "x" * 70_000]
    rows = [(i, rng.choice(texts), None) for i in rng.sample(range(1000), 120)] + [(None, "null id", "a"), (None, "null id", "a"), (5000, "twice", "b"), (5000, "twice", "b")]
    got = exact_dedup.exact_dedup(documents(spark, rows).repartition(5)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    expected = sorted(
        (i is None, i or 0, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), i == max((x for x in groups[low(t)] if x is not None), default=None), hashlib.sha256(low(t).encode()).hexdigest())
        for i, t, _ in rows
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == expected


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "a", None), (2, "A", None), (3, "b", None), (3, "b", None), (4, None, None), (5, "", None)]
    kept = exact_dedup.without_copies(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]


def test_only_rows_that_the_index_rejects_go(spark):
    rows = [(5, "a", None), (5, "b", None), (9, "A", None), (None, "c", None), (None, "b", None), (None, "C", None), (7, "É d", None), (7, "é d", None), (7, "É D", None), (8, "e", None)]
    kept = sorted((r.doc_id or 0, low(r.text)) for r in exact_dedup.without_copies(documents(spark, rows)).collect())
    assert kept == [(0, "c"), (5, "b"), (7, "É d"), (7, "é d"), (8, "e"), (9, "a")]
    rng = random.Random(4)
    rows = [(rng.randrange(20), rng.choice("abcdefghABCDEFGH") + rng.choice(["", "1", "2"]), None) for _ in range(60)]
    last = {low(t): max(i for i, x, _ in rows if low(x) == low(t)) for _, t, _ in rows}
    assert sorted((low(r.text), r.doc_id) for r in exact_dedup.without_copies(documents(spark, rows)).collect()) == sorted(last.items())


def test_empty_tables(spark):
    empty = documents(spark, [(1, "a", "s")]).filter("doc_id > 1")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.without_copies(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.repeat(empty).count() == 0


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def test_mix_matches_repeated_sharing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(int(rng.paretovariate(0.7)) % 900)), rng.choice(["a", "b", "B", "ß", None, "hot", "hot", "hot", "hot"])) for i in range(600)]
    rows += [(9001, None, "empty"), (9002, " \t\n", "empty"), (None, "one two", "a")]
    got = mixing.mix(documents(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.size * r.copies and r.taken <= 3 * r.size
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark, rows).repartition(7)).collect()))


def test_taken_words_come_near_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(50, 150)), "abcd"[i % 4]) for i in range(4000)]
    taken, target = defaultdict(int), {}
    for r in mixing.mix(documents(spark, rows)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.06 * target[s] for s in target)


def test_repeat_gives_as_many_rows_as_copies(spark):
    rows = [(i, "a b c", "s" + str(i % 3)) for i in range(90)]
    docs = documents(spark, rows)
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("ids", ["none", "one", "half"])
@pytest.mark.parametrize("few", [100_000, 0])
def test_mix_comes_near_its_targets_whatever_the_ids(spark, ids, few, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_GROUPS", few)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    doc_id = {"none": lambda i: None, "one": lambda i: 7, "half": lambda i: i if i % 2 else None}[ids]
    for text in (lambda i: f"w{i} " * 10, lambda i: "same " * 10):  # told apart by their texts, or by nothing
        rows = [(doc_id(i), text(i), "abc"[i % 3]) for i in range(300)]
        got = mixing.mix(documents(spark, rows).repartition(5)).collect()
        for source, target in zip("abc", (500, 1000, 1500)):
            mine = [r for r in got if r.source == source]
            assert {round(r.target) for r in mine} == {target}
            assert abs(sum(r.taken for r in mine) - target) <= (10 if text(0) == text(1) and ids != "half" else 200)
            assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in mine)
        again = mixing.mix(documents(spark, rows[::-1]).repartition(3)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeat_of_equal_rows(spark):
    rows = [(None, "same " * 10, "abc"[i % 3]) for i in range(300)] + [(5, "x" * 70_000, "a"), (5, "x" * 70_000, "a")]
    docs = documents(spark, rows).repartition(4)
    assert mixing.repeat(docs).count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.repeat(docs).columns == docs.columns
