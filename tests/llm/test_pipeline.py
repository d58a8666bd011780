import random
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import catalogue


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A few documents with copies, near copies, letterless texts, nulls and two sources."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = [rng.choice(["ka", "lo", "mi"]) + str(rng.randrange(900)) + rng.choice(["ra", "to"]) for _ in range(rng.randrange(30, 90))]
        rows.append((i, " ".join(words), "en", "s" + str(i % 3)))
    rows += [(100 + i, rows[i][1].upper(), "en", "s9") for i in range(5)]  # exact copies
    rows += [(200 + i, " ".join(["changed", *rows[10 + i][1].split()]), "fr", None) for i in range(5)]  # near copies
    rows += [(300, None, None, "s1"), (301, "12 34 ??", "en", "s1"), (302, "", "en", "s1")]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((name, docs.collect()))
        if k < 4:
            assert docs.columns == columns
    ids = [sorted(r.doc_id for r in rows) for _, rows in kept]
    assert ids[0] == [*range(60), *range(100, 105), *range(200, 205)]
    assert ids[1] == [*range(5, 60), *range(100, 105), *range(200, 205)]  # of equal texts the largest id
    assert ids[2] == [*range(5, 60), *range(100, 105)]  # of near copies the smallest id
    copies = Counter(ids[3])
    assert set(copies) <= set(ids[2]) and max(copies.values()) <= 3
    pieces = kept[4][1]
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    assert all(sum(r.length for r in pieces if r.sequence_id == s) <= 4096 for s in {r.sequence_id for r in pieces})


def test_run_applies_all_stages(spark, sf_dir):
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(corpus_pipeline.run(spark, sf_dir).columns)


def test_stages_name_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "best_fit_packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.queries()) == list(range(1, 14))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, size int, component_id string"


def run_stages(spark, docs, folder, last=4):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:last]):
        stage(spark, docs, "").write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_clashing_names_repeated_rows_and_ids(spark, tmp_path):
    prose = [" ".join(f"w{(i * 37 + k * k) % 997}x" for k in range(60)) for i in range(8)]
    rows = [(1, prose[0]), (1, prose[0]), (1, prose[1]), (9, prose[0]), (None, prose[0]), (None, prose[2]), (5, prose[3]), (6, "12 34"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 3, 4, "c") for i, t in rows], SCHEMA)
    stages = run_stages(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in stages)
    left = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    assert left(stages[0]) == sorted([r for r in rows if r[0] not in (6, 7)], key=str)
    assert left(stages[1]) == sorted([(1, prose[1]), (9, prose[0]), (None, prose[2]), (5, prose[3])], key=str)  # of each text one row, the largest id
    assert left(stages[2]) == left(stages[1])
    assert {(r.score, r.lang_pred, r.size, r.component_id) for r in stages[3].collect()} <= {("x", 3, 4, "c")}


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    stages = run_stages(spark, docs, tmp_path, 5)
    assert [d.count() for d in stages] == [0] * 5 and stages[3].columns == docs.columns
