import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import rewrites, sync, versions
from tessera.sources import chunks, pages
from tessera.streaming import events


def cut(text, most=60, least=20, overlap=10):
    return chunks.Splitter(most, least, overlap)(text)


def bare(text):
    return "".join(c for c in text if not c.isspace() and c not in "。！？.!?，;")


def test_pieces_lose_nothing_but_separators():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "longerword ", "end. ", "\n", "\n\n", "why? ", "句。", "; "]) for _ in range(rng.randrange(20, 120))).strip()
        found = cut(text)
        assert all(found) and bare("".join(found)) == bare(text)


def test_strong_separators_come_first():
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 30
    assert cut(text) == ["a" * 30, "b" * 30, "c" * 30]
    assert cut("a" * 30 + "\n\n" + "c" * 10 + "\n\n" + "d" * 45 + "\n\n" + "e") == ["a" * 30 + "\n\n" + "c" * 10, "d" * 45 + "\n\n" + "e"]
    assert cut("x" * 130) == ["x" * 60, "x" * 60, "x" * 30]


def test_chunks_under_headings(spark):
    text = "intro\n# One\nfirst\n## Sub ##\nsecond\n### Deep\nthird\n## Other\nfourth\n# Two\nfifth"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, "")], "document_id long, text string")
    got = {(r.document_id, r.position): r for r in chunks.chunks(df).collect()}
    paths = [list(got[1, i].heading_path) for i in range(6)]
    assert paths == [[], ["One"], ["One", "Sub"], ["One", "Sub", "Deep"], ["One", "Other"], ["Two"]]
    assert (got[1, 2].start_line, got[1, 2].end_line, got[1, 2].content) == (4, 5, "## Sub ##\nsecond")
    assert (2, 0) in got and not {d for d, _ in got} & {3, 4}
    again = {r.chunk_id for r in chunks.chunks(df.repartition(7)).collect()}
    assert again == {r.chunk_id for r in got.values()}


def test_pages_and_kinds(spark):
    html = "<html><head><title>A  title</title><style>x{}</style></head><body><script>no()</script><h1>Head</h1><p>One &amp; two</p><p>three</p></body></html>"
    got = pages.web_pages(spark.createDataFrame([(1, "https://e.org/", html), (2, "https://e.org/2", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert got[0].content == "# A title\n\n来源: https://e.org/\n\nHead One & two three\n"
    assert got[1].title == "https://e.org/2"
    files = [("a.md", "", b"# x"), ("b.txt", "", b"plain"), ("c.pdf", "", b"junk"), ("d.txt", "", b"\x00\x01"), ("e.bin", "", b"%PDF-1.7"), ("f.bin", "", b"x"), ("g", "text/plain", b"ok")]
    df = spark.createDataFrame([(n, m, bytearray(c)) for n, m, c in files], "name string, mime string, content binary")
    kinds = {r["name"]: r["kind"] for r in df.select("name", pages.kind(F.col("name"), F.col("mime"), F.col("content")).alias("kind")).collect()}
    assert kinds == {"a.md": "markdown", "b.txt": "text", "c.pdf": None, "d.txt": None, "e.bin": "pdf", "f.bin": None, "g": "text"}


def test_text_files_below_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_bytes("﻿# T\r\nx".encode())
    (tmp_path / "b.csv").write_text("no")
    got = pages.files(spark, str(tmp_path)).collect()
    assert [(r["kind"], r.text) for r in got] == [("markdown", "# T\nx")]


def test_exact_terms_of_whole_queries(spark):
    q = spark.createDataFrame([(1, "ERR_TIMEOUT"), (2, "notes.md"), (3, "\"two words\""), (4, "see \"two words\" of sqlite in foo.bar")], "query_id long, text string")
    got = {(r.query_id, r.term): (r.kind, r.weight) for r in rewrites.exact_terms(q).collect()}
    assert got[1, "ERR_TIMEOUT"] == ("error_code", 2.0) and got[2, "notes.md"] == ("filename", 2.0) and got[3, "two words"] == ("exact_phrase", 1.6)
    assert got[4, "two words"][0] == "exact_phrase" and got[4, "sqlite"][0] == "product" and got[4, "foo.bar"][0] == "symbol"


def test_variants(spark):
    q = spark.createDataFrame([(1, "how to rank results"), (2, "notes.md"), (3, " ")], "query_id long, text string")
    got = {}
    for r in rewrites.variants(q).orderBy("query_id", "variant").collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert got[1][0] == "how to rank results" and len(got[1]) == 3 and got[1][2] == "results"
    assert got[2] == ["notes.md"] and 3 not in got


def test_incomplete_listings_remove_nothing(spark):
    items = spark.createDataFrame([(1, "a", False), (2, "b", True)], "item_id long, hash string, tombstone boolean")
    listing = spark.createDataFrame([(2, "b"), (3, "c")], "item_id long, hash string")
    act = lambda complete: {r.item_id: r.action for r in sync.snapshot_actions(listing, items, complete).collect()}
    assert act(True) == {1: "tombstone", 2: "reactivate", 3: "import"}
    assert act(False) == {2: "reactivate", 3: "import"}


def test_package_checks(spark):
    manifest = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, size long, sha256 string")
    files = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("d", 1, "q")], "path string, size long, sha256 string")
    assert {r.path: r.error for r in versions.verify_package(manifest, files).collect()} == {"b": "size", "c": "missing", "d": "extra"}


def test_job_states_over_a_stream(spark, tmp_path):
    """Retries, a replayed and a late event, a claim after the end, and a lease (of job 2) that runs out as others go on."""
    first = [(1, 0, "enqueue", 0), (1, 1, "claim", 1), (1, 2, "fail", 2), (2, 0, "enqueue", 0), (4, 0, "claim", 1)]
    second = [(1, 3, "claim", 3), (1, 4, "complete", 4), (2, 1, "claim", 3), (4, 1, "complete", 4)]
    third = [(3, 1, "cancel", 5), (1, 4, "complete", 4), (4, 2, "claim", 6), (1, 1, "fail", 1), (5, 0, "claim", 40)]
    for k, rows in enumerate([first, second, third]):
        df = spark.createDataFrame(rows, "job_id long, seq long, event string, minute int")
        df.select("job_id", "seq", "event", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60).alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("job_id long, seq long, event string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    writer = events.job_states(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", f"{tmp_path}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    seen = {}
    for r in spark.table("jobs").collect():
        seen.setdefault(r.job_id, []).append((r.status, r.attempts, r.late))
    assert seen[1] == [("queued", 1, 0), ("completed", 2, 0), ("completed", 2, 2)]
    assert seen[2] == [("queued", 0, 0), ("running", 1, 0), ("queued", 1, 0)]
    assert seen[3] == [("cancelled", 0, 0)] and seen[4] == [("running", 1, 0), ("completed", 1, 0), ("completed", 1, 0)] and seen[5] == [("running", 1, 0)]


@pytest.mark.parametrize("happened,ends", [
    (["claim", "fail"], ("queued", 1)), (["claim", "fail", "claim", "fail", "claim", "fail"], ("failed", 3)), (["claim", "complete", "claim"], ("completed", 1)),
    (["cancel", "claim"], ("cancelled", 0)), (["claim", "complete", "requeue", "claim"], ("running", 1)), (["claim", "defer"], ("queued", 0)), (["unknown"], ("queued", 0)),
])
def test_steps_of_a_job(happened, ends):
    status, attempts = "queued", 0
    for event in happened:
        status, attempts = events._advance(status, attempts, event, 3)
    assert (status, attempts) == ends


def test_oversized_pages(spark):
    text = "\n\n".join(["a" * 5, "b" * 5, "c" * 30, "d" * 4, "e" * 4])
    df = spark.createDataFrame([(text,), ("short",), ("\n\n\n" + "f" * 30,)], "t string")
    assert [r[0] for r in df.select(chunks.oversized_pages(F.col("t"), 20)).collect()] == [["a" * 5 + "\n\n" + "b" * 5, "c" * 30, "d" * 4 + "\n\n" + "e" * 4], ["short"], ["f" * 30]]


def test_chunks_are_made_where_the_text_is(spark):
    """Nothing of a text is shuffled, and rows that share an id are documents of their own."""
    rows = [(i, f"# H{i}\nsome text here\n## sub\nmore text") for i in range(20)]
    df = spark.createDataFrame([*rows, rows[0]], "document_id long, text string").repartition(8)
    found = chunks.chunks(df)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.document_id, r.position, r.heading_path, r.content) for r in found.collect()]
    assert sorted(got) == sorted((i, p, h[: p + 1], c) for i, _ in [*rows, rows[0]] for h in [[f"H{i}", "sub"]] for p, c in enumerate([f"# H{i}\nsome text here", "## sub\nmore text"]))
