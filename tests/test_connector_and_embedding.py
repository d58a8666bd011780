"""The folder connector as a batch and as a stream, and the embed job."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.functions import text as fn
from tessera.operators import embedding_job
from tessera.sources import folder

BODIES = {
    "a.md": b"\xef\xbb\xbf# Title\r\n\r\nbody\r\n", "sub/b.txt": "été".encode(), "sub/deep/c.markdown": b"", "d.pdf": b"%PDF-1.7 x", "e.md": b"%PDF-1.4 hidden", "f.txt": b"\x00\x01binary", "g.pdf": b"no pdf", "skip.bin": b"text", "H.TXT": b" upper \n",
}


def put(root, files, at=None):
    for i, (name, body) in enumerate(files.items()):
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body)
        if at is not None:
            os.utime(path, (at + i, at + i))


def test_batch(spark, tmp_path):
    put(tmp_path, BODIES)
    folder.register(spark)
    rows = spark.read.format("text_folder").option("maxPartitionBytes", "20").load(f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() > 2
    assert {r.path: bytes(r.content) for r in rows.collect()} == {p: b for p, b in BODIES.items() if not p.endswith(".bin")}
    found = {r.path: (r.kind, r.text) for r in folder.documents(rows).collect()}
    assert found == {"a.md": ("markdown", "# Title\n\nbody"), "sub/b.txt": ("text", "été"), "sub/deep/c.markdown": ("markdown", ""), "d.pdf": ("pdf", None), "e.md": ("pdf", None), "H.TXT": ("text", "upper")}
    assert spark.read.format("text_folder").load(f"file://{tmp_path}/absent").count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("text_folder").load().count()


def test_a_stream_goes_on_behind_its_cursor(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.register(spark)

    def drain():
        stream = spark.readStream.format("text_folder").load(f"file://{root}")
        query = folder.documents(stream).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        query.stop()
        return sorted((r.path, r.text) for r in spark.read.parquet(out).collect())

    now = time.time() - 1000
    put(root, {"a.md": b"one", "b.md": b"two", "c/d.txt": b"three"}, now)
    assert drain() == [("a.md", "one"), ("b.md", "two"), ("c/d.txt", "three")]
    assert drain() == [("a.md", "one"), ("b.md", "two"), ("c/d.txt", "three")]  # nothing comes twice
    put(root, {"a.md": b"changed", "e.md": b"new"}, now + 500)
    assert drain() == [("a.md", "changed"), ("a.md", "one"), ("b.md", "two"), ("c/d.txt", "three"), ("e.md", "new")]


def test_the_stand_in_is_that_of_the_columns(spark):
    texts = ["alpha beta Beta", "été à l'École", "反向代理 node.js", "😀 x1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.explode(fn.tokens(F.col("text"))).alias("term"))
    bins = {}
    for r in embedding.term_bins(rows, "id").collect():
        bins.setdefault(r.id, np.zeros(embedding.DIMENSION))[r.bin] = r.weight
    for i, vector in enumerate(embedding_job.HashedTerms()(texts)):
        assert np.allclose(vector, bins[i])
    assert embedding_job.HashedTerms(refused="beta")(["beta", "", "?!"]) == ["INPUT_REFUSED", "INPUT_EMPTY", "INPUT_EMPTY"]


def test_a_document_with_an_error_keeps_its_build(spark):
    def make():
        def embed(texts):  # fails as a whole on any batch with a text that it doesn't like
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [np.ones(3) for _ in texts]

        return embed

    chunks = spark.createDataFrame([(1, 10, "fine"), (1, 11, "fine too"), (2, 20, "fine"), (2, 21, "bad"), (3, 30, "bad"), (4, 40, "fine")], "document_id long, chunk_id long, content string")
    builds = spark.createDataFrame(
        [(1, 11, "superseded", False, 1, 1), (1, 12, "ready", True, 2, 2), (2, 21, "ready", True, 1, 1), (5, 51, "ready", True, 1, 1)], "document_id long, build_id long, status string, is_active boolean, created_at long, activated_at long"
    ).withColumns({"model": F.lit("m"), "dimensions": F.lit(3)})
    after, vectors, errors = embedding_job.run(chunks, builds, make, 3, "m", 9)
    held = {(r.document_id, r.build_id): (r.status, r.is_active) for r in after.collect()}
    assert held == {
        (1, 12): ("superseded", False), (1, 13): ("ready", True), (2, 21): ("ready", True), (2, 22): ("failed", False), (3, 31): ("failed", False), (4, 41): ("ready", True), (5, 51): ("ready", True),
    }
    assert sorted((r.build_id, r.chunk_id, len(r.vector)) for r in vectors.collect()) == [(13, 10, 3), (13, 11, 3), (41, 40, 3)]
    assert sorted((r.chunk_id, r.error) for r in errors.collect()) == [(21, "EMBEDDER_FAILED: RuntimeError"), (30, "EMBEDDER_FAILED: RuntimeError")]
