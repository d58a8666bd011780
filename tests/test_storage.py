"""Intermediate tables in the shared folder."""

import os

from tessera.plans import storage


def test_tables_are_written_read_and_released(spark):
    root = storage.shared_root(spark).split(":")[-1]
    kept, gone = (storage.materialise(spark.range(5), label) for label in ("kept", "gone"))
    own = os.path.join("/" + root.lstrip("/"), "tessera", spark.sparkContext.applicationId)
    assert kept.count() == 5 and {x.split("-")[0] for x in os.listdir(own)} >= {"kept", "gone"}
    storage.release(gone)
    left = {x.split("-")[0] for x in os.listdir(own)}
    assert "kept" in left and "gone" not in left
    other = f"{root}/elsewhere"
    spark.range(3).write.parquet("file:///" + other.lstrip("/"))
    storage.release(spark.read.parquet("file:///" + other.lstrip("/")))  # not one of ours: it stays
    assert spark.read.parquet("file:///" + other.lstrip("/")).count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    try:
        storage.shared_root(Cluster)
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a temporary folder on a cluster")
