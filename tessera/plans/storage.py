"""Intermediate tables in the folder that driver and executors share.

Writing a table cuts the lineage: a lost executor costs a re-read, not a
recomputation of everything before it.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a
    cluster session is refused, as its machines would not see that folder.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the whole cluster shares")
    root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def _own_folder(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_root(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a folder of this application, as a URI, for files that Spark's writers don't make."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def kept_folder(spark: SparkSession, label: str, *paths: str) -> str:
    """A folder of this application for what is made of the tables at ``paths``: the same as long as their files have the same names, sizes and times."""
    seen = [label]
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        seen += [path, *sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in store.listStatus(at))]
    return f"{_own_folder(spark)}/{label}-{hashlib.sha256(chr(10).join(seen).encode()).hexdigest()[:24]}"


def kept(spark: SparkSession, folder: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gave when it was written to this folder, which happens once; a write that broke off is done again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_each(frames: Iterable[DataFrame], label: str, spark: SparkSession, schema: str) -> DataFrame:
    """Write one frame after another into one folder and read them as one; without any, an empty table of this schema."""
    path, empty = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}", True
    for df in frames:
        df.write.mode("append").parquet(path)
        empty = False
    return spark.createDataFrame([], schema) if empty else spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise`, once all that reads it has been written."""
    spark = df.sparkSession
    own = _own_folder(spark).split(":")[-1].lstrip("/")
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.split(":")[-1].lstrip("/").startswith(own + "/"):
            _delete(spark, folder)


def release_all(spark: SparkSession) -> None:
    """Delete all tables of this application, once its results have been written."""
    _delete(spark, _own_folder(spark))
