"""Builds of an index: activation, pruning, rollback, upserts, copies and cascades.

A manifest of builds is small and is rewritten as a whole; the data of builds are
never updated in place. What becomes active or goes away is decided by windows over
the manifest and applied by semi and anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn


def activated(builds: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest after the builds in ``new`` (build_id) have become the active ones of their documents."""
    chosen = builds.join(new.select("build_id"), "build_id", "left_semi").select("document_id", F.col("build_id").alias("_new"))
    joined = builds.join(chosen, "document_id", "left")
    now = F.col("build_id") == F.col("_new")
    status = F.when(now, "ready").when(F.col("_new").isNotNull() & F.col("is_active"), "superseded").otherwise(F.col("status"))
    active = F.when(F.col("_new").isNotNull(), now).otherwise(F.col("is_active"))
    return joined.withColumn("status", status).withColumn("is_active", active).drop("_new").select(*builds.columns)


def _newest_superseded(builds: DataFrame) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(F.coalesce("activated_at", "created_at").desc(), F.col("build_id").desc())
    return builds.filter("status = 'superseded'").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def prunable(builds: DataFrame) -> DataFrame:
    """Failed builds and superseded ones but the newest of each document; active ones stay."""
    old = builds.filter("not is_active and status in ('failed', 'superseded')")
    return old.join(_newest_superseded(builds).select("build_id"), "build_id", "left_anti")


def rollback_targets(builds: DataFrame) -> DataFrame:
    """document_id and the build to go back to."""
    return _newest_superseded(builds).select("document_id", "build_id")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of the rows of a key, the last in ``order``."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def first_copies(rows: DataFrame, content: str, created: str, key: str) -> DataFrame:
    """Of rows with equal content the earliest, with the content's hash and how many rows have it.

    One pre-aggregated row for each hash names the row that stays; they meet by its key
    and hash, so a frequent content stays spread.
    """
    hashed = rows.withColumn("hash", F.sha2(F.col(content), 256))
    keep = hashed.groupBy("hash").agg(F.min(F.struct(created, key)).alias("_keep"), F.count("*").alias("copies"))
    return hashed.join(keep.select("hash", F.col(f"_keep.{key}").alias(key), "copies"), [key, "hash"])


def coalesced_vectors(chunks: DataFrame, builds: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks with the vector of the active build, or the legacy one, without those that have neither."""
    active = builds.filter("is_active and status = 'ready'").select("document_id", "build_id")
    joined = chunks.join(active, "document_id", "left").join(entries.withColumnRenamed("vector", "_new"), ["build_id", "chunk_id"], "left")
    return joined.withColumn("vector", F.coalesce("_new", "vector")).drop("_new").filter("vector is not null")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(key), key, "left_semi")


def verify_package(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and error of every file that is missing, extra, of another size or of another hash."""
    joined = manifest.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha")).join(files, "path", "full_outer")
    error = F.when(F.col("sha256").isNull(), "missing").when(F.col("_sha").isNull(), "extra").when(F.col("size") != F.col("_size"), "size").when(F.col("sha256") != F.col("_sha"), "hash")
    return joined.select("path", error.alias("error")).filter("error is not null")


def saved_conversations(stored: DataFrame, saves: DataFrame) -> DataFrame:
    """Messages after saves: a save with messages (even none) replaces a conversation's, one without (null) leaves them."""
    last = latest(saves.filter("messages is not null"), ["conv_id"], ["saved_at"])
    kept = stored.join(last.select("conv_id"), "conv_id", "left_anti")
    return kept.select("conv_id", "turn", "role", "text").unionByName(last.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text"))


def committed(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks after a commit: the documents of ``incoming`` have its chunks and none of their old ones, the others stay."""
    kept = chunks.join(incoming.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(incoming.select(*kept.columns))


def posted(builds: DataFrame, vectors: DataFrame, dimensions: int, model: str, now: int) -> DataFrame:
    """The manifest after vectors (document_id, chunk_id, vector) were posted: a new build for each document.

    A build all of whose vectors are sound becomes active, and what it supersedes is
    pruned but for the newest; another build fails and changes nothing else. New builds
    have the ids after the largest.
    """
    sound = F.bool_and((F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    grouped = vectors.filter("document_id is not null").groupBy("document_id").agg(F.coalesce(sound, F.lit(False)).alias("_sound"))
    last = builds.groupBy("document_id").agg(F.max("build_id").alias("_last"))
    made = grouped.join(last, "document_id", "left").select(
        "document_id", (F.coalesce("_last", F.col("document_id") * 10) + 1).alias("build_id"), F.when(F.col("_sound"), "running").otherwise("failed").alias("status"), F.lit(False).alias("is_active"),
        F.lit(now).cast("long").alias("created_at"), F.when(F.col("_sound"), F.lit(now).cast("long")).alias("activated_at"), F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"),
    )
    after = activated(builds.unionByName(made.select(*builds.columns)), made.filter("status = 'running'"))
    touched = after.join(made.filter("status = 'running'").select("document_id"), "document_id", "left_semi")
    return after.join(prunable(touched).select("build_id"), "build_id", "left_anti")


def active_versions(builds: DataFrame, chunk_sets: DataFrame, processing: DataFrame) -> DataFrame:
    """document_id, revision_id, processing_build_id of each document's active keyword build; ``legacy`` where no processing build is known."""
    sets = builds.filter("is_active and status = 'ready'").select("document_id", "chunk_set_id").join(chunk_sets, "chunk_set_id").filter("revision_id is not null")
    active = processing.filter("is_active").select("revision_id", F.col("build_id").alias("_build"))
    return sets.join(active, "revision_id", "left").select("document_id", "revision_id", F.coalesce("processing_build_id", "_build", F.lit("legacy")).alias("processing_build_id"))


def package_manifest(files: DataFrame) -> DataFrame:
    """path, size (bytes) and sha256 of files (path, content), as they leave: without secrets."""
    content = files.select("path", F.encode(fn.redacted(F.coalesce("content", F.lit(""))), "UTF-8").alias("_bytes"))
    return content.select("path", F.octet_length("_bytes").cast("long").alias("size"), F.sha2("_bytes", 256).alias("sha256"))
