"""Change capture of document sources, visibility, jobs and quotas, as joins of snapshots and folds of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Documents in these states can be searched.
SEARCHABLE = ("ready", "embedding", "indexed", "error")


def snapshot_actions(listing: DataFrame, items: DataFrame, complete: bool = True) -> DataFrame:
    """item_id and action: import, update, unchanged, reactivate, or tombstone for items that a complete listing no longer has."""
    new = listing.select("item_id", F.col("hash").alias("_hash"), F.lit(True).alias("_listed"))
    joined = new.join(items, "item_id", "full_outer")
    action = (
        F.when(F.col("_listed").isNull(), F.when(F.lit(complete) & ~F.col("tombstone"), "tombstone"))
        .when(F.col("tombstone").isNull(), "import")
        .when(F.col("tombstone"), "reactivate")
        .when(F.col("hash").eqNullSafe(F.col("_hash")), "unchanged")
        .otherwise("update")
    )
    return joined.select("item_id", action.alias("action")).filter("action is not null")


def hidden_documents(items: DataFrame) -> DataFrame:
    """Documents that sources manage, none of whose items is active."""
    managed = items.filter("document_id is not null")
    return managed.groupBy("document_id").agg(F.max((~F.col("tombstone")).cast("int")).alias("active")).filter("active = 0").select("document_id")


def merged_items(items: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Items after changes: a field in ``set_mask`` takes the new value, even null; others keep theirs."""
    new = changes.select("item_id", "set_mask", *[F.col(c).alias(f"_{c}") for c in fields])
    value = lambda c: F.when(F.array_contains("set_mask", c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return items.join(new, "item_id", "full_outer").select("item_id", *[value(c) for c in fields])


def scope_filter(chunks: DataFrame, documents: DataFrame, hidden: DataFrame, library_all: bool = True, document_ids: DataFrame | None = None) -> DataFrame:
    """Chunks of searchable, visible documents in scope."""
    seen = documents.filter(F.col("status").isin(*SEARCHABLE)).select("document_id").join(hidden.select("document_id"), "document_id", "left_anti")
    if not library_all:
        if document_ids is None:
            return chunks.limit(0)
        seen = seen.join(document_ids.select("document_id"), "document_id", "left_semi")
    return chunks.join(seen, "document_id", "left_semi")


def missing_embeddings(documents: DataFrame, builds: DataFrame) -> DataFrame:
    """Searchable documents without an active ready vector build, each with the key of its job."""
    done = builds.filter("is_active and status = 'ready'").select("document_id")
    waiting = documents.filter(F.col("status").isin(*SEARCHABLE)).join(done, "document_id", "left_anti")
    return waiting.select("document_id", F.concat(F.lit("embed_document:"), F.col("document_id").cast("string")).alias("idempotency_key"))


def stale(documents: DataFrame, now: str, minutes: int = 20) -> DataFrame:
    """Documents whose embedding began more than ``minutes`` ago become errors."""
    old = (F.col("status") == "embedding") & (F.col("updated_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes"))
    return documents.withColumn("status", F.when(old, "error").otherwise(F.col("status")))


def within_quota(bindings: DataFrame, spaces: DataFrame, now: str) -> DataFrame:
    """Bindings of spaces that haven't expired, the oldest up to each space's quota."""
    alive = spaces.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp_ntz")))
    order = Window.partitionBy("space_id").orderBy("bound_at", "document_id")
    ranked = bindings.join(alive.select("space_id", "quota"), "space_id").withColumn("_n", F.row_number().over(order))
    return ranked.filter(F.col("_n") <= F.col("quota")).select("space_id", "document_id", "bound_at")


def folded_jobs(events: DataFrame, now: str, most_attempts: int = 3) -> DataFrame:
    """State of each job from its events (job_id, seq, event, at, lease_until).

    Events: enqueue, claim, complete, fail, defer, cancel, requeue. Attempts are
    claims since the last requeue, less those that a defer gave back; a failure is
    final at ``most_attempts``; a running job whose lease has run out is queued again.
    """
    job = Window.partitionBy("job_id")
    since = F.max(F.when(F.col("event") == "requeue", F.col("seq")).otherwise(F.lit(-1))).over(job)
    marked = events.withColumn("_since", since)
    recent = F.col("seq") > F.col("_since")
    last = F.max_by(F.struct("event", "at", "lease_until"), F.col("seq"))
    folded = marked.groupBy("job_id").agg(
        last.alias("last"),
        F.count_if(recent & (F.col("event") == "claim")).alias("claims"),
        F.count_if(recent & (F.col("event") == "defer")).alias("defers"),
    )
    attempts = F.greatest(F.col("claims") - F.col("defers"), F.lit(0))
    event = F.col("last.event")
    status = (
        F.when(event == "complete", "completed")
        .when(event == "cancel", "cancelled")
        .when(event == "fail", F.when(attempts >= most_attempts, "failed").otherwise("queued"))
        .when((event == "claim") & (F.col("last.lease_until") >= F.lit(now).cast("timestamp_ntz")), "running")
        .otherwise("queued")
    )
    return folded.select("job_id", status.alias("status"), attempts.alias("attempts"), F.col("last.at").alias("updated_at"))


def document_view(status: Column, chunk_count: Column, semantic_enabled: bool = True) -> dict[str, Column]:
    """What a document can be used for (content) and how far its vectors are (semantic)."""
    early = status.isin("awaiting_chunks", "stored", "processing")
    content = F.when(status == "processing_error", "unavailable").when(early, "processing").when(F.coalesce(chunk_count, F.lit(0)) == 0, "unavailable").otherwise("usable")
    semantic = F.when(F.lit(not semantic_enabled), "off").when(content != "usable", "pending").when(status == "error", "failed").when(status == "indexed", "ready").otherwise("pending")
    return {"content": content, "semantic": semantic}


# States that a document may be set to, and states of jobs that aren't over.
STATES = ("awaiting_chunks", "stored", "processing", "processing_error", "ready", "embedding", "indexed", "error")
ACTIVE_JOBS = ("queued", "running", "retry_wait")


def status_writes(documents: DataFrame, writes: DataFrame) -> DataFrame:
    """Documents after writes (document_id, status), one for each document at most; a status that isn't known changes nothing."""
    sound = writes.filter(F.col("status").isin(*STATES)).select("document_id", F.col("status").alias("_status"))
    return documents.join(sound, "document_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def next_jobs(jobs: DataFrame, now: str, *keys: str) -> DataFrame:
    """The job that each of ``keys`` takes next: of those that wait and are due, the one due first, then the oldest, then the smallest job_id."""
    due = jobs.filter(F.col("status").isin("queued", "retry_wait") & (F.col("available_at") <= F.lit(now).cast("timestamp_ntz")))
    return due.groupBy(*keys).agg(F.min(F.struct("available_at", "created_at", "job_id")).alias("_first")).select(*keys, "_first.job_id", "_first.available_at")


def split_jobs(jobs: DataFrame) -> DataFrame:
    """``jobs`` with active: whether they aren't over."""
    return jobs.withColumn("active", F.coalesce(F.col("status").isin(*ACTIVE_JOBS), F.lit(False)))


def named_jobs(jobs: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """job_id, namespace, document_id and document_name of jobs whose JSON ``payload`` names a document or a conversation's file."""
    document = F.get_json_object("payload", "$.documentId")
    namespace = F.when(F.get_json_object("payload", "$.namespace") == "conversation", "conversation").otherwise("library")
    names = documents.select(F.lit("library").alias("namespace"), F.col("document_id").cast("string"), F.col("name").alias("document_name")).unionByName(
        files.select(F.lit("conversation").alias("namespace"), F.col("document_id").cast("string"), F.col("name").alias("document_name"))
    )
    return jobs.select("job_id", namespace.alias("namespace"), document.alias("document_id")).join(names, ["namespace", "document_id"], "left").select("job_id", "namespace", "document_id", "document_name")
