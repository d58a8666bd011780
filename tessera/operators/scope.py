"""What a request may look into, and chunks looked up under that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_IDS = "array<string>"


def _ids(ids: Column) -> Column:
    return F.filter(F.coalesce(ids, F.array().cast(NO_IDS)), lambda x: x.isNotNull() & (x != ""))


def _empty_is_null(ids: Column) -> Column:
    return F.when(F.size(ids) > 0, ids)


def normalised(requests: DataFrame) -> DataFrame:
    """``requests`` with mode (none or sources), library_all, document_ids, files_conversation and file_ids made plain.

    mode: none; all or documents (the older form); sources. Files count only with the
    conversation that they belong to; what names no source at all is none.
    """
    mode = F.coalesce("mode", F.lit("none"))
    everything = (mode == "all") | ((mode == "sources") & F.coalesce("library_all", F.lit(False)))
    documents = F.when(~everything & mode.isin("documents", "sources"), _empty_is_null(_ids(F.col("document_ids"))))
    conversation = F.nullif(F.trim(F.coalesce("files_conversation", F.lit(""))), F.lit(""))
    files = F.when((mode == "sources") & conversation.isNotNull(), _empty_is_null(_ids(F.col("file_ids"))))
    some = everything | documents.isNotNull() | files.isNotNull()
    return requests.withColumns({
        "mode": F.when(some, "sources").otherwise("none"), "library_all": everything, "document_ids": documents,
        "files_conversation": F.when(files.isNotNull(), conversation), "file_ids": files,
    })


def tightened(requests: DataFrame) -> DataFrame:
    """:func:`normalised`, with files bound to the request's own ``conversation_id``; without one they go."""
    own = F.nullif(F.trim(F.coalesce("conversation_id", F.lit(""))), F.lit(""))
    asked = _empty_is_null(_ids(F.col("file_ids")))
    held = normalised(requests.withColumns({"_own": own, "_asked": F.when(own.isNotNull(), asked)}))
    library = F.col("library_all") | F.col("document_ids").isNotNull()
    return held.withColumns({
        "files_conversation": F.when(F.col("_asked").isNotNull(), F.col("_own")), "file_ids": F.col("_asked"),
        "mode": F.when(library | F.col("_asked").isNotNull(), "sources").otherwise("none"),
    }).drop("_own", "_asked")


def from_attachments(attachments: DataFrame) -> DataFrame:
    """A request for each ``request_id`` of attachments (request_id, conversation_id, kind, id, name): the whole library wins over documents.

    An attachment without id or name, or of another kind, doesn't count.
    """
    kind = F.when(F.col("kind").isin("library_all", "all"), "library_all").when(F.col("kind").isin("library", "document"), "library").when(F.col("kind") == "conversation_file", "conversation_file")
    sound = (F.trim(F.coalesce("id", F.lit(""))) != "") & (F.trim(F.coalesce("name", F.lit(""))) != "")
    ids = lambda k: F.sort_array(F.collect_set(F.when((F.col("_kind") == k), F.trim("id"))))
    grouped = attachments.withColumn("_kind", F.when(sound, kind)).groupBy("request_id").agg(
        F.max("conversation_id").alias("conversation_id"), F.coalesce(F.bool_or(F.col("_kind") == "library_all"), F.lit(False)).alias("library_all"),
        ids("library").alias("document_ids"), ids("conversation_file").alias("file_ids"),
    )
    return normalised(grouped.withColumns({"mode": F.lit("sources"), "files_conversation": F.col("conversation_id")}))


def conversation_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id with each chunk (conversation_id, file_id, ...) of the files that the request may look into."""
    wanted = requests.filter("files_conversation is not null").select("request_id", F.col("files_conversation").alias("conversation_id"), F.explode("file_ids").alias("file_id"))
    return chunks.join(wanted.distinct(), ["conversation_id", "file_id"])


def opened(requests: DataFrame, library: DataFrame, conversation: DataFrame) -> DataFrame:
    """request_id, chunk_id, source, content, and a reason where the chunk can't be opened.

    ``requests``: normalised, with chunk_id; ``library``: chunk_id, document_id, content;
    ``conversation``: chunk_id, conversation_id, file_id, content. The library is looked
    at first; a chunk outside the request's scope shows no content.
    """
    a = library.select("chunk_id", F.col("document_id").cast("string").alias("_document"), F.col("content").alias("_library"), F.lit(True).alias("_in_library"))
    b = conversation.select("chunk_id", F.col("conversation_id").cast("string").alias("_conversation"), F.col("file_id").cast("string").alias("_file"), F.col("content").alias("_attached"), F.lit(True).alias("_in_files"))
    met = requests.join(a, "chunk_id", "left").join(b, "chunk_id", "left")
    source = F.when(F.col("_in_library"), "library").when(F.col("_in_files"), "conversation_file")
    may = F.when(source == "library", F.col("library_all") | F.coalesce(F.array_contains("document_ids", F.col("_document")), F.lit(False)))
    may = may.when(source == "conversation_file", F.coalesce((F.col("files_conversation") == F.col("_conversation")) & F.array_contains("file_ids", F.col("_file")), F.lit(False)))
    may = may & (F.col("mode") == "sources")
    reason = F.when(source.isNull(), "chunk_not_found").when(~may, "chunk_not_in_scope")
    return met.select("request_id", "chunk_id", F.when(reason.isNull(), source).alias("source"), F.when(reason.isNull(), F.coalesce("_library", "_attached")).alias("content"), reason.alias("reason"))


def united(library: DataFrame, conversation: DataFrame) -> DataFrame:
    """Results of both, one for each (query_id, chunk_id); the conversation's wins."""
    both = library.withColumn("_from", F.lit(0)).unionByName(conversation.withColumn("_from", F.lit(1)))
    last = Window.partitionBy("query_id", "chunk_id").orderBy(F.col("_from").desc())
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_from")
