"""Table maintenance as DataFrames: upsert, chunk replacement, status, cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.session import broadcast_if_small


def new_documents(batch: DataFrame, now: Column) -> DataFrame:
    """Rows to upsert, with the defaults a first insert gets.

    ``batch`` has ``gcs_uri``, ``filename``, ``content_hash``, ``num_pages`` and
    ``metadata``.
    """
    return batch.select(
        text.document_key("gcs_uri").alias("id"),
        "gcs_uri",
        "filename",
        "content_hash",
        F.lit(None).cast("long").alias("size_bytes"),
        F.col("num_pages").cast("int").alias("num_pages"),
        F.lit("processing").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        now.alias("uploaded_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
    )


def upsert_documents(existing: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The whole documents table after an upsert by ``gcs_uri``.

    A match takes the new filename, hash, page count and metadata, goes back to
    ``processing`` without error and end time, and keeps its id, upload time and
    size. ``batch`` holds one row per URI.
    """
    fresh = new_documents(batch, now)
    kept = ["id", "uploaded_at", "size_bytes"]
    is_new = F.col("b.gcs_uri").isNotNull()

    def merged(name: str) -> Column:
        old, new = F.col(f"e.{name}"), F.col(f"b.{name}")
        if name in (*kept, "gcs_uri"):
            return F.coalesce(old, new).alias(name)
        return F.when(is_new, new).otherwise(old).alias(name)

    both = existing.alias("e").join(
        fresh.alias("b"), F.col("e.gcs_uri") == F.col("b.gcs_uri"), "full_outer"
    )
    return both.select(*[merged(name) for name in fresh.columns])


def replace_chunks(existing: DataFrame, replaced: DataFrame, new: DataFrame) -> DataFrame:
    """The whole chunks table with every ``document_id`` in ``replaced`` swapped for ``new``."""
    ids = replaced.select("document_id").distinct()
    return existing.join(broadcast_if_small(ids), "document_id", "left_anti").unionByName(new)


def apply_outcomes(documents: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Move documents to completed or failed; others stay as they are.

    ``outcomes`` has ``document_id`` and ``error``, null for success.
    """
    results = outcomes.select(
        F.col("document_id").alias("id"), F.col("error").alias("outcome"), F.lit(True).alias("done")
    )
    done = F.coalesce("done", F.lit(False))
    return (
        documents.join(broadcast_if_small(results), "id", "left")
        .withColumns(
            {
                "status": F.when(
                    done, F.when(F.col("outcome").isNull(), "completed").otherwise("failed")
                ).otherwise(F.col("status")),
                "error": F.when(done, F.col("outcome")).otherwise(F.col("error")),
                "processed_at": F.when(done, now).otherwise(F.col("processed_at")),
            }
        )
        .select(*documents.columns)
    )


def delete_documents(
    documents: DataFrame, chunks: DataFrame, events: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents in ``gone`` (``document_id``) and their rows."""
    ids = broadcast_if_small(gone.select("document_id").distinct())
    return (
        documents.join(ids, documents["id"] == ids["document_id"], "left_anti"),
        chunks.join(ids, "document_id", "left_anti"),
        events.join(ids, "document_id", "left_anti"),
    )


def event_rows(
    source: DataFrame, event_type: str, now: Column, message=None, payload: Column | None = None
) -> DataFrame:
    """Audit rows for ``source`` (``document_id``, ``gcs_uri``), with deterministic ids."""
    kind = F.lit(event_type)
    return source.select(
        F.sha2(F.concat_ws("#", "gcs_uri", kind, now.cast("string")), 256).alias("id"),
        "document_id",
        "gcs_uri",
        kind.alias("event_type"),
        (F.lit(None).cast("string") if message is None else message).alias("message"),
        (F.lit("{}") if payload is None else F.to_json(payload)).alias("payload"),
        now.alias("created_at"),
    )


def zip_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with vectors that arrive separately, keyed by document and index.

    ``complete`` is false for every row of a document where a side is missing, so
    that the whole document can be failed.
    """
    keys = ["document_id", "chunk_index"]
    left = chunks.withColumn("has_chunk", F.lit(True))
    right = vectors.select(*keys, "embedding")
    rows = left.join(right, keys, "full_outer").withColumn(
        "paired", F.coalesce("has_chunk", F.lit(False)) & F.col("embedding").isNotNull()
    )
    whole = rows.groupBy("document_id").agg(F.min("paired").alias("complete"))
    return rows.join(whole, "document_id").drop("has_chunk", "paired")
