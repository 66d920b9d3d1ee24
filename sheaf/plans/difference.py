"""Ingest of changed documents by difference: what is known is neither embedded nor posted again.

Chunks are known by the hash of their content. A chunk is *kept* if it has the content it had at its
place, *moved* if its document had that content at another place, else *new*; a stored chunk
whose content the document no longer has is *gone*. A vector depends on the content alone, so
that of any stored chunk with the content serves, and of several new chunks with the same content
one is embedded. Only hashes and places are shuffled to find this out; contents and vectors move
with the chunks that need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import embed, keywords
from sheaf.plans.ingest import IngestKnobs
from sheaf.session import stored

# What became of a chunk.
KEPT, MOVED, NEW, GONE = "kept", "moved", "new", "gone"

PLACE = ["document_id", "chunk_index"]


def keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_key", F.sha2("content", 256))


def changes(before: DataFrame, documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(document_id, chunk_index, content_key, state)`` of every fresh chunk and of the gone ones.

    ``before`` are the stored chunks, ``documents`` (``document_id``) those that arrive again, and
    ``fresh`` all their chunks now; each has ``document_id``, ``chunk_index`` and ``content``.
    """
    again = documents.select("document_id").distinct()
    old = stored(keyed(before.join(again, "document_id", "left_semi")).select(*PLACE, "content_key"), "old")
    now = stored(keyed(fresh).select(*PLACE, "content_key"), "now")
    same = old.select(*PLACE, F.col("content_key").alias("old_key"))
    had = old.select("document_id", "content_key", F.lit(True).alias("had")).distinct()
    judged = now.join(same, PLACE, "left").join(had, ["document_id", "content_key"], "left")
    state = F.when(F.col("old_key") == F.col("content_key"), KEPT).when(F.col("had"), MOVED).otherwise(NEW)
    gone = old.join(now.select("document_id", "content_key").distinct(), ["document_id", "content_key"], "left_anti")
    columns = [*PLACE, "content_key"]
    return judged.select(*columns, state.alias("state")).unionByName(gone.select(*columns, F.lit(GONE).alias("state")))


def counts(changed: DataFrame) -> DataFrame:
    """``(document_id, n_kept, n_moved, n_new, n_gone)``."""
    number = [F.count(F.when(F.col("state") == state, 1)).alias(f"n_{state}") for state in (KEPT, MOVED, NEW, GONE)]
    return changed.groupBy("document_id").agg(*number)


def vectors(before: DataFrame, fresh: DataFrame, knobs: IngestKnobs = IngestKnobs()) -> DataFrame:
    """``(content_key, embedding)`` of the fresh chunks' contents, each embedded only if no stored chunk has it."""
    wanted = keyed(fresh).select("content_key", "content")
    keys = wanted.select("content_key").distinct()
    known = keyed(before).filter("embedding IS NOT NULL").join(keys, "content_key", "left_semi")
    known = stored(known.groupBy("content_key").agg(F.any_value("embedding").alias("embedding")), "known")
    todo = wanted.join(known.select("content_key"), "content_key", "left_anti")
    todo = stored(todo.groupBy("content_key").agg(F.any_value("content").alias("content")), "todo")
    if knobs.model:
        vector = embed.model_vector(F.col("content"), knobs.model, knobs.embed, strict=False)
    else:
        vector = embed.hashed_vector(F.col("content"), knobs.embed.dim)
    made = stored(todo.select("content_key", vector.alias("embedding")), "made")  # the model is called once
    return known.unionByName(made)


def reingest(
    before: DataFrame, documents: DataFrame, fresh: DataFrame, knobs: IngestKnobs = IngestKnobs()
) -> tuple[DataFrame, DataFrame]:
    """The fresh chunks with ``id``, ``embedding`` and ``state``; and the postings to add for them.

    Postings of kept chunks are there already; those of other stored chunks of the documents
    are to be removed by their chunk ids.
    """
    state = changes(before, documents, fresh).filter(F.col("state") != GONE).select(*PLACE, "state")
    rows = keyed(fresh).join(vectors(before, fresh, knobs), "content_key").join(state, PLACE)
    rows = stored(rows.withColumn("id", text.chunk_key("document_id", F.col("chunk_index"))), "reingested")
    fresh_only = rows.filter(F.col("state") != KEPT).select(F.col("id").alias("chunk_id"), "document_id", "content")
    return rows.drop("content_key"), keywords.postings(fresh_only, keep=("document_id",))
