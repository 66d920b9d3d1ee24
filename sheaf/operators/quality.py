"""Checks on the stored tables; each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.vectors import has_width
from sheaf.schemas import STATUSES


def bad_vectors(chunks: DataFrame, dim: int) -> DataFrame:
    return chunks.filter(~has_width("embedding", dim))


def bad_status(documents: DataFrame) -> DataFrame:
    return documents.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def orphans(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows whose ``document_id`` no document has; a null reference is no orphan."""
    ids = documents.select(F.col("id").alias("document_id"))
    return rows.filter(F.col("document_id").isNotNull()).join(ids, "document_id", "left_anti")


def by_status(documents: DataFrame, status: str) -> DataFrame:
    return documents.filter(F.col("status") == status)


def newest(rows: DataFrame, time_col: str, n: int, tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(time_col), F.asc(tie)).limit(n)


def dedupe_by_hash(documents: DataFrame) -> DataFrame:
    """The first document (by ``id``) of each known ``content_hash``.

    The smallest id and the count combine on the map side, so a hash shared by a third of
    all rows sends one row per task; the rows of these ids are then looked up. Rows without
    a hash are no candidates.
    """
    known = documents.filter(F.col("content_hash").isNotNull())
    first = known.groupBy("content_hash").agg(F.min("id").alias("id"), F.count("*").alias("n_copies"))
    rest = [c for c in documents.columns if c != "content_hash"]
    return known.join(first, ["content_hash", "id"]).select("content_hash", "n_copies", *rest)
