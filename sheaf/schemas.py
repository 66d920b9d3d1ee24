"""Explicit schemas of the stored tables and of the rows that flow between steps."""

from pyspark.sql import types as T

STATUSES = ("pending", "processing", "completed", "failed")

EMBEDDING = T.ArrayType(T.FloatType(), containsNull=False)

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("gcs_uri", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("content_hash", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("num_pages", T.IntegerType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("error", T.StringType()),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("uploaded_at", T.TimestampType(), False),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("content", T.StringType(), False),
        T.StructField("n_chars", T.IntegerType()),
        T.StructField("embedding", EMBEDDING, False),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("document_id", T.StringType()),
    ]
)

INGESTION_EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("document_id", T.StringType()),
        T.StructField("gcs_uri", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("message", T.StringType()),
        T.StructField("payload", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

OBJECT_EVENTS = T.StructType(
    [
        T.StructField("ce_type", T.StringType()),
        T.StructField("ce_subject", T.StringType()),
        T.StructField("ce_id", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)

PIECE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)

QUESTIONS = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("question", T.StringType(), False),
    ]
)
