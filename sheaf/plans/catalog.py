"""Every operator as a query over the test tables.

The tables stand in for stored ones: a document's object is
``gs://<source>/<doc_id>.pdf``, its pages are the lines of its text, and its status
follows its quality label. ``oracles.py`` states the same queries in SQL.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import table_functions, text, vectors as vector_functions
from sheaf.operators import (
    answers,
    bitmaps,
    bounded,
    chunks,
    embed,
    events,
    fusion,
    history,
    keywords,
    metadata,
    pages,
    quality,
    quantized,
    tables,
    vectors,
)
from sheaf.plans import difference, ingest
from sheaf.plans.retrieve import hybrid_from_store, hybrid_retrieve
from sheaf.session import remove, scratch_path, stored
from sheaf.settings import OBJECT_FINALIZED, ChunkKnobs, EmbedKnobs, EventKnobs
from sheaf.sources import lookup
from sheaf.sources.store import Store
from sheaf.sources.tables import read_table, spread
from sheaf.streaming import questions as question_stream
from sheaf.streaming import retries
from sheaf.streaming.ingest import start_ingest

DIM = 64
TOP_K = 20
SMALL_CHUNKS = ChunkKnobs(size=200, overlap=30)
UPLOADED = "2024-01-01 00:00:00"
INGESTED = "2024-02-01 00:00:00"
REUPLOADED = "2024-03-01 00:00:00"
QUESTION = '"de la" OR eron thion OR der -und'
KEYWORD_QUESTIONS = {
    "keyword_all": "de la que",
    "keyword_any": "thatin OR ononst OR hehely",
    "keyword_phrase": '"de la"',
    "keyword_not": 'der -und -"von der"',
}

# Words in a seventh to a quarter of the chunks.
FREQUENT_QUESTIONS = ("de la -que", "der und -die", "de OR der", "la -que OR die -und thatin", '"de la" -que', 'der -"von der"')

EXCLUDING = ("-the -of", "thatin OR -der", '-"de la" OR -und -que')


def stamp(value: str):
    return F.lit(value).cast("timestamp")


def time_text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# ---- stand-ins ---------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(document_id, bucket, name, gcs_uri, content)`` with the source columns."""
    rows = spread(read_table(spark, f"{sf}/documents.parquet"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    return (
        rows.withColumns({"bucket": F.col("source"), "name": name, "content": F.col("text")})
        .withColumn("gcs_uri", text.object_uri(F.col("bucket"), F.col("name")))
        .withColumn("document_id", text.document_key("gcs_uri"))
    )


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table as it stands after a first ingest."""
    labels = read_table(spark, f"{sf}/labels.parquet").select("doc_id", "quality")
    good = F.coalesce("quality", F.lit(1)) == 1
    return (
        documents(spark, sf)
        .join(labels, "doc_id", "left")
        .select(
            F.col("document_id").alias("id"),
            "gcs_uri",
            F.col("name").alias("filename"),
            F.sha2("content", 256).alias("content_hash"),
            F.lit(None).cast("long").alias("size_bytes"),
            F.size(pages.raw_pages(F.col("content"), "\n")).alias("num_pages"),
            F.when(good, "completed").otherwise("failed").alias("status"),
            F.when(~good, "low quality").alias("error"),
            F.lit("{}").alias("metadata"),
            stamp(UPLOADED).alias("uploaded_at"),
            stamp(INGESTED).alias("processed_at"),
        )
    )


def stride_chunks(spark: SparkSession, sf: str, knobs: ChunkKnobs = ChunkKnobs()) -> DataFrame:
    """Chunks of whole documents: ``(chunk_id, document_id, chunk_index, page_number, content)``."""
    rows = pages.with_pages(documents(spark, sf), "content")
    rows = rows.withColumn("pieces", chunks.stride_pieces(F.col("pages"), knobs))
    return chunks.explode_chunks(rows, "document_id").withColumn(
        "chunk_id", text.chunk_key("document_id", F.col("chunk_index"))
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Stride chunks with hashed vectors, written once and read by every step."""
    rows = stride_chunks(spark, sf)
    return stored(
        rows.withColumn("embedding", embed.hashed_vector(F.col("content"), DIM)), "corpus"
    )


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with a label: the ones that are uploaded again, revised."""
    labels = read_table(spark, f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    revised = F.concat(F.lit("Revised.\n"), F.col("content"))
    return documents(spark, sf).join(labels, "doc_id").withColumn("content", revised)


def upload_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch to upsert: revised documents, and web pages as new ones."""
    new = read_table(spark, f"{sf}/pages.parquet").select(
        F.lit("web").alias("bucket"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.col("html").alias("content"),
    )
    rows = labelled_documents(spark, sf).select("bucket", "name", "content").unionByName(new)
    return rows.select(
        text.object_uri(F.col("bucket"), F.col("name")).alias("gcs_uri"),
        F.col("name").alias("filename"),
        F.sha2("content", 256).alias("content_hash"),
        F.size(pages.raw_pages(F.col("content"), "\n")).alias("num_pages"),
        F.to_json(
            F.struct(F.col("bucket").alias("raw_bucket"), F.col("name").alias("raw_object"))
        ).alias("metadata"),
    )


def object_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as uploads of ``<user_id>.pdf``, with other types and files among them."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read_table(spark, f"{sf}/events.parquet").select(
        F.when(F.col("event_type") == "purchase", OBJECT_FINALIZED)
        .when(F.col("event_type") != "view", F.col("event_type"))
        .alias("ce_type"),
        F.col("event_id").cast("string").alias("ce_subject"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ce_id"),
        F.when(F.col("value") >= 30, "other")
        .when(F.col("value") >= 1, "raw")
        .otherwise("")
        .alias("bucket"),
        F.concat(
            F.col("user_id").cast("string"),
            F.when(k < 50, ".PDF").when(k < 80, ".pdf").otherwise(".txt"),
        ).alias("name"),
        F.col("ts").alias("event_time"),
    )


def fixed_questions(spark: SparkSession, *texts: str) -> DataFrame:
    rows = [(f"q{i}", question) for i, question in enumerate(texts, start=1)]
    return spark.createDataFrame(rows, "query_id string, question string")


def benchmark_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item as a question: any of its sentences, as a phrase."""
    phrases = F.regexp_replace("text", r"[.\n]+\s*", '" OR "')
    return read_table(spark, f"{sf}/benchmark.parquet").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"),
        F.concat(F.lit('"'), phrases, F.lit('"')).alias("question"),
    )


def embedded(questions: DataFrame) -> DataFrame:
    return ingest.question_vectors(questions, ingest.IngestKnobs(embed=EmbedKnobs(dim=DIM)))


def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(read_table(spark, f"{sf}/embeddings.parquet"))
    return rows.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def mean_vectors(rows: DataFrame, key) -> DataFrame:
    """The mean vector of each ``query_id``, combined on the map side."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    mean = rows.groupBy(key.alias("query_id")).agg(Summarizer.mean(vector).alias("mean"))
    return mean.select("query_id", vector_to_array("mean").alias("embedding"))


def label_questions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("label-"), F.col("label").cast("string"))
    return mean_vectors(stored_vectors(spark, sf), key)


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Started, completed and failed events of the stored documents."""
    rows = stored_documents(spark, sf).withColumn("document_id", F.col("id"))
    now = stamp(INGESTED)
    return (
        tables.event_rows(rows, "started", now, payload=F.struct("num_pages"))
        .unionByName(tables.event_rows(rows.filter("error IS NULL"), "completed", now))
        .unionByName(
            tables.event_rows(
                rows.filter("error IS NOT NULL"), "failed", now, message=F.col("error")
            )
        )
    )


# ---- events and objects ------------------------------------------------------

EVENT_KNOBS = EventKnobs(raw_bucket="raw")


def filter_events(spark, sf):
    return events.triage(object_events(spark, sf), EVENT_KNOBS).select(
        "ce_id", "bucket", "name", "verdict", "reason"
    )


def latest_event_per_uri(spark, sf):
    rows = events.accepted(object_events(spark, sf), EVENT_KNOBS)
    return events.latest_per_uri(rows).select(
        "gcs_uri", "ce_id", time_text("event_time").alias("event_time")
    )


def document_versions(spark, sf):
    """Accepted uploads as versions of their objects."""
    return events.accepted(object_events(spark, sf), EVENT_KNOBS).select("gcs_uri", "event_time", "ce_id")


def document_history(spark, sf):
    found = history.intervals(document_versions(spark, sf), "gcs_uri", "event_time", "ce_id")
    return found.select("gcs_uri", "ce_id", time_text("valid_from").alias("valid_from"), time_text("valid_to").alias("valid_to"))


def documents_as_of(spark, sf):
    """For each event of a user, the version that ``<user_id>.pdf`` had at that time."""
    asked = read_table(spark, f"{sf}/events.parquet").select(
        "event_id", "ts", F.concat(F.lit("gs://raw/"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("gcs_uri")
    )
    found = history.as_of(document_versions(spark, sf), asked, "gcs_uri", "event_time", "ts", "ce_id")
    return found.select("event_id", "gcs_uri", "version.ce_id", time_text("version.event_time").alias("valid_from"))


def parse_uri(spark, sf):
    uris = documents(spark, sf).select(F.col("gcs_uri").alias("uri"))
    urls = read_table(spark, f"{sf}/pages.parquet").select(F.col("url").alias("uri"))
    return uris.unionByName(urls).select(
        "uri",
        text.uri_bucket(F.col("uri")).alias("bucket"),
        text.uri_name(F.col("uri")).alias("name"),
        text.uri_problem("uri").alias("problem"),
    )


def object_names(spark, sf):
    urls = read_table(spark, f"{sf}/pages.parquet").select(F.col("url").alias("name"))
    names = documents(spark, sf).select(F.concat_ws("/", "source", "lang", "name").alias("name"))
    name = F.col("name")
    return names.unionByName(urls).select(
        "name",
        text.file_name(name).alias("filename"),
        text.text_name(name).alias("target_name"),
        text.object_uri(F.lit("raw"), name).alias("gcs_uri"),
    )


def content_hash(spark, sf):
    return documents(spark, sf).select(
        "document_id", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").alias("n_bytes")
    )


def dedupe_by_hash(spark, sf):
    rows = documents(spark, sf).select(
        F.col("doc_id").alias("id"), "gcs_uri", F.sha2("content", 256).alias("content_hash")
    )
    return quality.dedupe_by_hash(rows)


# ---- pages and chunks --------------------------------------------------------


def lines_as_pages(spark, sf):
    return pages.with_pages(documents(spark, sf), "content", "\n")


def split_pages(spark, sf):
    return pages.explode_pages(lines_as_pages(spark, sf), "document_id")


def split_pages_sql(spark, sf):
    """The pages by SQL, through a table function."""
    table_functions.register(spark)
    documents(spark, sf).createOrReplaceTempView("uploaded_documents")
    return spark.sql("SELECT d.document_id, p.* FROM uploaded_documents d, LATERAL split_pages(d.content, '\\n') p")


def chunk_recursive_sql(spark, sf):
    table_functions.register(spark)
    documents(spark, sf).createOrReplaceTempView("uploaded_documents")
    return spark.sql(
        "SELECT d.document_id, c.chunk_index, 1 AS page_number, c.content "
        "FROM uploaded_documents d, LATERAL recursive_chunks(d.content, 2000, 300) c"
    )


def chunk_lookup(spark, sf):
    """The first chunks of eight documents, by chunk id, from a table sorted by document."""
    rows, path = stride_chunks(spark, sf), scratch_path(spark, "lookup")
    lookup.write_sorted(rows, path, ("document_id", "chunk_index"), ("chunk_id", "document_id"))
    asked = documents(spark, sf).filter("doc_id < 8").select("document_id").collect()  # eight rows
    first = spark.createDataFrame(asked, "document_id string").select(text.chunk_key("document_id", F.lit(0)).alias("id"))
    found = lookup.find(spark, path, "chunk_id", [row["id"] for row in first.collect()])
    return found.select("chunk_id", "document_id", F.length("content").alias("n_chars"))


def metadata_paths(spark, sf):
    """Counts by paths of metadata and payloads: documents by bucket, pages by bucket, keys."""
    uploads = metadata.typed(upload_batch(spark, sf), "metadata")
    by_bucket = uploads.filter(metadata.at("metadata", "$.raw_object").endswith(".pdf")).groupBy(
        metadata.at("metadata", "$.raw_bucket").alias("name")
    )
    started = metadata.typed(stored_events(spark, sf), "payload").filter(metadata.at("payload", "$.num_pages", "int") > 1)
    pages_of = started.groupBy(text.uri_bucket(F.col("gcs_uri")).alias("name"))
    parts = {
        "documents": by_bucket.agg(F.count("*").alias("n")),
        "pages": pages_of.agg(F.sum(metadata.at("payload", "$.num_pages", "int")).alias("n")),
        "keys": metadata.keys(uploads, "metadata").withColumnRenamed("key", "name"),
    }
    counted = [rows.select(F.lit(kind).alias("kind"), "name", "n") for kind, rows in parts.items()]
    return reduce(DataFrame.unionByName, counted)


def page_counts(spark, sf):
    return lines_as_pages(spark, sf).select(
        "document_id", "num_pages", F.size("pages").alias("n_pages_with_text")
    )


def processed_text(spark, sf):
    return lines_as_pages(spark, sf).select(
        text.text_name(F.col("name")).alias("target_name"),
        pages.joined_text(F.col("pages")).alias("text"),
    )


def chunk_stride(spark, sf):
    return stride_chunks(spark, sf).withColumn("n_chars", F.length("content"))


def chunk_index(spark, sf):
    rows = lines_as_pages(spark, sf).withColumn(
        "pieces", chunks.stride_pieces(F.col("pages"), SMALL_CHUNKS)
    )
    pieces = chunks.explode_chunks(rows, "document_id").withColumnRenamed("chunk_index", "piece_no")
    return chunks.number_pieces(pieces).select(
        "document_id", "page_number", "chunk_index", "content"
    )


def chunk_recursive(spark, sf):
    rows = pages.with_pages(documents(spark, sf), "content")
    rows = rows.withColumn("pieces", chunks.recursive_pieces(F.col("pages")))
    return chunks.explode_chunks(rows, "document_id")


def prepare_errors(spark, sf):
    """Why objects fail: some uploads are empty, some hold white space only."""
    content = (
        F.when(F.col("doc_id") % 7 == 0, F.lit(""))
        .when(F.col("doc_id") % 7 == 1, F.lit(" \n \n"))
        .otherwise(F.col("content"))
    )
    prepared = ingest.prepare(documents(spark, sf).withColumn("content", content), STRIDE)
    return prepared.select("gcs_uri", "is_document", "n_bytes", "error", (F.size("pieces") > 0).alias("has_chunks"))


def sizes_model(texts: list[str]) -> list[list[float]]:
    """Stands in for an embedding model: the length of a text, and whether the batch keeps to its bound."""
    return [[float(len(content)), float(len(texts) <= EmbedKnobs().batch_size)] for content in texts]


def embed_model(spark, sf):
    """Chunks embedded by a caller's model in batches of bounded size."""
    vector = embed.model_vector(F.col("content"), sizes_model, EmbedKnobs(dim=2))
    rows = stride_chunks(spark, sf).select("chunk_id", vector.alias("embedding"))
    return rows.select("chunk_id", F.col("embedding")[0].cast("int").alias("n_chars"), (F.col("embedding")[1] == 1).alias("in_batch"))


def constant_vectors(spark, sf):
    """A constant vector for every document, with its width check and length."""
    vector = vector_functions.constant_vector(0.5, DIM)
    return documents(spark, sf).select(
        "document_id",
        vector_functions.has_width(vector, DIM).alias("fits"),
        vector_functions.has_width(vector, DIM + 1).alias("fits_other"),
        vector_functions.norm(vector).alias("length"),
    )


# ---- vectors -----------------------------------------------------------------


def embed_hashed(spark, sf):
    rows = stride_chunks(spark, sf).select(
        "chunk_id", embed.hashed_vector(F.col("content"), DIM).alias("embedding")
    )
    return (
        rows.select("chunk_id", F.posexplode("embedding").alias("bucket", "value"))
        .filter("value > 0")
        .withColumn("value", F.round(F.col("value").cast("double"), 6))
    )


def vector_topk(spark, sf):
    rows = stored_vectors(spark, sf)
    question = mean_vectors(rows, F.lit("all"))
    return rounded(vectors.vector_topk(rows, question, TOP_K))


def vector_topk_batch(spark, sf):
    return rounded(vectors.vector_topk(stored_vectors(spark, sf), label_questions(spark, sf), TOP_K))


def rounded(found):
    return found.withColumn("distance", F.round("distance", 6))


def cell_search(spark, sf, n_cells, n_probe):
    rows = stored_vectors(spark, sf)
    centroids = vectors.train_cells(rows, n_cells)
    path = scratch_path(spark, "cells")
    vectors.write_cells(vectors.assign_cells(rows, centroids), path)
    return vectors.vector_topk_cells(
        read_table(spark, path), centroids, label_questions(spark, sf), TOP_K, n_probe
    )


def vector_topk_ivf(spark, sf):
    return rounded(cell_search(spark, sf, 16, 8))


def vector_topk_ivf_all(spark, sf):
    return rounded(cell_search(spark, sf, 16, 16))


def mean_cells(spark, sf):
    """The cells of the labels' means, stored; the three nearest of a question are searched."""
    rows, questions = stored_vectors(spark, sf), label_questions(spark, sf)
    means = np.array([row["embedding"] for row in questions.orderBy("query_id").collect()])  # one per label
    path = scratch_path(spark, "cells")
    vectors.write_cells(vectors.assign_cells(rows, means), path)
    return vectors.vector_topk_cells(read_table(spark, path), means, questions, TOP_K, 3)


def vector_topk_means(spark, sf):
    return rounded(mean_cells(spark, sf))


def recall_means(spark, sf):
    exact = vectors.vector_topk(stored_vectors(spark, sf), label_questions(spark, sf), TOP_K)
    return vectors.recall(mean_cells(spark, sf), exact)


def recall_at_k(spark, sf):
    exact = vectors.vector_topk(stored_vectors(spark, sf), label_questions(spark, sf), TOP_K)
    return vectors.recall(cell_search(spark, sf, 16, 8), exact)


# A fixed codec, so that SQL can state the same search: parts, rows that are entries, probes, depth.
PARTS, ENTRIES, PROBES, DEPTH = 16, 32, 6, 200


def fixed_codec(spark, sf):
    """Cells are the labels' means; entries are what is left of the vectors with ids below ENTRIES."""
    means = label_questions(spark, sf).orderBy("query_id").collect()  # one per label
    centroids = vectors._unit(np.array([row["embedding"] for row in means]))[0]
    some = stored_vectors(spark, sf).filter(F.col("chunk_id") < ENTRIES).orderBy("chunk_id").collect()
    unit = vectors._unit(np.array([row["embedding"] for row in some], np.float64))[0]
    left = unit - centroids[(unit @ centroids.T).argmax(axis=1)]
    return quantized.Codec(centroids, left.reshape(len(left), PARTS, -1).transpose(1, 0, 2).copy())


def quantized_search(spark, sf):
    codec = fixed_codec(spark, sf)
    path = scratch_path(spark, "codes")
    vectors.write_cells(quantized.encode(stored_vectors(spark, sf), codec), path)
    questions = stored(label_questions(spark, sf), "questions")
    return quantized.topk_quantized(read_table(spark, path), codec, questions, TOP_K, PROBES, DEPTH)


def vector_topk_quantized(spark, sf):
    return rounded(quantized_search(spark, sf))


def recall_quantized(spark, sf):
    exact = vectors.vector_topk(stored_vectors(spark, sf), label_questions(spark, sf), TOP_K)
    return vectors.recall(quantized_search(spark, sf), exact)


def cosine_to_mean(spark, sf):
    """Distance of every vector to its label's mean, as a column expression."""
    rows = stored_vectors(spark, sf).withColumn(
        "query_id", F.concat(F.lit("label-"), F.col("label").cast("string"))
    )
    means = label_questions(spark, sf).withColumnRenamed("embedding", "mean")
    distance = vector_functions.cosine_distance(F.col("embedding"), F.col("mean"))
    return rows.join(means, "query_id").select(
        "chunk_id", "query_id", F.round(distance, 6).alias("distance")
    )


# ---- keywords ----------------------------------------------------------------


def chunk_postings(spark, sf):
    return keywords.postings(stride_chunks(spark, sf))


def posted(spark, sf):
    """The postings written once, as an ingest would, and read by every step."""
    return stored(chunk_postings(spark, sf), "postings")


def query_clauses(spark, sf):
    return keywords.query_clauses(benchmark_questions(spark, sf))


def keyword_query(key):
    def run(spark, sf):
        clauses = keywords.query_clauses(fixed_questions(spark, KEYWORD_QUESTIONS[key]))
        return keywords.match(posted(spark, sf), clauses).select("query_id", "chunk_id")

    return run


def keyword_rank(spark, sf):
    clauses = keywords.query_clauses(fixed_questions(spark, *KEYWORD_QUESTIONS.values(), QUESTION))
    found = keywords.match(posted(spark, sf), clauses)
    return found.withColumn("score", F.round("score", 6))


def keyword_topk(spark, sf):
    clauses = keywords.query_clauses(fixed_questions(spark, *KEYWORD_QUESTIONS.values(), QUESTION))
    found = keywords.keyword_topk(posted(spark, sf), clauses, TOP_K)
    return found.withColumn("score", F.round("score", 6))


def keyword_bitmaps(spark, sf):
    rows = bitmaps.number_chunks(stride_chunks(spark, sf).select("chunk_id", "content"))
    rows, path = stored(rows, "numbered"), scratch_path(spark, "bitmaps")
    bitmaps.write_index(keywords.postings(rows, keep=("number",)), rows.count(), path)
    clauses = keywords.query_clauses(fixed_questions(spark, *FREQUENT_QUESTIONS))
    found = bitmaps.match(read_table(spark, f"{path}/postings"), read_table(spark, f"{path}/bitmaps"), clauses)
    return found.withColumn("score", F.round("score", 6))


def bounded_index(spark, sf):
    """Postings by term and range with their summary, as an ingest would keep them."""
    path = scratch_path(spark, "ranged")
    stride_chunks(spark, sf).select("chunk_id", "content").write.parquet(f"{path}/chunks")
    rows = read_table(spark, f"{path}/chunks")
    n_ranges = bounded.count_ranges(rows.count())
    bounded.write_ranged(keywords.postings(rows), path, n_ranges)
    remove(spark, f"{path}/chunks")
    return read_table(spark, f"{path}/postings"), read_table(spark, f"{path}/summary"), n_ranges


def bounded_topk(questions):
    def run(spark, sf):
        rows, summaries, n_ranges = bounded_index(spark, sf)
        found = bounded.keyword_topk(rows, summaries, keywords.query_clauses(questions(spark, sf)), TOP_K, n_ranges)
        return found.withColumn("score", F.round("score", 6))

    return run


def keyword_only_not(spark, sf):
    """Questions with groups that only exclude: what they let through comes in id order."""
    rows = stored(stride_chunks(spark, sf), "chunks")
    clauses = keywords.query_clauses(fixed_questions(spark, *EXCLUDING))
    found = keywords.keyword_topk(stored(keywords.postings(rows), "postings"), clauses, TOP_K, rows)
    return found.withColumn("score", F.round("score", 6))


def keyword_batch(spark, sf):
    clauses = keywords.query_clauses(benchmark_questions(spark, sf))
    found = keywords.keyword_topk(posted(spark, sf), clauses, TOP_K)
    return found.withColumn("score", F.round("score", 6))


# ---- retrieval and answers ---------------------------------------------------


def rrf_fuse(spark, sf):
    rows = read_table(spark, f"{sf}/documents.parquet").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), "n_chars"
    )
    longest = vectors.topk_per_question(rows, TOP_K, F.desc("n_chars"), F.asc("chunk_id"))
    newest = vectors.topk_per_question(rows, TOP_K, F.desc("chunk_id"))
    fused = fusion.rrf_fuse({"vector": longest, "keyword": newest}, 60)
    return fused.withColumn("rrf_score", F.round("rrf_score", 9))


def hybrid(spark, sf, questions):
    rows = corpus(spark, sf)
    found = hybrid_retrieve(
        rows,
        stored_documents(spark, sf),
        embedded(questions),
        posted=stored(keywords.postings(rows), "postings"),
    )
    return found.withColumn("rrf_score", F.round("rrf_score", 9))


def hybrid_one(spark, sf):
    return hybrid(spark, sf, fixed_questions(spark, QUESTION))


def hybrid_batch(spark, sf):
    return hybrid(spark, sf, benchmark_questions(spark, sf))


def hybrid_batch_cells(spark, sf):
    """The batch with a vector leg that probes cells, all of them, so that it stays exact."""
    rows, questions = corpus(spark, sf), embedded(benchmark_questions(spark, sf))
    centroids = vectors.train_cells(rows, 16)
    cells = stored(vectors.assign_cells(rows.select("chunk_id", "embedding"), centroids), "cells")
    leg = vectors.vector_topk_cells(cells, centroids, questions, TOP_K, 16)
    found = hybrid_retrieve(rows, stored_documents(spark, sf), questions, vector_leg=leg)
    return found.withColumn("rrf_score", F.round("rrf_score", 9))


def citations(spark, sf):
    return answers.citations(hybrid_batch(spark, sf))


def context_prompt(spark, sf):
    return answers.context_prompt(benchmark_questions(spark, sf), hybrid_batch(spark, sf))


def answer_json(spark, sf):
    return answers.answer_json(
        benchmark_questions(spark, sf), stored(hybrid_batch(spark, sf), "retrieved")
    )


def valid_questions(spark, sf):
    turns = read_table(spark, f"{sf}/conversations.parquet").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question")
    )
    return answers.check_questions(turns).select("query_id", "problem")


# ---- table maintenance -------------------------------------------------------


def table_text(rows):
    """The documents table with its times as text, for comparison."""
    return rows.withColumns(
        {"uploaded_at": time_text("uploaded_at"), "processed_at": time_text("processed_at")}
    )


def upsert_documents(spark, sf):
    return table_text(
        tables.upsert_documents(
            stored_documents(spark, sf), upload_batch(spark, sf), stamp(REUPLOADED)
        )
    )


def revised_chunks(spark, sf):
    rows = pages.with_pages(labelled_documents(spark, sf), "content")
    rows = rows.withColumn("pieces", chunks.stride_pieces(F.col("pages")))
    return chunks.explode_chunks(rows, "document_id").withColumn(
        "chunk_id", text.chunk_key("document_id", F.col("chunk_index"))
    )


def replace_chunks(spark, sf):
    return tables.replace_chunks(
        stride_chunks(spark, sf), labelled_documents(spark, sf), revised_chunks(spark, sf)
    )


def changed_documents(spark, sf):
    """The labelled documents again: good ones with a line more, toxic ones with a line before, others as they were."""
    labels = read_table(spark, f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    content = (
        F.when(F.col("toxic") == 1, F.concat(F.lit("Revised.\n"), F.col("content")))
        .when(F.col("quality") == 1, F.concat(F.col("content"), F.lit("\nRevised.")))
        .otherwise(F.col("content"))
    )
    return documents(spark, sf).join(labels, "doc_id").withColumn("content", content)


def stride_chunks_of(rows):
    rows = pages.with_pages(rows, "content").withColumn("pieces", chunks.stride_pieces(F.col("pages")))
    return chunks.explode_chunks(rows, "document_id")


def reingest_changes(spark, sf):
    again = stored(changed_documents(spark, sf).select("document_id", "content"), "again")
    changed = difference.changes(stride_chunks(spark, sf), again, stride_chunks_of(again))
    return difference.counts(changed)


def status_transition(spark, sf):
    labelled = labelled_documents(spark, sf)
    outcomes = labelled.select(
        "document_id", F.when(F.col("toxic") == 1, "rejected content").alias("error")
    )
    return table_text(
        tables.apply_outcomes(stored_documents(spark, sf), outcomes, stamp(REUPLOADED))
    )


def cascade_delete(spark, sf):
    gone = labelled_documents(spark, sf).filter("toxic = 1").select("document_id")
    left = tables.delete_documents(
        stored_documents(spark, sf), stride_chunks(spark, sf), stored_events(spark, sf), gone
    )
    counted = [
        rows.groupBy(F.lit(name).alias("table"), F.col(key).alias("document_id")).agg(
            F.count("*").alias("n")
        )
        for name, key, rows in zip(
            ("documents", "chunks", "events"), ("id", "document_id", "document_id"), left
        )
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def event_log(spark, sf):
    return stored_events(spark, sf).withColumn("created_at", time_text("created_at")).drop("id")


def recent_documents(spark, sf):
    after = tables.upsert_documents(
        stored_documents(spark, sf), upload_batch(spark, sf), stamp(REUPLOADED)
    )
    return quality.newest(after.select("id", "filename", "status", "uploaded_at"), "uploaded_at", 5).select(
        "id", "filename", "status", time_text("uploaded_at").alias("uploaded_at")
    )


def zip_vectors(spark, sf):
    """Chunks whose vectors arrive apart: those of labelled documents only."""
    rows = stride_chunks(spark, sf)
    vectors_apart = revised_chunks(spark, sf).select(
        "document_id", "chunk_index", F.array(F.lit(1.0).cast("float")).alias("embedding")
    )
    zipped = tables.zip_vectors(rows, vectors_apart)
    return zipped.groupBy("document_id").agg(
        F.count("chunk_id").alias("n_chunks"),
        F.count("embedding").alias("n_vectors"),
        F.min("complete").alias("complete"),
    )


# ---- quality -----------------------------------------------------------------


def bad_vectors(spark, sf):
    """Vectors of the wrong width, where the labels' zero entries were left out."""
    rows = stored_vectors(spark, sf)
    positive = rows.withColumn("embedding", F.filter("embedding", lambda x: x > -0.2))
    return quality.bad_vectors(positive, DIM).select("chunk_id", F.size("embedding").alias("width"))


def bad_status(spark, sf):
    rows = read_table(spark, f"{sf}/events.parquet").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise(F.col("event_type"))
        .alias("status"),
    )
    return quality.bad_status(rows)


def duplicate_keys(spark, sf):
    rows = documents(spark, sf).select(F.sha2("content", 256).alias("content_hash"))
    return quality.duplicate_keys(rows, "content_hash")


def orphan_chunks(spark, sf):
    """Chunks of documents that are not in the table of labelled ones."""
    kept = labelled_documents(spark, sf).select(F.col("document_id").alias("id"))
    return quality.orphans(stride_chunks(spark, sf), kept).select("document_id", "chunk_index")


def by_status(spark, sf):
    return quality.by_status(stored_documents(spark, sf), "failed").select("id", "gcs_uri", "error")


# ---- streaming ---------------------------------------------------------------


def upload_events(rows: DataFrame, wave: str, at: str) -> DataFrame:
    return rows.select(
        F.lit(OBJECT_FINALIZED).alias("ce_type"),
        F.col("name").alias("ce_subject"),
        F.concat(F.lit(wave), F.col("doc_id").cast("string")).alias("ce_id"),
        "bucket",
        "name",
        stamp(at).alias("event_time"),
        "content",
    )


LINES_AS_PAGES = ingest.IngestKnobs(embed=EmbedKnobs(dim=DIM), page_separator="\n")
STRIDE = ingest.IngestKnobs(embed=EmbedKnobs(dim=DIM), pieces=chunks.stride_pieces)


def streamed_store(spark: SparkSession, sf: str, knobs: ingest.IngestKnobs = LINES_AS_PAGES) -> Store:
    """All documents uploaded, then the labelled ones again, each wave as a stream run."""
    root = scratch_path(spark, "stream")
    store = Store(spark, f"{root}/store")
    waves = [
        upload_events(documents(spark, sf), "first-", UPLOADED),
        upload_events(labelled_documents(spark, sf), "second-", REUPLOADED),
    ]
    for wave in waves:
        wave.write.mode("append").option("compression", "zstd").parquet(f"{root}/uploads")
        stream = spark.readStream.schema(wave.schema).parquet(f"{root}/uploads")
        start_ingest(stream, store, f"{root}/checkpoint", knobs).awaitTermination()
    return store


_BUILT: dict[tuple, Store] = {}


def built_store(spark, sf):
    """The store after both waves; a session ingests a folder of tables once and then asks it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        _BUILT[key] = streamed_store(spark, sf, STRIDE)
    return _BUILT[key]


def hybrid_stored(spark, sf):
    """The batch answered from what ingest keeps, after a second wave of uploads."""
    questions = stored(embedded(benchmark_questions(spark, sf)), "questions")
    found = hybrid_from_store(built_store(spark, sf), questions)
    return found.withColumn("rrf_score", F.round("rrf_score", 9))


def unreliable(content: str, attempt: int) -> str:
    """Work that fails by the length of a text: for good, or up to three times."""
    n = len(content or "")
    if n % 11 == 7 or (n % 5 == 2 and attempt <= n % 3 + 1):
        raise ValueError(f"{n} characters at attempt {attempt}")
    return content


def object_retries(spark, sf):
    """What became of every document whose extraction fails now and then, with its attempts."""
    root = scratch_path(spark, "retries")
    uploads = upload_events(documents(spark, sf), "once-", UPLOADED)
    uploads.write.parquet(f"{root}/uploads")
    stream = spark.readStream.schema(uploads.schema).parquet(f"{root}/uploads")
    waits = retries.RetryKnobs(wait_unit=0.1)
    total = events.accepted(read_table(spark, f"{root}/uploads")).select("gcs_uri").distinct().count()
    query = retries.start_retrying(stream, root, f"{root}/checkpoint", unreliable, waits, every="500 milliseconds")
    try:
        while query.isActive and retries.finished(spark, root) < total:
            time.sleep(0.5)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return retries.outcomes(spark, root).select("gcs_uri", "verdict", "attempts", "error")


def prompt_sizes(prompts: list[str]) -> list[str]:
    """Stands in for an answer model."""
    return [f"{len(prompt)} characters" for prompt in prompts]


def streamed_answers(spark, sf):
    """The benchmark questions as a stream, answered from the store, with their timing judged."""
    root, store = scratch_path(spark, "answers"), built_store(spark, sf)
    asked = benchmark_questions(spark, sf)
    asked.write.parquet(f"{root}/questions")
    stream = spark.readStream.schema(asked.schema).parquet(f"{root}/questions")

    def retrieve(questions):
        return hybrid_from_store(store, questions).withColumn("rrf_score", F.round("rrf_score", 9))

    query = question_stream.start_answers(
        stream, store, f"{root}/out", f"{root}/checkpoint", prompt_sizes, STRIDE, retrieve
    )
    query.awaitTermination()
    timing = metadata.typed(question_stream.answered(spark, f"{root}/out"), "timing")
    parts = [metadata.at("timing", f"$.{step}", "long") for step in question_stream.STEPS]
    adds_up = reduce(lambda a, b: a + b, parts) == metadata.at("timing", "$.total_ms", "long")
    return timing.select("query_id", "answer", "citations", (adds_up & (F.least(*parts) >= 0)).alias("timing_adds_up"))


def stored_tables(spark, sf):
    """The tables a store has after both waves: the columns found in its files, and its rows."""
    store = built_store(spark, sf)
    columns = F.array_join(F.sort_array(F.collect_list("column")), ",")
    listed = store.tables().groupBy("table").agg(columns.alias("columns"))
    counts = [
        store.rows(row["table"]).agg(F.count("*").alias("n_rows")).withColumn("table", F.lit(row["table"]))
        for row in listed.select("table").collect()
    ]
    return listed.join(reduce(DataFrame.unionByName, counts), "table")


def chunks_of_documents(spark, sf):
    """Chunk and event counts of the documents uploaded twice, looked up by document."""
    store = built_store(spark, sf)
    asked = labelled_documents(spark, sf).select("document_id")
    counted = [
        rows.join(asked, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias(name))
        for name, rows in (("n_chunks", store.chunks()), ("n_events", store.events()))
    ]
    return counted[0].join(counted[1], "document_id")


def stream_ingest(spark, sf):
    store = streamed_store(spark, sf)
    log = store.events().groupBy(F.col("document_id").alias("id")).agg(
        F.count(F.when(F.col("event_type") == "started", 1)).alias("n_started"),
        F.count(F.when(F.col("event_type") == "completed", 1)).alias("n_completed"),
    )
    lines = store.chunks().groupBy(F.col("document_id").alias("id")).agg(
        F.countDistinct("page_number").alias("n_pages_with_chunks")
    )
    return (
        store.documents()
        .join(log, "id", "left")
        .join(lines, "id", "left")
        .select(
            "id",
            "gcs_uri",
            "filename",
            "content_hash",
            "num_pages",
            "status",
            "error",
            "metadata",
            time_text("source_time").alias("source_time"),
            "n_started",
            "n_completed",
            "n_pages_with_chunks",
        )
    )


QUERIES = {
    "filter_events": filter_events,
    "latest_event_per_uri": latest_event_per_uri,
    "document_history": document_history,
    "documents_as_of": documents_as_of,
    "parse_uri": parse_uri,
    "object_names": object_names,
    "content_hash": content_hash,
    "dedupe_by_hash": dedupe_by_hash,
    "split_pages": split_pages,
    "split_pages_sql": split_pages_sql,
    "chunk_recursive_sql": chunk_recursive_sql,
    "chunk_lookup": chunk_lookup,
    "metadata_paths": metadata_paths,
    "page_counts": page_counts,
    "processed_text": processed_text,
    "chunk_stride": chunk_stride,
    "chunk_index": chunk_index,
    "chunk_recursive": chunk_recursive,
    "prepare_errors": prepare_errors,
    "embed_model": embed_model,
    "constant_vectors": constant_vectors,
    "embed_hashed": embed_hashed,
    "vector_topk": vector_topk,
    "vector_topk_batch": vector_topk_batch,
    "vector_topk_ivf": vector_topk_ivf,
    "vector_topk_ivf_all": vector_topk_ivf_all,
    "recall_at_k": recall_at_k,
    "vector_topk_means": vector_topk_means,
    "recall_means": recall_means,
    "vector_topk_quantized": vector_topk_quantized,
    "recall_quantized": recall_quantized,
    "cosine_to_mean": cosine_to_mean,
    "postings": chunk_postings,
    "query_clauses": query_clauses,
    "keyword_all": keyword_query("keyword_all"),
    "keyword_any": keyword_query("keyword_any"),
    "keyword_phrase": keyword_query("keyword_phrase"),
    "keyword_not": keyword_query("keyword_not"),
    "keyword_only_not": keyword_only_not,
    "keyword_rank": keyword_rank,
    "keyword_topk": keyword_topk,
    "keyword_batch": keyword_batch,
    "keyword_bitmaps": keyword_bitmaps,
    "keyword_topk_bounded": bounded_topk(lambda spark, sf: fixed_questions(spark, *KEYWORD_QUESTIONS.values(), QUESTION)),
    "keyword_batch_bounded": bounded_topk(benchmark_questions),
    "rrf_fuse": rrf_fuse,
    "hybrid_retrieve": hybrid_one,
    "hybrid_batch": hybrid_batch,
    "hybrid_batch_cells": hybrid_batch_cells,
    "citations": citations,
    "context_prompt": context_prompt,
    "answer_json": answer_json,
    "valid_questions": valid_questions,
    "upsert_documents": upsert_documents,
    "replace_chunks": replace_chunks,
    "reingest_changes": reingest_changes,
    "status_transition": status_transition,
    "cascade_delete": cascade_delete,
    "event_log": event_log,
    "recent_documents": recent_documents,
    "zip_vectors": zip_vectors,
    "bad_vectors": bad_vectors,
    "bad_status": bad_status,
    "duplicate_keys": duplicate_keys,
    "orphan_chunks": orphan_chunks,
    "by_status": by_status,
    "stream_ingest": stream_ingest,
    "hybrid_stored": hybrid_stored,
    "object_retries": object_retries,
    "streamed_answers": streamed_answers,
    "stored_tables": stored_tables,
    "chunks_of_documents": chunks_of_documents,
}
