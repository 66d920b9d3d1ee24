"""Pruned lookups, table functions in SQL, variant metadata."""

import hashlib

from pyspark.sql import functions as F

from sheaf.functions import table_functions
from sheaf.operators import chunks, metadata, pages
from sheaf.settings import ChunkKnobs
from sheaf.sources import lookup


def test_a_lookup_reads_a_small_share_of_the_rows(spark, tmp_path):
    n, path = 40_000, str(tmp_path / "chunks")
    rows = spark.range(n).select(
        F.sha2((F.col("id") / 20).cast("int").cast("string"), 256).alias("document_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"),
        F.col("id").alias("chunk_index"),
    )
    lookup.write_sorted(rows, path, ("document_id", "chunk_index"), ("chunk_id", "document_id"), rows_per_group=1000)
    wanted = [hashlib.sha256(str(i).encode()).hexdigest() for i in (7, 31_000)]
    by_chunk = lookup.find(spark, path, "chunk_id", [*wanted, None, wanted[0]])
    assert sorted(r.chunk_index for r in by_chunk.collect()) == [7, 31_000]
    # Hashed ids lie everywhere, so only the Bloom filters can tell.
    assert lookup.rows_read(by_chunk) <= 0.15 * n
    by_document = lookup.find(spark, path, "document_id", [hashlib.sha256(b"5").hexdigest()])
    assert sorted(r.chunk_index for r in by_document.collect()) == list(range(100, 120))
    assert lookup.rows_read(by_document) <= 0.1 * n
    nothing = lookup.find(spark, path, "chunk_id", ["not there"])
    assert nothing.collect() == [] and lookup.rows_read(nothing) <= 0.1 * n
    assert lookup.find(spark, path, "chunk_id", []).collect() == []


def long_pages(spark):
    texts = ["word " * 30 + "\n" + "line. " * 60 + "\f\f  \fthird page", "short", "", None, "x" * 500]
    return spark.createDataFrame([(f"d{i}", text) for i, text in enumerate(texts)], "document_id string, content string")


def test_sql_gives_the_rows_of_the_dataframe_form(spark):
    table_functions.register(spark)
    docs = long_pages(spark)
    docs.createOrReplaceTempView("long_pages")
    found = spark.sql("SELECT d.document_id, p.* FROM long_pages d, LATERAL split_pages(d.content, '\f') p")
    want = pages.explode_pages(pages.with_pages(docs, "content"), "document_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    knobs = ChunkKnobs(100, 20)
    cut = spark.sql(
        "SELECT d.document_id, c.* FROM long_pages d, LATERAL split_pages(d.content, '\f') p, LATERAL recursive_chunks(p.text, 100, 20) c"
    )
    rows = pages.with_pages(docs, "content").withColumn("pieces", chunks.recursive_pieces(F.col("pages"), knobs))
    want = chunks.explode_chunks(rows, "document_id").select("document_id", "content")
    assert sorted(tuple(r) for r in cut.select("document_id", "content").collect()) == sorted(map(tuple, want.collect()))
    assert cut.filter("document_id = 'd4'").count() > 4


def test_one_bad_page_survives_in_sql(spark):
    def page_fn(data):
        if data == b"bad":
            raise ValueError("no such format")

        def broken():
            raise ValueError("torn page")

        return [data.decode(), broken, "last"]

    table_functions.register(spark, page_fn)
    spark.createDataFrame([("a", b"first"), ("b", b"bad"), ("c", None)], "document_id string, content binary").createOrReplaceTempView("objects")
    found = spark.sql("SELECT d.document_id, p.* FROM objects d, LATERAL split_pages(d.content, '') p")
    assert sorted(map(tuple, found.collect())) == [("a", 1, "first"), ("a", 3, "last")]
    table_functions.register(spark)


def test_variant_paths(spark):
    texts = ['{"raw_bucket": "a", "size": 3}', '{"raw_bucket": "b", "size": "x"}', '{"nested": {"k": [1, 2]}}', "[1]", "no json", None]
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "id int, metadata string")
    typed = metadata.typed(rows, "metadata")
    got = typed.select("id", metadata.at("metadata", "$.raw_bucket"), metadata.at("metadata", "$.size", "int"), metadata.at("metadata", "$.nested.k[1]", "int"))
    assert sorted(map(tuple, got.collect())) == [
        (0, "a", 3, None), (1, "b", None, None), (2, None, None, 2), (3, None, None, None), (4, None, None, None), (5, None, None, None),
    ]
    objects = typed.filter("id < 3")
    assert {r.key: r.n for r in metadata.keys(objects, "metadata").collect()} == {"raw_bucket": 2, "size": 2, "nested": 1}
    assert {r.key: r.n for r in metadata.keys(typed, "metadata").collect()} == {"raw_bucket": 2, "size": 2, "nested": 1}


def test_chunks_of_an_ingest_have_bloom_filters():
    options = lookup.bloom_options(("id", "document_id"))
    assert options["parquet.bloom.filter.enabled#id"] == "true" and len(options) == 4
